"""Scalar functions over text and paths, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space.
WHITE = r"[\s\x0B\x{85}\p{Z}]+"
SUMMARY_CHARS = 200
QUERY_BYTES = 2000
BINARY_BYTES = 8192
TOKEN_BYTES = 4
TIER_TOKENS = 512
PREVIEW_LINES, PREVIEW_CHARS = 5, 256

# File extensions and their languages.
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "ts": "typescript"}

#: Directories whose files are neither watched nor tracked; a stem matches itself and all below it.
EXCLUDED = (".loomgraph/", ".git/", "node_modules/", "target/", ".env")


def words(text: Column) -> Column:
    """The words of a text: what stands between white space; [] for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def term_hits(terms: Column, text: Column) -> Column:
    """How many of the lower-case terms occur in the lower-case text, as substrings; a repeated term counts again."""
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t)))


def keyword_score(query: Column, text: Column) -> Column:
    """Share of the query's terms found in the text, damped by its length: share / (1 + ln(max(words, 1))). 0 without terms."""
    terms = words(F.lower(query))
    n = F.size(terms)
    damp = 1.0 + F.ln(F.greatest(F.size(words(text)), F.lit(1)).cast("double"))
    return F.when((n == 0) | text.isNull(), F.lit(0.0)).otherwise(term_hits(terms, text) / n / damp)


def term_share(query: Column, text: Column) -> Column:
    """Share of the query's terms found in the text, 0 without terms."""
    terms = words(F.lower(query))
    return F.when((F.size(terms) == 0) | text.isNull(), F.lit(0.0)).otherwise(term_hits(terms, text) / F.size(terms))


def summary(text: Column, chars: int = SUMMARY_CHARS) -> Column:
    """The text, or its first `chars` characters cut at their last blank, with an ellipsis."""
    head = F.left(text, F.lit(chars))
    last = F.lit(chars) - F.locate(" ", F.reverse(head))
    cut = F.when(F.contains(head, F.lit(" ")), F.left(head, last)).otherwise(head)
    return F.when(F.length(text) <= chars, text).otherwise(F.concat(cut, F.lit("…")))


def line_range(first: Column, last: Column) -> Column:
    """`L3-L9`, `L3` without an end, null without a start."""
    a = first.cast("string")
    return F.when(first.isNull(), None).when(last.isNull(), F.concat(F.lit("L"), a)).otherwise(F.concat(F.lit("L"), a, F.lit("-L"), last.cast("string")))


def record_table(record_id: Column) -> Column:
    """The table of a typed id `table:raw`; `unknown` without a colon."""
    return F.when(F.instr(record_id, ":") > 0, F.substring_index(record_id, ":", 1)).otherwise(F.lit("unknown"))


def language_of(path: Column) -> Column:
    """The language of a path's extension, the extension itself where it is none of LANGUAGES, `unknown` without one."""
    name = F.substring_index(path, "/", -1)
    ext = F.when(F.instr(F.substring(name, 2, 1 << 30), ".") > 0, F.substring_index(name, ".", -1))
    known = reduce(lambda c, kv: c.when(ext == kv[0], F.lit(kv[1])), LANGUAGES.items(), F.when(ext.isNull(), F.lit("unknown")))
    return known.otherwise(ext)


def is_excluded(path: Column, patterns: tuple[str, ...] = EXCLUDED, anywhere: bool = True) -> Column:
    """Is the path, or a directory on it, one of the patterns? anywhere: at any depth, else only at the root."""
    stems = "|".join(re.escape(p.rstrip("/")) for p in patterns)
    rel = F.translate(path, "\\", "/")
    return rel.rlike(f"(^|/)({stems})(/|$)" if anywhere else f"^({stems})(/|$)")


def glob_regex(pattern: str | None) -> str | None:
    """A regular expression for a glob (`*`, `**`, `?`, `[..]`, `{a,b}`); None for none and for an invalid one."""
    if not pattern or pattern.count("[") != pattern.count("]") or pattern.count("{") != pattern.count("}"):
        return None
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": ".*", "?": ".", "{": "(?:", "}": ")", ",": "|"}
    out, depth = "", 0
    for token in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]*\]|[{},]|.", pattern, re.S):
        depth += {"{": 1, "}": -1}.get(token, 0)
        if token.startswith("[") and len(token) > 1:
            out += "[^" + token[2:] if token[1] == "!" else token
        elif token == ",":
            out += "|" if depth else ","
        else:
            out += parts.get(token) or re.escape(token)
    return f"^(?s:{out})$"


def matches_glob(path: Column, pattern: str | None, or_name: bool = False) -> Column:
    """Does a path match the glob? True for no or an invalid pattern. or_name: the file name alone may match too."""
    regex = glob_regex(pattern)
    if regex is None:
        return F.lit(True)
    hit = path.rlike(regex)
    return hit | F.substring_index(path, "/", -1).rlike(regex) if or_name else hit


def is_binary(content: Column) -> Column:
    """Does a NUL stand among the first bytes of a binary column?"""
    return F.contains(F.decode(F.substring(content, 1, BINARY_BYTES), "ISO-8859-1"), F.lit("\0"))


def token_count(text: Column) -> Column:
    """UTF-8 bytes by four, rounded down."""
    return F.floor(F.octet_length(text) / TOKEN_BYTES)


def body_lines(source: Column, first: Column, last: Column) -> Column:
    """Lines first..last of a source; '' where that range does not lie in it."""
    lines = F.split(F.regexp_replace(source, "\n$", ""), "\n")
    ok = (first >= 1) & (last >= first) & (last <= F.size(lines)) & source.isNotNull() & (source != "")
    return F.when(ok, F.array_join(F.slice(lines, first, last - first + 1), "\n")).otherwise(F.lit(""))


def tier(body: Column, tokens: Column, signature: Column, docstring: Column, limit: int = TIER_TOKENS) -> Column:
    """struct(embed_type, summary): explicit_code with the body up to `limit` tokens, else summary_pointer with the signature and
    the docstring, or a preview of the body's first lines."""
    preview = F.left(F.array_join(F.slice(F.split(F.coalesce(body, F.lit("")), "\n"), 1, PREVIEW_LINES), "\n"), F.lit(PREVIEW_CHARS))
    signature = F.coalesce(signature, F.lit(""))
    short = F.when(F.coalesce(docstring, F.lit("")) != "", F.concat(signature, F.lit("\n\n"), docstring)).when(preview != "", F.concat(signature, F.lit("\n\n"), preview)).otherwise(signature)
    small = tokens <= limit
    return F.struct(F.when(small, F.lit("explicit_code")).otherwise(F.lit("summary_pointer")).alias("embed_type"), F.when(small, body).otherwise(short).alias("summary"))


def timestamp_of(text: Column) -> Column:
    """An RFC 3339 time; null where it is none."""
    return F.try_to_timestamp(text)
