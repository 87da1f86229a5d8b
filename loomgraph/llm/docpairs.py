"""Functions paired with their documentation, by island grammars.

Of a source file only the islands are parsed: comments, strings, attributes, the heads of functions and braces; all
else is water and skipped. Strings and ordinary comments are islands too, so that braces, heads or comment marks
in them are not mistaken for code. One pass over the islands keeps a stack of open braces, which gives each function
its signature, balanced body and the comment directly above it (in Python: the string that opens its body).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 6

# File extension to grammar.
GRAMMARS = {"rs": "rust", "py": "python", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "ts": "script", "tsx": "script"}

_RUST = re.compile(
    r"""(?P<comment>//[^\n]*)
    |(?P<block>/\*)
    |(?P<string>\bb?r(?P<hashes>\#*)".*?"(?P=hashes)|b?"(?:\\.|[^"\\])*"|b?'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.)|[^\\'\n])')
    |(?P<attribute>\#!?\[)
    |(?P<head>\bfn\s+(?P<name>(?:r\#)?\w+)\s*(?=[<(]))
    |(?P<mark>[{}();])""",
    re.X | re.S,
)

_SCRIPT = re.compile(
    r"""(?P<comment>//[^\n]*)
    |(?P<block>/\*)
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?:(?<=[(,=:\[!&|?{};])|(?<=return))\s*/(?![*/\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)
    |(?P<head>\bfunction\b\s*\*?\s*(?P<name>[\w$]+)\s*(?=[<(])
      |^[ \t]*(?:(?:public|private|protected|static|async|get|set|override|readonly)[ \t]+)*\*?(?P<method>(?!(?:if|for|while|switch|catch|function|return|await|throw|new|typeof|super|with|do|else|yield|void)\b)[A-Za-z_$\#][\w$]*)\s*(?=[<(])
      |\b(?:const|let|var)\s+(?P<arrow>[\w$]+)(?:\s*:(?:[^=\n]|=>)+?)?\s*=(?![=>])\s*(?:async\b\s*)?(?=[<(]))
    |(?P<mark>[{}();])""",
    re.X | re.S | re.M,
)

_SCRIPT_ISLANDS = re.compile(_SCRIPT.pattern[: _SCRIPT.pattern.index("|(?P<head>")] + "|(?P<mark>[{}()])", re.X | re.S | re.M)
_GAP = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*", re.S)
#: What ends in this, a type follows.
_TYPE_NEXT = re.compile(r"(?:[:|&<,(\[?]|=>|\b(?:is|extends|keyof|readonly|new|asserts|infer))\s*$")

_PYTHON = re.compile(
    r"""(?P<comment>\#[^\n]*)
    |(?P<string>[rRuUbBfF]{0,3}(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))
    |(?P<head>^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?=[\[(]))""",
    re.X | re.S | re.M,
)
_OPENING = re.compile(r"(?:[ \t]*(?:\#[^\n]*)?\n)*[ \t]*(?P<prefix>[rRuU]?)(?P<quote>\"\"\"|'''|\"|')", re.S)


class Function(NamedTuple):
    name: str
    line_start: int
    line_end: int
    signature: str
    documentation: str  # as written, with its comment marks; '' without
    body: str


def _line_starts(text: str) -> list[int]:
    """Places of the line ends, for line numbers by binary search."""
    return [m.start() for m in re.finditer("\n", text)]


def _block_end(text: str, at: int, nested: bool) -> int:
    """The place after the block comment that opens at `at`."""
    if not nested:
        end = text.find("*/", at + 2)
        return len(text) if end < 0 else end + 2
    depth, at = 1, at + 2
    while depth:
        close = text.find("*/", at)
        if close < 0:
            return len(text)
        opening = text.find("/*", at, close)
        depth, at = (depth + 1, opening + 2) if opening >= 0 else (depth - 1, close + 2)
    return at


def _attribute_end(text: str, at: int) -> int:
    """The place after the attribute whose bracket opens at `at`."""
    depth = 0
    for m in re.compile(r'"(?:\\.|[^"\\])*"|[\[\]]').finditer(text, at):
        depth += {"[": 1, "]": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    return len(text)


def _closings(text: str) -> dict[int, int]:
    """The place of each script's brace or parenthesis that closes, by the place where it opens."""
    out: dict[int, int] = {}
    stack: list[int] = []
    braces = at = 0
    while m := _SCRIPT_ISLANDS.search(text, at):
        at = m.end()
        if m.lastgroup == "block":
            at = _block_end(text, m.start(), False)
        elif m.lastgroup == "mark" and m[0] in "({":
            stack.append(m.start())
            braces += m[0] == "{"
        elif m.lastgroup == "mark":
            if m[0] == "}" and braces:
                while text[stack[-1]] != "{":  # parentheses that never close
                    stack.pop()
                braces -= 1
                out[stack.pop()] = m.start()
            elif m[0] == ")" and stack and text[stack[-1]] == "(":
                out[stack.pop()] = m.start()
    return out


def _script_body(text: str, at: int, closings: dict[int, int], arrow: bool) -> int:
    """The place of the brace that opens the body of the function whose type parameters or parameters begin at `at`; -1 without one."""
    if text[at] == "<":
        depth = 0
        while at < len(text):
            c = text[at]
            if c in "({":
                at = closings.get(at, len(text))
            elif c in ";)}":
                return -1
            elif c == "<":
                depth += 1
            elif c == ">" and text[at - 1] != "=":
                depth -= 1
            at += 1
            if not depth:
                break
        at = _GAP.match(text, at).end()
    if text[at : at + 1] != "(" or at not in closings:
        return -1
    at = _GAP.match(text, closings[at] + 1).end()
    typed = text[at : at + 1] == ":"
    if not typed:
        if arrow and not text.startswith("=>", at):
            return -1
        at = _GAP.match(text, at + 2).end() if arrow else at
        return at if text[at : at + 1] == "{" and at in closings else -1
    at += 1
    while at < len(text):  # the type of what is returned
        c = text[at]
        if text.startswith("=>", at):
            at = _GAP.match(text, at + 2).end()
            if arrow and text[at : at + 1] == "{" and at in closings and not text.startswith("=>", _GAP.match(text, closings[at] + 1).end()):
                return at
            if text[at : at + 1] in ("{", "("):
                at = closings.get(at, len(text)) + 1
            continue
        if c in "({":
            if not _TYPE_NEXT.search(text, max(0, at - 40), at):
                return at if c == "{" and not arrow and at in closings else -1
            at = closings.get(at, len(text))
        elif c in ";})=":
            return -1
        elif c == "/" and text[at + 1 : at + 2] in ("/", "*"):
            at = max(at, _GAP.match(text, at).end() - 1)
        elif c in "'\"`":
            end = text.find(c, at + 1)
            at = len(text) if end < 0 else end
        at += 1
    return -1


def _braced(text: str, grammar: str) -> list[Function]:
    rust = grammar == "rust"
    search = (_RUST if rust else _SCRIPT).search
    out: list[Function] = []
    stack: list[tuple | None] = []  # per open brace: the function whose body it opens, or None
    doc: list[tuple[int, int]] = []  # spans of documentation directly above the place reached
    edge = 0  # where the last documentation or attribute ended
    head, depth, at = None, 0, 0
    bodies: dict[int, tuple] = {}  # of scripts: where a body opens, and whose it is
    closings = {} if rust else _closings(text)
    ends = _line_starts(text)

    def above(start: int) -> str:
        """What documentation there is, if only white space without an empty line lies between it and `start`."""
        if doc and text[edge:start].strip() == "" and text.count("\n", edge, start) < 2:
            return "\n".join(text[a:b] for a, b in doc)
        return ""

    while m := search(text, at):
        at = m.end()
        kind = m.lastgroup if m.lastgroup in ("comment", "block", "string", "attribute", "mark") else "head" if m["head"] is not None else "string"
        if kind in ("comment", "block"):
            end = at if kind == "comment" else _block_end(text, m.start(), rust)
            raw = text[m.start() : end]
            is_doc = raw.startswith("///") and not raw.startswith("////") and rust if kind == "comment" else raw.startswith("/**") and not raw.startswith("/***") and raw != "/**/"
            near = doc and text[edge : m.start()].strip() == "" and text.count("\n", edge, m.start()) < 2
            if not is_doc:
                doc = []
            elif kind == "comment" and near:
                doc.append((m.start(), end))
            else:
                doc = [(m.start(), end)]
            at = edge = end
        elif kind == "attribute":
            at = _attribute_end(text, at - 1)
            if doc and text[edge : m.start()].strip() == "":
                edge = at
        elif kind == "head":
            opens = 0 if rust else _script_body(text, at, closings, m["arrow"] is not None)
            if opens < 0:
                if m["method"]:  # a call; modifiers and name are water
                    doc = []
                continue
            name = m["name"] or (None if rust else m["method"] or m["arrow"])
            start = text.rfind("\n", 0, m.start() + (0 if rust or m["name"] or m["arrow"] else len(m[0]) - len(m[0].lstrip()))) + 1
            while start < m.start() and text[start] in " \t":
                start += 1
            if not rust and m["method"]:
                start = m.start() + len(m[0]) - len(m[0].lstrip())
            closing = max(text.rfind(c, start, m.start()) for c in "{};/") if start < m.start() else -1
            if closing >= start and "extern" not in text[start : m.start()]:  # something else stands on the line
                start = closing + 1
                while start < m.start() and text[start] in " \t":
                    start += 1
            if rust:
                head, depth = (name, start, above(start)), 0
            else:
                bodies[opens] = (name, start, above(start))
            doc = []
        elif kind == "mark":
            c = m[0]
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            elif c == ";":
                if depth <= 0:
                    head = None
            elif c == "{":
                if m.start() in bodies:
                    stack.append((*bodies.pop(m.start()), m.start()))
                elif head and depth <= 0:
                    stack.append((*head, m.start()))
                    head = None
                else:
                    stack.append(None)
            elif stack:
                done = stack.pop()
                if done:
                    name, start, documentation, opened = done
                    first, last = bisect_left(ends, start) + 1, bisect_left(ends, at) + 1
                    out.append(Function(name, first, last, text[start:opened].strip(), documentation, text[start:at]))
    return out


def _indented(text: str) -> list[Function]:
    heads, opaque = [], []  # opaque: spans in which line starts do not count
    at = 0
    while m := _PYTHON.search(text, at):
        at = m.end()
        if m["string"] is not None:
            opaque.append((m.start(), m.end()))
        elif m["head"] is not None:
            depth, k = 0, at
            inner = re.compile(r"""\#[^\n]*|[rRuUbBfF]{0,3}("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|[\[\](){}:]""")
            while t := inner.search(text, k):
                k = t.end()
                if t[0] in "([{":
                    depth += 1
                elif t[0] in ")]}":
                    depth -= 1
                elif t[0] == ":" and depth == 0:
                    break
            opaque.append((m.end(), k))
            heads.append((m["name"], m.start() + len(m["indent"]), len(m["indent"].expandtabs(8)), k))
            at = k
    out = []
    ends = _line_starts(text)
    for name, start, indent, colon in heads:
        documentation = ""
        m = _OPENING.match(text, colon)
        if m:
            quote = m["quote"]
            end = re.compile(r"(?:\\.|(?!" + quote + r")[^\\])*" + quote, re.S).match(text, m.end())
            if end and (len(quote) == 3 or "\n" not in end[0]):
                documentation = text[m.start("prefix") : end.end()]
        last, k = colon, text.find("\n", colon)
        stop = len(text)
        while 0 <= k < stop:
            line_end = text.find("\n", k + 1)
            line_end = stop if line_end < 0 else line_end
            line = text[k + 1 : line_end]
            if line.strip():
                inside = _within(opaque, k + 1)
                if not inside and len(line[: len(line) - len(line.lstrip())].expandtabs(8)) <= indent:
                    break
                last = line_end
            k = line_end
        first = bisect_left(ends, start) + 1
        body = text[start : max(last, colon)].rstrip()
        out.append(Function(name, first, first + body.count("\n"), text[start:colon].strip(), documentation, body))
    return out


def _within(spans: list[tuple[int, int]], at: int) -> bool:
    i = bisect_right(spans, (at, 1 << 60)) - 1
    return i >= 0 and spans[i][0] < at < spans[i][1]


def extract(path: str, text: str) -> list[Function]:
    """All functions with a body of a source file, in the grammar of its extension; none for others."""
    grammar = GRAMMARS.get(path.rsplit(".", 1)[-1].lower() if "." in path else "")
    if grammar is None:
        return []
    return _indented(text) if grammar == "python" else _braced(text, grammar)


_LETTERS = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]")
_TAG = re.compile(r"(?:^|(?<=[\s{]))[@\\]([A-Za-z]+)|^[ \t]*:([A-Za-z]+)(?:[ \t]+[\w.,* \[\]]+)?:", re.M)
_LEGAL = re.compile(r"copyright|\(c\)\s*\d{4}|©|spdx|all rights reserved|licen[cs]ed? (?:under|found|at|terms)|governed by the licen[cs]e|under the terms of|warrant(?:y|ies)|redistribut", re.I)
_PROMISE = re.compile(
    r"^\W*(?:todo|fixme|xxx|tbd|tba|wip|hack)\b"
    r"|\b(?:docs?|documentation|docstring|description|comments?)\b.{0,40}\b(?:pending|missing|later|follows?|coming|soon|needed|required|to be|will be|tbd|todo|goes here)\b"
    r"|\b(?:to be|will be|gets?|needs? to be) (?:documented|described|filled in|written|added)\b"
    r"|\b(?:write|add|fill in|provide|insert) (?:the |some |a |proper )?(?:docs?|documentation|docstring|description|comment)\b"
    r"|\b(?:document|describe) (?:this|me|it)\b",
    re.I,
)
_CODE_START = re.compile(r"^(?:let|const|var|while|for|if|return|match|switch|with|assert|raise|def|fn|import|from|use|await|throw|case|pub|async|else|elif|try|function|class|impl|struct|enum)\b.*[({\[=]|^(?:log|logger|tracing|console|print|debug)\b\s*[.:!(]")
_CODE_END = re.compile(r"[;{}]\s*$|\)\s*[:?]?\s*$|[\])]\s*$")
_CODE_SIGN = re.compile(r"\w\(|[\w\])]\s*(?:[-+*/|&]?=)\s*[\w\[{(\"'&]|::\w+\(|=>|->|\w\.\w+\(|\[\"|\{\s*\w")


def comment_text(documentation: str) -> str:
    """A documentation comment without its marks, lines trimmed."""
    d = documentation
    m = re.match(r"[rRuU]?(\"\"\"|'''|\"|')", d)
    if m:
        return "\n".join(x.strip() for x in d[m.end() : -len(m[1])].strip().split("\n"))
    if d.startswith("/**"):
        d = re.sub(r"\*+/\s*$", "", d[3:])
        return "\n".join(re.sub(r"^\s*\*(?!/)\s?", "", x).strip() for x in d.split("\n")).strip()
    return "\n".join(re.sub(r"^\s*///\s?", "", x).strip() for x in d.split("\n")).strip()


def _is_code(line: str) -> bool:
    bare = re.sub(r"`[^`]*`", " ", line)
    if _CODE_START.search(bare) and (_CODE_SIGN.search(bare) or _CODE_END.search(bare)):
        return True
    return bool(_CODE_SIGN.search(bare) and _CODE_END.search(bare)) or bool(_CODE_SIGN.search(bare) and re.match(r"^[\w.\[\]\"']+\s*(?:[-+*/]?=|\(|\.)", bare))


def description(documentation: str) -> str:
    """The lines of a documentation comment that can describe: no legal notice, promise, ruler, code or fenced example."""
    kept, fenced = [], False
    for line in comment_text(documentation).split("\n"):
        if line.startswith("```"):
            fenced = not fenced
            continue
        if fenced or not line or _LEGAL.search(line) or _PROMISE.search(line) or _is_code(line):
            continue
        kept.append(line)
    return "\n".join(kept)


def own_words(documentation: str, name: str, signature: str) -> set[str]:
    """The different words of a description that are not parts of the function's name or signature, nor tag names."""
    text = description(documentation)
    tags = {w.lower() for m in _TAG.finditer(text) for w in m.groups() if w}
    text = _TAG.sub(" ", text)
    head = f"{name} {signature}"
    parts = {w.lower() for w in _LETTERS.findall(head)} | {w.lower() for w in _CAMEL.findall(head)}
    return {w.lower() for w in _LETTERS.findall(text)} - parts - tags


_FOUND = "path string, name string, line_start int, line_end int, signature string, docstring string, body string"


def documented(sources: DataFrame) -> DataFrame:
    """(path, name, line_start, line_end, signature, docstring, body): functions of the files (path, source) with a documentation
    comment of at least LEAST_WORDS words of its own; docstring is the comment without marks.

    Null sources, unknown extensions and files without functions give none; a repeated row of a file is put out again. Should two
    texts of one path have a function of one name on the same line, both are put out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
        names = [x.split(" ")[0] for x in _FOUND.split(", ")]
        for b in batches:
            for s in range(0, b.num_rows, 200):
                rows: list[list] = [[] for _ in names]
                part = b.slice(s, 200)
                for path, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for f in extract(path, text):
                        if f.documentation and len(own_words(f.documentation, f.name, f.signature)) >= LEAST_WORDS:
                            for column, v in zip(rows, (path, f.name, f.line_start, f.line_end, f.signature, comment_text(f.documentation), f.body)):
                                column.append(v)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names)

    return sources.select("path", "source").where("path is not null and source is not null").mapInArrow(run, _FOUND)


def _placed(sources: DataFrame, functions: DataFrame) -> DataFrame:
    """documented() with the fn_id of the function at its place, matched by file_path, name and line_start."""
    known = functions.select("fn_id", F.col("file_path").alias("path"), "name", "line_start").where("fn_id is not null").distinct()
    return known.join(documented(sources), ["path", "name", "line_start"])


def pairs(sources: DataFrame, functions: DataFrame) -> DataFrame:
    """(fn_id, signature, docstring, body) of each of `functions` that documented() finds at its place in its file; once per fn_id,
    of several the first by docstring, signature and body. All three are those of the source."""
    one = _placed(sources, functions).groupBy("fn_id").agg(F.min(F.struct("docstring", "signature", "body")).alias("p"))
    return one.select("fn_id", "p.signature", "p.docstring", "p.body")


def found(sources: DataFrame, functions: DataFrame) -> DataFrame:
    """fn_id of each function whose documentation describes it."""
    return _placed(sources, functions).select("fn_id").distinct()
