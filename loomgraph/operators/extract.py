"""Symbols and edges of Rust sources by a small brace-matching reader: top-level functions, structs, traits, the methods of
impl blocks, use paths, and calls by name. What a macro is given is not read."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Callees too common to mean anything.
COMMON_CALLEES = frozenset(("new", "default", "into", "clone", "from", "unwrap", "expect", "ok", "err"))

_OPAQUE = re.compile(r'//[^\n]*|/\*|\bb?r(#*)"|b?"(?:\\.|[^"\\])*"|b?\'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.)|[^\\\'\n])\'', re.S)
_ITEM = re.compile(
    r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*(?P<word>fn|struct|trait|impl|use|mod|enum|union)\b\s*(?P<name>(?:r#)?\w+)?", re.S
)
_CALL = re.compile(r"(?<![\w.!])(?:(?:\w+|<[^<>]*>)\s*::\s*)*(?P<name>\w+)\s*(?:::\s*<[^;{}()]*?>\s*)?\(")
_MACRO = re.compile(r"\w+!\s*\w*\s*([(\[{])")
_PAIR = {"(": ")", "[": "]", "{": "}"}
_KEYWORDS = frozenset("if while for match return loop fn in as let move unsafe else where impl dyn mut ref".split())


class Symbol(NamedTuple):
    kind: str
    name: str
    line_start: int
    line_end: int
    signature: str | None
    docstring: str | None
    body: str


class Edge(NamedTuple):
    edge_type: str
    src: str | None
    dst: str


def blanked(text: str) -> str:
    """The text with comments and literals overwritten by blanks, line ends kept; every place stays where it is."""
    out, last, at = [], 0, 0
    while m := _OPAQUE.search(text, at):
        end = m.end()
        if m[0] == "/*":
            depth = 1
            for t in re.compile(r"/\*|\*/").finditer(text, end):
                depth += 1 if t[0] == "/*" else -1
                end = t.end()
                if not depth:
                    break
            else:
                end = len(text)
        elif m[1] is not None:
            close = text.find('"' + m[1], end)
            end = len(text) if close < 0 else close + 1 + len(m[1])
        out.append(text[last : m.start()])
        out.append(re.sub(r"[^\n]", " ", text[m.start() : end]))
        last = at = end
    out.append(text[last:])
    return "".join(out)


def closing(code: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`; the end of the text if none does."""
    mate, depth = _PAIR[code[at]], 0
    for m in re.compile("[" + re.escape(code[at] + mate) + "]").finditer(code, at):
        depth += 1 if m[0] == code[at] else -1
        if not depth:
            return m.end()
    return len(code)


def documentation(text: str, start: int) -> str | None:
    """The `///` lines or the `/** */` block before an item, attributes between them skipped, without their marks."""
    lines: list[str] = []
    above = text[:start].rstrip(" \t")
    while above.endswith("\n"):
        line = above[above.rfind("\n", 0, -1) + 1 : -1]
        bare = line.strip()
        if bare.startswith("///"):
            lines.append(bare.lstrip("/").strip())
        elif bare.endswith("*/"):
            opening = above.rfind("/*")
            if opening >= 0 and above.startswith("/**", opening):
                lines.append(above[opening + 3 : above.rfind("*/")].strip())
            break
        elif bare.endswith("]") and (bare.startswith("#[") or above.rfind("#[") >= 0 and bare.startswith(")")):
            if not bare.startswith("#["):
                above = above[: above.rfind("#[")].rstrip(" \t")
                continue
        elif bare:
            break
        above = above[: len(above) - len(line) - 1]
    return "\n".join(reversed(lines)) if lines else None


def calls(code: str) -> list[str]:
    """Names called in blanked code: plain and path calls by their last part; method calls and macros are left out."""
    at, out = 0, []
    kept = []
    while m := _MACRO.search(code, at):
        kept.append(code[at : m.start()])
        at = closing(code, m.end() - 1)
    kept.append(code[at:])
    for m in _CALL.finditer(" ".join(kept)):
        if m["name"] not in COMMON_CALLEES and m["name"] not in _KEYWORDS:
            out.append(m["name"])
    return out


def parse(text: str) -> tuple[list[Symbol], list[Edge]]:
    """The symbols and edges of a source: defines, calls (caller, callee), imports (path), inherits_from (type, trait)."""
    code = blanked(text)
    symbols: list[Symbol] = []
    edges: list[Edge] = []

    def line(at: int) -> int:
        return text.count("\n", 0, at) + 1

    def add(kind: str, name: str, start: int, body_at: int, end: int) -> None:
        signature = text[start:body_at].strip() if kind == "function" else None
        symbols.append(Symbol(kind, name, line(start), line(end - 1), signature, documentation(text, start), text[start:end]))
        edges.append(Edge("defines", None, name))

    def items(at: int, stop: int, owner: str | None) -> None:
        while at < stop:
            m = re.compile(r"#!?\[|[^\s]").search(code, at, stop)
            if not m:
                return
            if m[0].startswith("#") and len(m[0]) > 1:
                at = closing(code, m.end() - 1)
                continue
            item = _ITEM.match(code, m.start())
            if not item:
                at = closing(code, m.start()) if m[0] in _PAIR else (re.compile(r"\w+|.", re.S).match(code, m.start()).end())
                continue
            start, word, name = m.start(), item["word"], item["name"]
            end_mark = re.compile(r"[;{]").search(code, item.end(), stop)
            while end_mark and code.count("(", item.start(), end_mark.start()) > code.count(")", item.start(), end_mark.start()):
                end_mark = re.compile(r"[;{]").search(code, end_mark.end(), stop)
            if not end_mark:
                return
            end = closing(code, end_mark.start()) if end_mark[0] == "{" else end_mark.end()
            if word == "fn" and name and end_mark[0] == "{":
                full = f"{owner}::{name}" if owner else name
                add("function", full, start, end_mark.start(), end)
                edges.extend(Edge("calls", full, c) for c in calls(code[end_mark.start() : end]))
            elif word == "struct" and name and owner is None:
                add("class", name, start, end_mark.start(), end)
            elif word == "trait" and name and owner is None:
                add("interface", name, start, end_mark.start(), end)
            elif word == "impl" and owner is None and end_mark[0] == "{":
                head = re.sub(r"\s+", " ", text[item.start("word") + 4 : end_mark.start()]).split(" where ")[0].strip()
                if head.startswith("<"):
                    head = head[_angle(head) :].strip()
                trait, _, kind = head.rpartition(" for ")
                kind = kind.strip()
                if trait:
                    edges.append(Edge("inherits_from", kind, trait.strip()))
                items(end_mark.end(), end - 1, kind)
            elif word == "use" and owner is None:
                end = code.find(";", item.start()) + 1 or stop
                edges.append(Edge("imports", None, re.sub(r"^(?:pub(?:\s*\([^)]*\))?\s+)?use\s+", "", text[start : end - 1]).strip()))
            at = end

    items(0, len(code), None)
    return symbols, edges


def _angle(head: str) -> int:
    depth = 0
    for i, c in enumerate(head):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if not depth:
            return i + 1
    return len(head)


_SYMBOL = "path string, kind string, name string, line_start int, line_end int, signature string, docstring string, body string, body_hash string, token_count int"
_EDGE = "path string, edge_type string, src string, dst string"


def _arrow(rows: list[list], schema: str) -> pa.RecordBatch:
    kinds = [pa.int32() if x.endswith(" int") else pa.string() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], [x.split(" ")[0] for x in schema.split(", ")])


def _sources(files: DataFrame) -> DataFrame:
    return files.select("path", "source").where(F.col("path").endswith(".rs") & F.col("source").isNotNull()).groupBy("path").agg(F.min("source").alias("source"))


def symbols_of(files: DataFrame) -> DataFrame:
    """The symbols of all Rust sources (path, source); a repeated path counts once, null sources give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(10)]
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s in parse(text)[0]:
                    raw = s.body.encode()
                    for column, v in zip(rows, (path, *s, hashlib.sha256(raw).hexdigest(), len(raw) // 4)):
                        column.append(v)
            yield _arrow(rows, _SYMBOL)

    return _sources(files).mapInArrow(run, _SYMBOL)


def edges_of(files: DataFrame) -> DataFrame:
    """The edges of all Rust sources by name: src null stands for the file itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(4)]
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for e in parse(text)[1]:
                    for column, v in zip(rows, (path, *e)):
                        column.append(v)
            yield _arrow(rows, _EDGE)

    return _sources(files).mapInArrow(run, _EDGE)
