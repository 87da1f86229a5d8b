"""Cutting oversized texts into pieces under a token limit, at natural boundaries, with overlap.

A token is four UTF-8 bytes, a text of n bytes has n // 4 tokens. Each text gets the prefix sums of its characters'
bytes and sorted arrays of the places where a block or a line begins. A block begins with a line that follows an empty one, or
with one at the outermost indent where something deeper or a closing bracket ends. A piece ends at the last block boundary
under the limit, found by binary search, else at the last line boundary, else hard at the last character that fits. The next
one steps back by the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTES_PER_TOKEN = 4
DEFAULT_LIMIT = 512
DEFAULT_OVERLAP = 0

_CLOSING = re.compile(r"[\])}>;,\s]*(?:end\b)?[\])}>;,\s]*$")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted offsets at which blocks and lines begin (offset 0 and the end are left out)."""
    starts, blocks, at = [], [], 0
    seen = []  # (place, indent, closing) of the lines that are not blank, None for a blank one
    for line in text.split("\n"):
        bare = line.lstrip(" \t\r")
        seen.append((at, len(line) - len(bare), bool(_CLOSING.match(bare))) if bare else None)
        starts.append(at)
        at += len(line) + 1
    # A body begins without its first line's indent, so the first line tells nothing of the outermost one.
    outer = min((s[1] for s in seen[1:] if s and not s[2]), default=0)
    last, after_blank = None, False
    for s in seen:
        if s is None:
            after_blank = True
            continue
        if last is not None and (after_blank or (s[1] <= outer and not s[2] and (last[1] > outer or last[2]))):
            blocks.append(s[0])
        last, after_blank = s, False
    return np.asarray(blocks, np.int64), np.asarray([s for s in starts[1:] if s < len(text)], np.int64)


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) in characters of each piece: at most `limit` tokens each, together the whole text, every one
    but the first beginning up to `overlap` tokens before its predecessor's end.

    A limit below 1 counts as 1. An overlap of the limit or more is lowered to the limit less one, and a piece
    always brings at least one new character, even one of more bytes than the limit holds.
    """
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    at = np.zeros(n + 1, np.int64)
    at[1:] = np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
    if at[n] // BYTES_PER_TOKEN <= limit:
        return [(0, n)]
    blocks, lines = boundaries(text)
    room = limit * BYTES_PER_TOKEN + BYTES_PER_TOKEN - 1
    pieces, begin, known = [], 0, 0
    while True:
        last = int(np.searchsorted(at, at[begin] + room, side="right")) - 1
        if last >= n:
            pieces.append((begin, n))
            return pieces
        last = max(last, known + 1)
        end = last
        for marks in (blocks, lines):
            i = int(np.searchsorted(marks, last, side="right")) - 1
            if i >= 0 and marks[i] > known:
                end = int(marks[i])
                break
        pieces.append((begin, end))
        known = end
        begin = min(end, max(begin + 1, int(np.searchsorted(at, at[end] - overlap * BYTES_PER_TOKEN, side="left"))))


def with_limits(functions: DataFrame, config: DataFrame) -> DataFrame:
    """functions (fn_id, workspace, body), one row per fn_id, with token_limit and overlap_tokens of the workspace.

    A workspace without a row, or with a null, has DEFAULT_LIMIT and DEFAULT_OVERLAP. Of several rows of one
    workspace the smallest values count. Rows without fn_id or body are left out. The config joins by its own
    size: Spark broadcasts it below the session's threshold and shuffles it beyond.
    """
    limits = config.groupBy("workspace").agg(F.min("token_limit").alias("token_limit"), F.min("overlap_tokens").alias("overlap_tokens"))
    return (
        functions.select("fn_id", "workspace", "body")
        .where("fn_id is not null and body is not null")
        .join(limits, "workspace", "left")
        .select("fn_id", "body", F.coalesce("token_limit", F.lit(DEFAULT_LIMIT)).alias("token_limit"), F.coalesce("overlap_tokens", F.lit(DEFAULT_OVERLAP)).alias("overlap_tokens"))
    )


PIECE = "fn_id long, piece int, char_start int, char_end int, overlap_chars int, token_count int, text string"


def pieces(functions: DataFrame, config: DataFrame) -> DataFrame:
    """The pieces of each body whose real token count (UTF-8 bytes // 4) exceeds its workspace's limit.

    piece counts from 0; text is the body from char_start to char_end; overlap_chars of it are also the end of
    the piece before, so that the texts without them, in order, give back the body. Bodies within the limit and null
    ones have no pieces. A limit below 1 decides as it stands which bodies are cut; their pieces have up to one token. A row that stands there twice is cut once (the pieces carry no row identity,
    and equal rows have equal pieces).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            size = 0
            for fn, body, limit, overlap in zip(*(c.to_pylist() for c in b.columns)):
                done = 0
                for k, (s, e) in enumerate(cut(body, limit, overlap)):
                    part = body[s:e]
                    for column, v in zip(rows, (fn, k, s, e, done - s if k else 0, len(part.encode()) // BYTES_PER_TOKEN, part)):
                        column.append(v)
                    done = e
                    size += len(part)
                if size > 8_000_000:
                    yield _batch(rows)
                    rows, size = [[] for _ in range(7)], 0
            if rows[0]:
                yield _batch(rows)

    real = F.floor(F.octet_length("body") / BYTES_PER_TOKEN)
    return with_limits(functions, config).where(real > F.col("token_limit")).mapInArrow(run, PIECE)


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    names = [x.split(" ")[0] for x in PIECE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names)


def split_bodies(functions: DataFrame, config: DataFrame) -> DataFrame:
    """pieces() with each piece once, also where rows of a function are repeated."""
    return pieces(functions, config).dropDuplicates(["fn_id", "piece"])


def oversized(functions: DataFrame, config: DataFrame) -> DataFrame:
    """fn_id of each function that had to be cut, once."""
    return pieces(functions, config).select("fn_id").distinct()
