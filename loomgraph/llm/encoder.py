"""Byte-level BPE encoding of a corpus with a public vocabulary.

A word's merges run over two short lists: the part boundaries, and the rank of each pair of adjacent parts. The
lowest rank is looked for by a scan, its inner boundary deleted, and the two neighbouring ranks looked up anew.
Words repeat, so each worker keeps the ids of words it has seen. A scan per merge is quadratic, so words over
SHORT bytes take their minimum from a heap over a linked list instead; both give the same ids.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SHORT = 256
CACHED_WORDS = 300_000

_NONE = 1 << 60


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word: boundaries and adjacent ranks in contiguous lists."""
    edge = list(range(len(word) + 1))
    rank = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while rank:
        least = min(rank)
        if least == _NONE:
            break
        i = rank.index(least)
        del edge[i + 1]
        del rank[i]
        if i < len(rank):
            rank[i] = ranks.get(word[edge[i] : edge[i + 2]], _NONE)
        if i:
            rank[i - 1] = ranks.get(word[edge[i - 1] : edge[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(edge, edge[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word, the same as merge_short gives: lowest rank first, leftmost among equals."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)

    def push(i: int) -> None:
        if i >= 0 and after[i] < n:
            end = after[after[i]]
            r = ranks.get(word[i:end])
            if r is not None:
                heapq.heappush(heap, (r, i, end))

    while heap:
        _, i, end = heapq.heappop(heap)
        if gone[i] or after[i] >= n or after[after[i]] != end:
            continue  # one of the two parts has changed since
        gone[after[i]] = 1
        after[i] = end
        if end < n:
            before[end] = i
        push(i)
        push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts with the ranks of a vocabulary file (lines of base64 token and rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(PATTERN).findall
        ranks = self.ranks

        class Words(dict):
            def __missing__(self, word: str) -> list[int]:
                raw = word.encode()
                ids = [ranks[raw]] if raw in ranks else merge_short(raw, ranks) if len(raw) <= SHORT else merge_long(raw, ranks)
                if len(raw) <= SHORT:
                    self[word] = ids
                return ids

        self.words = Words()

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> str:
        back = {v: k for k, v in self.ranks.items()}
        return b"".join(back[i] for i in ids).decode()

    def batch(self, texts: list[str | None]) -> pa.ListArray:
        flat, ends = array("i"), [0]
        for t in texts:
            if t:
                flat.extend(chain.from_iterable(map(self.words.__getitem__, self.split(t))))
            ends.append(len(flat))
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)) if flat else pa.array([], pa.int32()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path)


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) of each row: the token ids of its text, without special tokens.

    Null and empty texts have the empty list; strings of special tokens are ordinary text; every row comes out
    once, repeated rows as often as they stand there; an empty table gives no rows. Other columns are not read. The
    vocabulary is a file of the driver's, or of any file system that Spark reads; Spark brings it to the workers.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            for s in range(0, b.num_rows, 2000):  # so that the ids of few texts are in memory at a time
                part = b.slice(s, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), enc.batch(part.column(1).to_pylist())], ["row_id", "ids"])

    kind = documents.schema[id_column].dataType.simpleString()
    slim = documents.select(documents[id_column].alias("row_id"), documents[text_column].alias("t"))
    return slim.mapInArrow(run, f"row_id {kind}, ids array<int>").withColumnRenamed("row_id", id_column)
