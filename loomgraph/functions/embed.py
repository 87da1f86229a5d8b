"""Texts to vectors: the place where a model would be plugged in, with a deterministic one that needs no files."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 384
BACKFILL_CHARS = 4096

_WORD = re.compile(r"[A-Za-z]+|\d+|[^\W\da-zA-Z_]+")


def hashed(texts: list[str]) -> np.ndarray:
    """A signed hash of the words and their neighbours, scaled to length 1; the zero vector for a text without words."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for k, t in enumerate(texts):
        words = [w.lower() for w in _WORD.findall(t or "")]
        for w in [*words, *(a + " " + b for a, b in zip(words, words[1:]))]:
            h = zlib.crc32(w.encode())
            out[k, h % DIMENSIONS] += 1.0 if h >> 31 else -1.0
        n = float(np.sqrt((out[k] ** 2).sum()))
        if n:
            out[k] /= n
    return out


def embed_text(text: str, model: Callable[[list[str]], np.ndarray] = hashed) -> list[float]:
    return [float(v) for v in model([text])[0]]


def with_embedding(rows: DataFrame, text_column: str, model: Callable[[list[str]], np.ndarray] = hashed, column: str = "embedding") -> DataFrame:
    """rows with the vector of a text column; null texts have a null vector, and vectors that are not finite become null."""
    fields = [f for f in rows.schema.fields if f.name != column]
    schema = T.StructType([*fields, T.StructField(column, T.ArrayType(T.FloatType()))])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(names.index(text_column)).to_pylist()
            vectors = model([t or "" for t in texts])
            ok = np.isfinite(vectors).all(axis=1)
            cells = pa.array([v if t is not None and good else None for t, v, good in zip(texts, vectors, ok)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in range(len(names))], cells], [*names, column])

    return rows.select(*names).mapInArrow(run, schema)


def backfill(records: DataFrame, model: Callable[[list[str]], np.ndarray] = hashed) -> DataFrame:
    """Records with a vector where they had none, of the first BACKFILL_CHARS characters, as the indexer always did."""
    have = F.coalesce(F.size("embedding") > 0, F.lit(False))
    new = with_embedding(records.where(~have).drop("embedding").withColumn("_text", F.left("content", F.lit(BACKFILL_CHARS))), "_text", model).drop("_text")
    return records.where(have).unionByName(new.select(*records.columns))
