"""Functions over vectors, as Column expressions in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The smallest magnitude that makes a single-precision vector count as not zero.
EPSILON = 1.1920929e-7


def literal(vector) -> Column:
    """A vector as a column, in one call to the JVM."""
    return F.expr("array(" + ", ".join(f"double('{float(v)!r}')" for v in vector) + ")")


def similarity(column: Column, query) -> Column:
    """The cosine of each vector with one query vector, held to 0..1: null for a null vector, one of another length, and one that is not
    finite, 0 where either is zero. An Arrow batch is one matrix product in double precision."""
    q = np.asarray(query, np.float64)
    length = float(np.sqrt(q @ q))

    @F.arrow_udf("double")
    def scored(vectors: pa.Array) -> pa.Array:
        n = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1))
        fit = np.flatnonzero(n == len(q)) if len(q) else np.zeros(0, int)
        out, known = np.zeros(len(vectors)), np.zeros(len(vectors), bool)
        if len(fit):
            flat = vectors.take(pa.array(fit)).flatten()
            x = np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))).reshape(-1, len(q))
            finite = np.isfinite(x).all(axis=1)
            fit, x = fit[finite], x[finite]
            lengths = np.sqrt((x * x).sum(axis=1)) * length
            with np.errstate(invalid="ignore", divide="ignore"):
                cosine = np.where(lengths > 0, (x @ q) / lengths, 0.0)
            known[fit], out[fit] = np.isfinite(cosine), np.clip(np.nan_to_num(cosine), 0.0, 1.0)
        return pa.array(out, mask=~known)

    return scored(column)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; 0 for null or empty vectors, unlike lengths, and a zero vector."""
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    lengths = norm(a) * norm(b)
    return F.when(same & (lengths > 0), dot(a, b) / lengths).otherwise(F.lit(0.0))


def is_finite(a: Column) -> Column:
    """Are all entries finite numbers? True for an empty vector, null for null."""
    return F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def is_meaningful(a: Column) -> Column:
    """Has any entry a magnitude above EPSILON? False for null and empty vectors."""
    return F.coalesce(F.exists(a, lambda v: F.abs(v) > EPSILON), F.lit(False))


def score(similarity: Column) -> Column:
    """A similarity held to 0..1; null where it is no number, so that a filter drops it before any ordering."""
    return F.when(F.isnan(similarity), None).otherwise(F.greatest(F.least(similarity, F.lit(1.0)), F.lit(0.0)))
