"""What rows of each table must satisfy, and the split into good and bad ones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import vector
from loomgraph.sources.model import EDGE_TYPES, KINDS

Rule = tuple[str, Column]


def filled(column: str) -> Rule:
    return f"{column} is empty", F.col(column).isNotNull() & (F.col(column) != "")


def at_least(column: str, least: int) -> Rule:
    return f"{column} below {least}", F.col(column).isNotNull() & (F.col(column) >= least)


def one_of(column: str, values: Iterable[str]) -> Rule:
    return f"{column} unknown", F.coalesce(F.col(column).isin(*values), F.lit(False))


def finite(column: str) -> Rule:
    return f"{column} not finite", F.col(column).isNull() | F.coalesce(vector.is_finite(F.col(column)), F.lit(False))


# The conditions of the record tables.
RULES = {
    "code_file": lambda: [filled("path"), filled("language"), filled("content_hash"), at_least("size_bytes", 0)],
    "symbols": lambda: [filled("name"), filled("file_path"), at_least("line_start", 1), at_least("line_end", 1), at_least("token_count", 0), one_of("kind", KINDS), one_of("embed_type", ("explicit_code", "summary_pointer")), finite("embedding")],
    "edges": lambda: [filled("src"), filled("dst"), one_of("edge_type", EDGE_TYPES)],
}


def judged(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with `faults`: the names of the rules that a row breaks."""
    return df.withColumn("faults", F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules])))


def split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy all rules, the others with their faults)."""
    j = judged(df, rules)
    return j.where(F.size("faults") == 0).drop("faults"), j.where(F.size("faults") > 0)


def fault_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """fault, n: how many rows break each rule."""
    return judged(df, rules).select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))
