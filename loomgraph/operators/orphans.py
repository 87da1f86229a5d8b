"""References to records that are not there: range-partitioned keys, sorted parent arrays, binary search.

Keys are placed on a line by a 64-bit hash and cut into equal ranges, so ranges are even without sampling; there are as many
as the references call for. A range that more references fall into than a task should hold (a hot id) is cut again into lanes, by
the measured count; its parents, which are as few as any range's, go to every lane. Each task gets one lane: the parents as
arrays sorted by hash and id, the references as one Arrow batch, probed by binary search over the hashes and told apart by
the ids. Only misses leave the task.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import stage

LEAST_BITS = 4
LANE_ROWS = 150_000

_FOREVER = np.iinfo(np.int64).max


def references(edges: DataFrame) -> DataFrame:
    """Both ends of each edge as rows (edge_id, ref_end, ref_id, created_at); null and blank ends are no references."""
    ends = F.array(
        F.struct(F.lit("src").alias("ref_end"), F.col("src").alias("ref_id")),
        F.struct(F.lit("dst").alias("ref_end"), F.col("dst").alias("ref_id")),
    )
    return (
        edges.select("edge_id", "created_at", F.explode(ends).alias("e"))
        .select("edge_id", "e.ref_end", "e.ref_id", "created_at")
        .where(F.col("ref_id").rlike(r"\S"))
    )


def parents(tables: Iterable[DataFrame]) -> DataFrame:
    """The rows (id, loaded_at, deleted_at) of all referenced tables; rows without an id are left out."""
    rows = [t.select("id", "loaded_at", "deleted_at").where("id is not null") for t in tables]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _micros(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    null = np.asarray(column.is_null())
    return np.asarray(column.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(0)).copy(), null


class Keys:
    """Distinct ids as arrays sorted by hash and id."""

    def __init__(self, hashes: np.ndarray, ids: pa.Array):
        """Both in the order of hash and id."""
        unlike = np.asarray(pc.not_equal(ids[1:], ids[:-1])) if len(ids) > 1 else np.zeros(0, bool)
        first = np.r_[True, (hashes[1:] != hashes[:-1]) | unlike] if len(ids) else np.zeros(0, bool)
        self.number = np.cumsum(first) - 1  # of each row's id
        self.hashes, self.ids = hashes[first], ids.filter(pa.array(first))

    def find(self, hashes: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each id, and whether it is there."""
        at = np.searchsorted(self.hashes, hashes)
        there = np.zeros(len(at), bool)
        open_ = np.arange(len(at))
        while len(open_):  # a second round only for hashes that several ids have
            open_ = open_[at[open_] < len(self.hashes)]
            open_ = open_[self.hashes[at[open_]] == hashes[open_]]
            same = np.asarray(pc.equal(self.ids.take(pa.array(at[open_])), ids.take(pa.array(open_))))
            there[open_[same]] = True
            open_ = open_[~same]
            at[open_] += 1
        return np.minimum(at, max(len(self.hashes) - 1, 0)), there


def _probe(refs: pa.Table, known: pa.Table) -> pa.Table:
    """The misses among refs, with their state."""
    state = np.full(refs.num_rows, "missing", dtype=object)
    if known.num_rows and refs.num_rows:
        known = known.take(pc.sort_indices(known, sort_keys=[("hash", "ascending"), ("id", "ascending")]))
        keys = Keys(np.asarray(known["hash"]), known["id"].combine_chunks())
        ids = keys.number
        loaded, no_load = _micros(known["loaded_at"])
        deleted, no_end = _micros(known["deleted_at"])
        deleted[no_end] = _FOREVER
        ids, loaded, deleted = ids[~no_load], loaded[~no_load], deleted[~no_load]
        asked, no_time = _micros(refs["created_at"])
        times = np.unique(loaded)
        width = len(times) + 1
        place = ids * width + np.searchsorted(times, loaded) + 1
        order = np.lexsort((deleted, place))
        place, deleted, owner = place[order], deleted[order], ids[order]
        latest = deleted.copy()  # of each id, the latest end so far
        first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        lengths = np.diff(np.r_[starts, len(owner)])
        for a, n in zip(starts[lengths > 1].tolist(), lengths[lengths > 1].tolist()):
            latest[a : a + n] = np.maximum.accumulate(deleted[a : a + n])
        at, there = keys.find(np.asarray(refs["hash"]), refs["ref_id"].combine_chunks())
        rank = np.searchsorted(times, asked, side="right")
        last = np.searchsorted(place, at * width + rank, side="right") - 1
        seen = there & (last >= 0)
        if len(owner):
            seen &= owner[np.maximum(last, 0)] == at
            alive = seen & (latest[np.maximum(last, 0)] > asked)
        else:
            alive = seen = np.zeros(len(at), bool)
        state[there] = np.where(seen[there], "deleted", "late")
        state[there & (alive | no_time)] = ""
    miss = state != ""
    kept = refs.filter(pa.array(miss))
    return pa.table(
        {
            "edge_id": kept["edge_id"],
            "ref_end": kept["ref_end"],
            "ref_id": kept["ref_id"],
            "created_at": kept["created_at"],
            "ref_state": pa.array(state[miss], pa.string()),
        }
    )


def orphans(edges: DataFrame, tables: Iterable[DataFrame], lane_rows: int = LANE_ROWS) -> DataFrame:
    """References whose record is not there at the edge's time.

    edges needs edge_id, src, dst, created_at; each table id, loaded_at, deleted_at; other columns are ignored.
    Result: edge_id, ref_end, ref_table, period, ref_state, once for each edge and end, also where an edge was delivered twice.
    Null and blank ends are no references. created_at null: the end is fine if any row has the id, and the
    period is `none`. A record without loaded_at never covers a time, but its id exists. Empty edges give no
    rows; empty tables make every reference `missing`.
    """
    refs = references(edges).withColumn("hash", F.xxhash64("ref_id"))
    bits = max(LEAST_BITS, (2 * edges.count() // lane_rows).bit_length())
    cell = F.shiftrightunsigned("hash", 64 - bits).alias("cell")
    # Ranges that are too full for a task; their list is written, so that its size decides how it is joined.
    hot = stage(refs.groupBy(cell).agg(F.ceil(F.count("*") / lane_rows).cast("int").alias("lanes")).where("lanes > 1"), "hot")
    lanes = F.coalesce("lanes", F.lit(1))
    refs = refs.withColumn("cell", cell).join(hot, "cell", "left").withColumn("lane", F.pmod(F.xxhash64("edge_id", "ref_end"), lanes).cast("int")).drop("lanes")
    known = (
        parents(tables)
        .withColumn("hash", F.xxhash64("id"))
        .withColumn("cell", cell)
        .join(hot, "cell", "left")
        .withColumn("lane", F.explode(F.sequence(F.lit(0), lanes - 1)))
        .select("id", "hash", "loaded_at", "deleted_at", "cell", "lane")
    )
    missed = (
        refs.groupBy("cell", "lane")
        .cogroup(known.groupBy("cell", "lane"))
        .applyInArrow(_probe, "edge_id long, ref_end string, ref_id string, created_at timestamp_ntz, ref_state string")
    )
    table = F.when(F.instr("ref_id", ":") > 0, F.substring_index("ref_id", ":", 1)).otherwise(F.lit("unknown"))
    return missed.select(
        "edge_id",
        "ref_end",
        table.alias("ref_table"),
        F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("none")).alias("period"),
        "ref_state",
    ).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Misses counted by referenced table, period and state."""
    return found.groupBy("ref_table", "period", "ref_state").agg(F.count("*").alias("refs"), F.countDistinct("edge_id").alias("edges"))
