"""Most similar vectors for every vector by an inverted multi-index.

Unit vectors are cut into two halves, each half quantised by its own codebook; a cell is a pair of centroids. A query
visits cells in the order of the summed distance of its halves to the two centroids, taken from a heap with
one entry per first centroid, over occupied cells only, until enough vectors have been offered; these are compared
exactly. Codebooks are fitted on a bounded sample (FIT_ROWS vectors) and grow with the root of the collection, and so does
what a query visits, or recall would fall as the collection grows. Every vector is indexed. Equal vectors are one entry with
its smallest ids: more than K + 1 of them can never be needed.

Cells are grouped into blocks. Cells near to each other in the whole space go into the same block, so that what a query visits
lies in few of them; a cell too large for a block is cut into several by its vectors' digests. A query's vector moves once for
each block it visits. A block that many queries visit is joined in slices, as many as its own queries call for, so the entries
move in proportion to the visits and never by the size of the collection. Only the best K + 1 of a query leave a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import stage

DIMENSIONS = 384
K = 5
LEAST_SIMILARITY = 0.6
TYPES = ("explicit_code", "summary_pointer")
#: Rows the codebooks are fitted on, about.
FIT_ROWS = 16_384
FIT_ROUNDS = 6
#: A query is compared with this many times the root of its collection's entries, at least.
VISIT = 8
#: Entries per cell the number of centroids aims at, and the bounds of that number (its square bounds the cell census).
PER_CELL = 2
CENTROIDS = (4, 1024)
#: Entries of one block, and queries of one slice, about.
BLOCK_ROWS = 24_000
SLICE_ROWS = 48_000
#: Groups of neighbouring cells at most, and vectors by which the queries of a block are estimated.
GROUPS = 512
PROBES = 1000
#: Rows of a product at a time, and hits that may gather before all but the best are dropped.
TILE = 4096
HITS = 4_000_000
#: By how much a similarity in single precision may be off.
LOOSE = 1e-4


def usable(symbols: DataFrame, kind: str = "interface") -> DataFrame:
    """(id, embed_type, embedding) of the kind's rows whose vector has DIMENSIONS finite numbers, not all zero, once per id:
    the one loaded last, and of those the first in order of the vector."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = symbols.select("id", "kind", "embed_type", "embedding", "loaded_at").where((F.col("kind") == kind) & F.col("embed_type").isin(*TYPES) & F.col("id").isNotNull())
    rows = rows.where((F.size("embedding") == DIMENSIONS) & finite & F.exists("embedding", lambda v: v != 0))
    return rows.select("id", "embed_type", "embedding", "loaded_at")


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def _rows(column: pa.Array) -> np.ndarray:
    """The rows of an embedding column."""
    return np.asarray(column.flatten(), np.float32).reshape(-1, DIMENSIONS)


def _vectors(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(-1, DIMENSIONS)


def _single(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision, a tile at a time."""
    out = np.empty_like(raw)
    for s in range(0, len(raw), TILE):
        out[s : s + TILE] = unit(raw[s : s + TILE])
    return out


def means(sample: np.ndarray, centroids: int) -> np.ndarray:
    """Centroids by Lloyd's iteration; starts at rows evenly spaced in the sample."""
    c = sample[np.linspace(0, len(sample) - 1, min(centroids, len(sample))).astype(int)].copy()
    for _ in range(FIT_ROUNDS):
        near = ((c * c).sum(1) - 2 * sample @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def fit(sample: np.ndarray, centroids: int) -> tuple[np.ndarray, np.ndarray]:
    """One codebook per half."""
    one, two = np.split(sample, 2, axis=1)
    return means(one, centroids), means(two, centroids)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (book * book).sum(1) - 2 * x @ book.T


def traverse(d1: np.ndarray, d2: np.ndarray, rows: list[np.ndarray], sizes: np.ndarray, visit: int) -> list[int]:
    """Occupied cells by summed distance until they hold `visit` entries: rows[i] lists the second centroids of the occupied
    cells with first centroid i, sizes[i, j] the entries of a cell."""
    width = sizes.shape[1]
    lists = [None] * len(rows)
    order = np.argsort(d1).tolist()
    floor = float(d2.min())
    first = d1.tolist()
    heap: list[tuple[float, int, int]] = []
    cells, seen, ahead = [], 0, 0
    while seen < visit:
        # A list enters the heap once nothing in it can be nearer than the heap's top.
        while ahead < len(order) and (not heap or first[order[ahead]] + floor <= heap[0][0]):
            i = order[ahead]
            ahead += 1
            if len(rows[i]):
                d = d2[rows[i]]
                by = np.argsort(d)
                lists[i] = (d[by].tolist(), rows[i][by].tolist())
                heapq.heappush(heap, (first[i] + lists[i][0][0], i, 0))
        if not heap:
            break
        _, i, k = heap[0]
        near, seconds = lists[i]
        j = seconds[k]
        cells.append(i * width + j)
        seen += int(sizes[i, j])
        if k + 1 < len(seconds):
            heapq.heapreplace(heap, (first[i] + near[k + 1], i, k + 1))
        else:
            heapq.heappop(heap)
    return cells


_INDEXED = "id string, embed_type string, same binary, cell int, ids array<string>, vec binary"


def _indexed(vectors: DataFrame, books, width: int) -> DataFrame:
    """One row per id with its vector's digest; of each partition's equal vectors the first row also has cell, vector and
    their K + 1 smallest ids, and stands for all of them in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for b in batches:
            if not b.num_rows:
                continue
            raw = _rows(b.column(2))
            x = unit(raw)
            cell = distances(x[:, : DIMENSIONS // 2], one).argmin(1) * width + distances(x[:, DIMENSIONS // 2 :], two).argmin(1)
            found: dict[tuple[str, bytes], tuple[int, list[str]]] = {}
            for k, (i, kind) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                found.setdefault((kind, raw[k].tobytes()), (k, []))[1].append(i)
            vec: list[bytes | None] = [None] * b.num_rows
            ids: list[list[str] | None] = [None] * b.num_rows
            for (_, v), (k, own) in found.items():
                vec[k], ids[k] = v, sorted(set(own))[: K + 1]
            same = [xxhash.xxh3_128_digest(r.tobytes()) for r in raw]
            columns = [b.column(0), b.column(1), pa.array(same, pa.binary()), pa.array(cell.astype(np.int32)), pa.array(ids, pa.list_(pa.string())), pa.array(vec, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _INDEXED.split(", ")])

    return vectors.select("id", "embed_type", "embedding").mapInArrow(run, _INDEXED)


def near_order(occupied: np.ndarray, width: int, books: tuple[np.ndarray, np.ndarray], sample: np.ndarray, groups: int) -> np.ndarray:
    """The occupied cells so that neighbours in the whole space follow each other: by the group whose centre is nearest to
    the cell's, groups in a chain of nearest neighbours."""
    centres = means(sample, groups)
    half = DIMENSIONS // 2
    apart = distances(centres, centres)
    rank, at, left = np.zeros(len(centres), int), 0, np.ones(len(centres), bool)
    for k in range(len(centres)):
        rank[at], left[at] = k, False
        if left.any():
            at = int(np.where(left, apart[at], np.inf).argmin())
    one, two = distances(books[0], centres[:, :half]), distances(books[1], centres[:, half:])
    group = np.concatenate([(one[c // width] + two[c % width]).argmin(1) for c in np.array_split(occupied, len(occupied) // 65_536 + 1)])
    return occupied[np.lexsort((occupied, rank[group]))]


def blocks(sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """By cell: its first block, and over how many it is spread; and the number of blocks. Successive cells of `order` share a
    block of up to BLOCK_ROWS entries; a larger cell has blocks of its own."""
    flat = sizes.ravel()
    begin, wide = np.zeros(len(flat), np.int32), np.ones(len(flat), np.int32)
    block, fill = 0, 0
    for c in order.tolist():
        n = int(flat[c])
        if fill and fill + n > BLOCK_ROWS:
            block, fill = block + 1, 0
        begin[c], wide[c] = block, -(-n // BLOCK_ROWS)
        if n > BLOCK_ROWS:
            block, fill = block + int(wide[c]), 0
        else:
            fill += n
    return begin, wide, block + 1


@dataclass
class Plan:
    """What the workers need of one embed_type's index: entries per cell, where each cell's block is, and the slices of each block."""

    sizes: np.ndarray
    begin: np.ndarray
    wide: np.ndarray
    slices: np.ndarray
    visit: int

    def listed(self) -> list[np.ndarray]:
        return [np.flatnonzero(r) for r in self.sizes]

    def visits(self, d1: np.ndarray, d2: np.ndarray, listed: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """The blocks a query visits, with the cells it visits there."""
        cells = np.array(traverse(d1, d2, listed, self.sizes, self.visit), np.int32)
        where, several = self.begin[cells], self.wide[cells]
        for lane in range(int(several.max(initial=0))):
            mine = cells[several > lane]
            here = where[several > lane] + lane
            for w in np.unique(here).tolist():
                yield w, mine[here == w]


def planned(sizes: np.ndarray, width: int, books: tuple[np.ndarray, np.ndarray], sample: np.ndarray, visit: int | None) -> Plan:
    """The plan of one type's index. The slices of a block follow the share of PROBES sampled vectors that visit it: if it is off,
    slices are larger or smaller, and the result is the same."""
    total = int(sizes.sum())
    occupied = np.flatnonzero(sizes.ravel())
    order = near_order(occupied, width, books, sample, min(GROUPS, -(-total // BLOCK_ROWS)))
    begin, wide, count = blocks(sizes, order)
    plan = Plan(sizes.astype(np.int32), begin, wide, np.ones(count, np.int32), visit or max(1, int(VISIT * total**0.5)))
    probes = sample[:: max(1, len(sample) // PROBES)]
    d1, d2 = distances(probes[:, : DIMENSIONS // 2], books[0]), distances(probes[:, DIMENSIONS // 2 :], books[1])
    asked, listed = np.zeros(count, np.int64), plan.listed()
    for k in range(len(probes)):
        for w, _ in plan.visits(d1[k], d2[k], listed):
            asked[w] += 1
    plan.slices = np.maximum(1, -(-asked * total // (len(probes) * SLICE_ROWS))).astype(np.int32)
    return plan


def _best(ids: list[list[str]], sims: np.ndarray) -> list[tuple[str, float]]:
    """The K + 1 best (id, similarity): most similar first, then the smaller id."""
    rows = sorted(((-s, i) for s, own in zip(sims.tolist(), ids) for i in own))[: K + 1]
    return [(i, -s) for s, i in rows]


class Hits:
    """(query, entry, similarity in single precision), of each query no fewer than the K + 1 best."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, q: np.ndarray, e: np.ndarray, near: np.ndarray) -> None:
        self.parts.append((q, e, near))
        self.held += len(q)
        if self.held > HITS:
            self.parts = [self.kept()]
            self.held = 0  # so many may be ties that stay; the next cut comes after as many new ones

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What may still be among the K + 1 best, in the order of the queries."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        q, e, near = (np.concatenate(c) for c in zip(*self.parts))
        by = np.lexsort((-near, q))
        q, e, near = q[by], e[by], near[by]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        lengths = np.diff(np.r_[starts, len(q)])
        last = near[starts + np.minimum(lengths, K + 1) - 1]
        ok = near >= np.repeat(last, lengths) - LOOSE
        return q[ok], e[ok], near[ok]


def compared(queries: np.ndarray, cells_of: tuple[np.ndarray, np.ndarray], entries: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, similarity) of what may be among each query's K + 1 best, in double precision, in the order of the queries.
    cells_of: each query's visits as (query, cell); cells: the entries' cells, sorted."""
    x, y, hits = _single(queries), _single(entries), Hits()
    query_of, cell_of = cells_of
    by = np.argsort(cell_of, kind="stable")
    cell_of, query_of = cell_of[by], query_of[by]
    starts = np.flatnonzero(np.r_[True, cell_of[1:] != cell_of[:-1]]) if len(cell_of) else np.zeros(0, int)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(cell_of)]):
        lo, hi = np.searchsorted(cells, [cell_of[a], cell_of[a] + 1])
        for s in range(a, b, TILE):
            who = query_of[s : min(b, s + TILE)]
            for t in range(lo, hi, TILE):
                near = x[who] @ y[t : min(hi, t + TILE)].T
                mask = near >= LEAST_SIMILARITY - LOOSE
                if near.shape[1] > K + 1 and mask.sum() > 2 * (K + 1) * len(who):
                    last = np.partition(near, near.shape[1] - K - 1, axis=1)[:, near.shape[1] - K - 1]
                    mask &= near >= last[:, None] - LOOSE
                r, c = np.nonzero(mask)
                if len(r):
                    hits.add(who[r], c + t, near[r, c])
    q, e, _ = hits.kept()
    sims = np.concatenate([np.round(np.einsum("ij,ij->i", unit(queries[q[s : s + TILE]]), unit(entries[e[s : s + TILE]])), 6) for s in range(0, len(q), TILE)] or [np.zeros(0)])
    keep = sims >= LEAST_SIMILARITY
    return q[keep], e[keep], sims[keep]


_OUT = "embed_type string, same binary, near array<struct<id:string,similarity:double>>"


def _joined(queries: pa.Table, entries: pa.Table) -> pa.Table:
    """The best K + 1 entries of a block for each query, among the cells it visits."""
    out: list[list] = [[], [], []]
    if queries.num_rows and entries.num_rows:
        merged: dict[bytes, tuple[int, set[str]]] = {}
        for k, (same, ids) in enumerate(zip(entries["same"].to_pylist(), entries["ids"].to_pylist())):
            merged.setdefault(same, (k, set()))[1].update(ids)
        first = np.array([k for k, _ in merged.values()])
        cells = np.asarray(entries["cell"])[first]
        by = np.argsort(cells, kind="stable")
        names = [sorted(i)[: K + 1] for _, i in merged.values()]
        names = [names[k] for k in by]
        kind = entries["embed_type"][0].as_py()
        asked, visits = queries["same"].to_pylist(), queries["cells"].combine_chunks()
        seen = np.repeat(np.arange(len(asked)), np.diff(np.asarray(visits.offsets))), np.asarray(visits.flatten())
        q, e, sims = compared(_vectors(queries["vec"].to_pylist()), seen, _vectors(entries["vec"].to_pylist())[first[by]], cells[by])
        cut = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(q)]):
            out[0].append(kind)
            out[1].append(asked[q[a]])
            out[2].append([{"id": i, "similarity": s} for i, s in _best([names[k] for k in e[a:b].tolist()], sims[a:b])])
    near = pa.list_(pa.struct([("id", pa.string()), ("similarity", pa.float64())]))
    return pa.table({"embed_type": pa.array(out[0], pa.string()), "same": pa.array(out[1], pa.binary()), "near": pa.array(out[2], near)})


def _spread(same: list[bytes]) -> np.ndarray:
    """A number per digest, by which equal vectors go the same way."""
    return np.frombuffer(b"".join(s[:8] for s in same), np.uint64)


_ASKED = "embed_type string, block int, slice int, cells array<int>, same binary, vec binary"
_HELD = "embed_type string, block int, slice int, cell int, ids array<string>, same binary, vec binary"


def _asking(plans, books):
    """Entries as queries: a row for each block a query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c1, c2 = books.value
        listed = {t: p.listed() for t, p in plans.value.items()}
        for b in batches:
            for s in range(0, b.num_rows, TILE):
                kinds, same, raw = (c.to_pylist() for c in b.slice(s, TILE).select(["embed_type", "same", "vec"]).columns)
                u, spread = unit(_vectors(raw)), _spread(same)
                d1, d2 = distances(u[:, : DIMENSIONS // 2], c1), distances(u[:, DIMENSIONS // 2 :], c2)
                out: list[list] = [[], [], [], [], [], []]
                for k, t in enumerate(kinds):
                    p = plans.value[t]
                    for w, cells in p.visits(d1[k], d2[k], listed[t]):
                        for column, v in zip(out, (t, w, int(spread[k] % np.uint64(p.slices[w])), cells, same[k], raw[k])):
                            column.append(v)
                types = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)], [c.split(" ")[0] for c in _ASKED.split(", ")])

    return run


def _holding(plans):
    """Entries in their blocks: a row for each slice of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cells, spread = np.asarray(b.column("cell")), _spread(b.column("same").to_pylist())
            kinds = np.asarray(b.column("embed_type").to_pylist(), object)
            block, slices = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
            for t, p in plans.value.items():
                at = np.flatnonzero(kinds == t)
                block[at] = p.begin[cells[at]] + (spread[at] // np.uint64(7) % p.wide[cells[at]].astype(np.uint64)).astype(np.int32)
                slices[at] = p.slices[block[at]]
            row = np.repeat(np.arange(b.num_rows), slices)
            number = np.arange(len(row)) - np.repeat(np.cumsum(slices) - slices, slices)
            copied = b.take(pa.array(row))
            columns = [copied.column("embed_type"), pa.array(block[row]), pa.array(number.astype(np.int32)), *(copied.column(c) for c in ("cell", "ids", "same", "vec"))]
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _HELD.split(", ")])

    return run


def neighbours(symbols: DataFrame, kind: str = "interface", visit: int | None = None) -> DataFrame:
    """(id, neighbour, similarity, rank): for each usable vector of the kind up to K others of the same embed_type with a cosine of
    LEAST_SIMILARITY or more, most similar first, ties by the smaller id; the cosine is of double precision, rounded to six decimals.

    visit: how many entries a query is compared with, at least; VISIT times the root of its type's entries by default. As many as
    there are make the search exact. Vectors that are null, of another length, not finite or all zero, and other embed_types, are
    left out; repeated ids count once (the row loaded last); an empty table gives no rows. What is found is exact; up to the
    index's recall, which the tests hold above 0.9 against brute force, all is found.
    """
    spark = symbols.sparkSession
    rows = usable(symbols, kind)
    newest = rows.groupBy("id").agg(F.max(F.struct(F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), F.xxhash64("embedding", "embed_type").alias("h"))).alias("n"), F.count("*").alias("times"))
    doubled = stage(newest.where("times > 1").select("id", F.col("n.t").alias("t"), F.col("n.h").alias("h")), "doubled")
    # Only ids that stand there more than once need a choice; the vectors of the others are not moved for it.
    kept = rows.join(doubled, "id", "left").where("h is null or (h = xxhash64(embedding, embed_type) and t = coalesce(loaded_at, cast('0001-01-01' as timestamp_ntz)))")
    kept = kept.select("id", "embed_type", "embedding")
    total = rows.count()
    schema = "id string, neighbour string, similarity double, rank int"
    if not total:
        return spark.createDataFrame([], schema)
    # About FIT_ROWS vectors, by a hash of their ids, come to the driver, whatever the collection.
    drawn = kept.where(F.xxhash64("id") / float(1 << 63) < 2 * FIT_ROWS / total - 1) if total > FIT_ROWS else kept
    sample = unit(_rows(drawn.select("embedding").toArrow()["embedding"].combine_chunks()))
    width = int(np.clip(2 ** np.round(np.log2(max(1.0, (total / PER_CELL) ** 0.5))), *CENTROIDS))
    one, two = fit(sample, width)
    width = max(len(one), len(two))
    books = spark.sparkContext.broadcast((one, two))
    indexed = stage(_indexed(kept, books, width), "indexed")
    entries = indexed.where("vec is not null").select("embed_type", "cell", "ids", "same", "vec")
    # One row per occupied cell and type, at most 2 x CENTROIDS[1]^2 whatever the collection.
    census = entries.groupBy("embed_type", "cell").agg(F.count("*").alias("n")).toArrow()
    plans = {}
    for t in TYPES:
        here = census.filter(pc.equal(census["embed_type"], t))
        sizes = np.bincount(np.asarray(here["cell"]), np.asarray(here["n"]), width * width).astype(np.int64).reshape(width, width)
        if here.num_rows:
            plans[t] = planned(sizes, width, (one, two), sample, visit)
    plans = spark.sparkContext.broadcast(plans)
    queries = entries.select("embed_type", "same", "vec").mapInArrow(_asking(plans, books), _ASKED)
    held = entries.mapInArrow(_holding(plans), _HELD)
    keys = ["embed_type", "block", "slice"]
    part = stage(queries.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_joined, _OUT), "near")
    ids = indexed.select("id", "embed_type", "same")
    each = ids.join(part, ["embed_type", "same"]).select("id", F.explode("near").alias("n")).where("n.id <> id")
    ordered = each.select("id", F.col("n.id").alias("neighbour"), F.col("n.similarity").alias("similarity")).distinct()
    back = ordered.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"), "similarity")
    both = ordered.unionByName(back).distinct()  # who was found finds
    ranked = both.withColumn("rank", F.expr("row_number() over (partition by id order by similarity desc, neighbour)").cast("int"))
    return ranked.where(F.col("rank") <= K)


def pairs(near: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first: pairs of which at least one is among the other's neighbours."""
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
