"""Groups of near-duplicate function bodies: a multi-index Hamming join over b-bit signatures.

A body's signature has SYMBOLS min-hashes of its three-token shingles, BITS bits each; its distance to another is
the number of unlike symbols. By the pigeonhole principle, of CHUNKS chunks one has at most floor(distance / CHUNKS)
unlike symbols, so with one error allowed per chunk every pair within 2 x CHUNKS - 1 unlike symbols meets: a
chunk's variants with one symbol left out are its keys. (Pairs at a similarity of 0.7 meet with probability 0.9998 whatever their
distance, as unlike symbols need not be spread evenly.) Of pairs that meet, those with fewer than LEAST_EQUAL equal symbols are
dropped on the signatures (at a similarity of 0.7 that is one in a million), the others are verified on the shingles themselves.

No bucket is expanded to all its pairs. Its members are compared with one of them; what that puts into one group
needs no more comparison. Members of a bucket of up to HOT that are still in different groups are compared pair by pair.
A larger bucket stands for a chunk that unlike bodies have in common, such as boilerplate. Its members meet again by their
rare shingles: in any one order of all shingles, the first of those that two alike bodies share is among the first
size - ceil(size x SIMILAR) + 1 of either, so those are a body's keys, rarest first. That loses no alike pair, and boilerplate, which
comes last, brings none together. What meets there is treated as before, but compared in full, however many meet.
groups(hot=None) takes no such way and compares all.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.components import components, merged
from loomgraph.llm.words import CODE_WORDS, flat_words, grams, mixed
from loomgraph.llm.spans import paired
from loomgraph.session import bucketed, stage, tasks

SHINGLE = 3
SIMILAR = (7, 10)  # as a fraction, so that the comparison is exact
CHUNKS = 8
WIDTH = 4
SYMBOLS = CHUNKS * WIDTH
BITS = 16
#: Equal symbols of two signatures from which on their bodies are compared.
LEAST_EQUAL = 10
#: Members of a bucket up to which they are compared pair by pair; those of larger ones meet by their rare shingles.
HOT = 256
#: Keys a bucket of the key table has room for, about.
BUCKET_KEYS = 8_000_000

_SEEDS = mixed(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the texts that have shingles, and their signatures (a row of SYMBOLS numbers each)."""
    words, ends = flat_words(texts, CODE_WORDS, False)
    g, at = grams(words, ends, SHINGLE)
    if not len(g):
        return np.zeros(0, np.int64), np.zeros((0, SYMBOLS), np.uint64)
    owner = np.searchsorted(ends, at, side="right") - 1
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    out = np.empty((len(first), SYMBOLS), np.uint64)
    for k, seed in enumerate(_SEEDS):
        h = g * seed
        h ^= h >> np.uint64(31)
        out[:, k] = np.minimum.reduceat(h, first)
    return owner[first], mixed(out) >> np.uint64(64 - BITS)


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """The keys of each signature: per chunk, each choice of all symbols but one, with chunk and gap in the key."""
    keys = []
    for c in range(CHUNKS):
        part = signature[:, c * WIDTH : (c + 1) * WIDTH]
        for gap in range(WIDTH):
            key = np.full(len(part), c * WIDTH + gap, np.uint64)
            for s in range(WIDTH):
                if s != gap:
                    key = (key << np.uint64(BITS)) | part[:, s]
            keys.append(key)
    return np.stack(keys, 1) if keys else np.zeros((0, 0), np.uint64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 2000):
            part = b.slice(s, 2000)
            texts = part.column(1).to_pylist()
            at, sig = signatures(texts)
            raw: list[bytes | None] = [None] * len(texts)
            for i, row in zip(at.tolist(), sig.astype("<u2")):
                raw[i] = row.tobytes()
            same = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(same, pa.binary()), pa.array(raw, pa.binary())], ["fn_id", "same", "sig"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, SYMBOLS).astype(np.uint64)
            keys = chunk_keys(sig)
            owner = np.repeat(np.asarray(b.column(0)), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(owner)], ["key", "rep"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (rep, body) a row (key, rep, size) per shingle of the body; size is the number of its shingles."""
    for b in batches:
        for s in range(0, b.num_rows, 500):
            part = b.slice(s, 500)
            words, ends = flat_words(part.column(1).to_pylist(), CODE_WORDS, False)
            g, at = grams(words, ends, SHINGLE)
            owner = np.searchsorted(ends, at, side="right") - 1
            order = np.lexsort((g, owner))
            g, owner = g[order], owner[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
            g, owner = g[new], owner[new]
            sizes = np.bincount(owner, minlength=part.num_rows)[owner].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), part.column(0).take(pa.array(owner)), pa.array(sizes)], ["key", "rep", "size"])


def shingles(text: str) -> set[tuple[str, ...]]:
    t = CODE_WORDS.findall(text)
    return set(zip(t, t[1:], t[2:]))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c, keep, last, own = b.column(0), b.column(1), [], None, None
        for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            if s != last:
                last, own = s, shingles(s)
            other = shingles(t)
            common = len(own & other)
            keep.append(common > 0 and common * SIMILAR[1] >= SIMILAR[0] * (len(own) + len(other) - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), c.filter(mask)], ["a", "b"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, sig_a, sig_b) the pairs with at least LEAST_EQUAL equal symbols."""
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, SYMBOLS) for c in b.columns[2:])
            mask = pa.array((x == y).sum(1) >= LEAST_EQUAL)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])


def _texts(bodies: DataFrame, used: DataFrame) -> DataFrame:
    """(fn_id, body) of the ids in `used`, one body each."""
    return bodies.join(used, "fn_id").groupBy("fn_id").agg(F.min_by("body", F.sha2("body", 256)).alias("body"))


def _verified(pairs: DataFrame, bodies: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bodies are alike: by their signatures first, so that no body moves for others, then on the shingles."""
    left, right = (signed.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}")) for c in ("a", "b"))
    pairs = stage(stage(pairs, "met").join(right, "b").join(left, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(_near, "a long, b long"), "pairs")
    used = pairs.select(F.col("a").alias("fn_id")).unionByName(pairs.select(F.col("b").alias("fn_id"))).distinct()
    texts = stage(_texts(bodies, used), "bodies")
    left = texts.select(F.col("fn_id").alias("a"), F.col("body").alias("body_a"))
    right = texts.select(F.col("fn_id").alias("b"), F.col("body").alias("body_b"))
    wide = pairs.join(right, "b").join(left, "a").select("a", "b", "body_a", "body_b")
    return stage(wide.mapInArrow(_alike, "a long, b long"), "alike")


def _rare(reps: DataFrame, bodies: DataFrame) -> DataFrame:
    """Rows (key, rep) of the shingles by which the bodies of `reps` meet: of each the rarest among them, as many as it takes for
    alike ones to have one in common. Shingles of one body alone come first in the order, but need no row."""
    rows = stage(_texts(bodies, reps.select(F.col("rep").alias("fn_id"))).mapInArrow(_shingled, "key long, rep long, size int"), "shingles")
    times = rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    by = W.partitionBy("rep")
    placed = rows.join(times, "key").withColumns({"place": F.row_number().over(by.orderBy("times", "key")), "held": F.count("*").over(by)})
    return placed.where(f"place <= held + 1 - ({SIMILAR[0]} * size + {SIMILAR[1] - 1}) div {SIMILAR[1]}").select("key", "rep")


def groups(functions: DataFrame, hot: int | None = HOT) -> DataFrame:
    """(fn_id, group_id), one row per function that is alike another, directly or through a chain; group_id is the
    smallest fn_id of the group.

    Bodies are alike when they are equal, or at least SIMILAR of the union of their three-token shingles is common;
    a body of fewer than three tokens is alike equal ones only. body_hash is not trusted. Null bodies belong to no
    group, an empty body to that of the other empty ones; repeated rows count once (of several bodies of one fn_id that of the
    smallest SHA-256); an empty table gives no rows. hot: members of a bucket up to which all are compared, those of larger ones
    where they have a rare shingle in common; None compares all, however many.
    """
    bodies = functions.select("fn_id", "body").where("fn_id is not null and body is not null")
    signed = stage(bodies.mapInArrow(_signed, "fn_id long, same binary, sig binary"), "signatures")
    once = signed.groupBy("fn_id").agg(F.min(F.struct("same", "sig")).alias("s")).select("fn_id", "s.same", "s.sig")
    copies = stage(once.groupBy("same").agg(F.min("fn_id").alias("rep"), F.first("sig").alias("sig"), F.count("*").alias("n")), "copies")
    signs = copies.where("sig is not null").select("rep", "sig")
    buckets = max(tasks(functions.sparkSession), signs.count() * CHUNKS * WIDTH // BUCKET_KEYS + 1)
    # Bucketed and sorted by key: neither the grouping nor the join below moves a key.
    keyed = bucketed(signs.select("rep", "sig").mapInArrow(_keys, "key long, rep long"), f"near_{uuid.uuid4().hex[:12]}", "key", buckets)
    shared = keyed.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("key")
    met = stage(keyed.hint("merge").join(shared, "key").select("key", "rep"), "buckets")
    joined, tried, rest = None, None, None
    for limit in (hot, None):
        centres = met.groupBy("key").agg(F.min("rep").alias("a"))
        stars = met.join(centres, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
        stars = stage(stars if tried is None else stars.join(tried, ["a", "b"], "left_anti"), "stars")
        tried = stars if tried is None else tried.unionByName(stars)
        sure = _verified(stars, bodies, signs)
        joined = components(sure) if joined is None else merged(joined, sure)
        placed = met.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("part"))
        unsettled = placed.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("n")).where("least < most").select("key", "n")
        apart = stage(placed.join(unsettled, "key"), "apart")
        large = F.col("n") > limit if limit is not None else F.lit(False)
        few = apart.where(~large).select("key", "rep")
        rest = few if rest is None else rest.unionByName(few)
        crowded = apart.where(large).select("rep").distinct()
        if limit is None or crowded.isEmpty():
            break
        met = stage(_rare(crowded, bodies), "rare")
    pairs = paired(rest, "key", "rep").distinct()
    pairs = pairs.join(joined.select(F.col("node").alias("a"), F.col("component").alias("p")), "a", "left").join(joined.select(F.col("node").alias("b"), F.col("component").alias("q")), "b", "left")
    more = _verified(pairs.where("not coalesce(p = q, false)").select("a", "b").join(tried, ["a", "b"], "left_anti"), bodies, signs)
    joined = merged(joined, more)
    reps = copies.join(joined.withColumnRenamed("node", "rep"), "rep", "left").where("component is not null or n > 1").select("same", F.coalesce("component", "rep").alias("group_id"))
    return once.select("fn_id", "same").join(reps, "same").select("fn_id", "group_id")


def found(functions: DataFrame) -> DataFrame:
    """(fn_id_a, fn_id_b), smaller first: the pairs of functions in one group."""
    return paired(stage(groups(functions), "members"), "group_id", "fn_id").select(F.col("a").alias("fn_id_a"), F.col("b").alias("fn_id_b"))
