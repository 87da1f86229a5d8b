"""Evaluation passages in a training corpus: n-gram seeds, then Smith-Waterman alignment.

1. Items are cut into grams of SEED words (shorter items are one gram). A bitmap over the gram hashes goes to all workers. It has
   some 16 bits for each gram, and never more than 2^BITMAP_BITS (4 MB): beyond, more places pass it, and the join is what counts.
2. One pass over the corpus puts out the places whose gram is in the bitmap; a join with the items' grams makes that
   exact. Their counts are the grams' frequencies in the corpus.
3. Of each window of RUN successive item words, the rarest gram is a seed. A text that holds the window holds its
   seed, so no run of RUN words is lost; and a phrase that half the corpus shares is a seed only where a whole window
   of nothing rarer exists.
4. Edited copies may hold no whole window, and what is rare in the corpus says nothing of them: for these every gram
   is a seed, however frequent.
5. Each pair of a document and an item that share a seed is aligned once, word by word, around the seeds. Where no
   window's seed is shared there is no run of RUN words, and pairs with fewer common words than a copy needs are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import LETTERS_DIGITS, flat_words, grams
from loomgraph.session import stage

SEED = 5
RUN = 12
BITMAP_BITS = 25
#: An alignment counts as an edited copy from this share of the item's words up.
EDITED = 0.6
MATCH, MISMATCH, GAP = 1, -1, -1


def _item_grams(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            words, ends = flat_words(b.column(1).to_pylist(), LETTERS_DIGITS, True)
            rows: list[list] = [[], [], [], []]
            for k, item in enumerate(ids):
                w = words[ends[k] : ends[k + 1]]
                if len(w):
                    n = min(seed, len(w))
                    g, at = grams(w, np.array([0, len(w)]), n)
                    rows[0] += [item] * len(g)
                    rows[1] += g.view(np.int64).tolist()
                    rows[2] += at.tolist()
                    rows[3] += [n] * len(g)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int32())], ["item_id", "gram", "pos", "size"])

    return run


def marked(packed: np.ndarray, bits: int, gram: np.ndarray) -> np.ndarray:
    """Which grams' bits are set in a packed bitmap of 2^bits."""
    at = (gram.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _texts(df: DataFrame, key: str) -> DataFrame:
    """(key, text) once per key: the smallest text of a repeated key; rows without key or text are left out."""
    return df.select(F.col(key), "text").where(f"{key} is not null and text is not null and text <> ''").groupBy(key).agg(F.min("text").alias("text"))


def seeds(documents: DataFrame, items: DataFrame, edited: bool = True, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, item_id, first, last, whole): document and item that share a seed, with the first and last word at which
    one stands in the document, and whether it is a window's; without `edited` only those; and the items (item_id, text)."""
    spark = documents.sparkSession
    texts = stage(_texts(items, "item_id"), "items")
    known = stage(texts.mapInArrow(_item_grams(seed), "item_id long, gram long, pos int, size int"), "item_grams")
    bits = min(BITMAP_BITS, max(16, (16 * known.count()).bit_length()))
    here = known.select(F.shiftrightunsigned("gram", 64 - bits).cast("int").alias("bit")).distinct().toArrow()["bit"].to_numpy()
    bitmap = np.zeros(1 << bits, bool)  # no more numbers than that come to the driver
    bitmap[here] = True
    packed = spark.sparkContext.broadcast(np.packbits(bitmap))
    sizes = sorted(r.size for r in known.select("size").distinct().collect())  # at most `seed` values

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                words, ends = flat_words(part.column(1).to_pylist(), LETTERS_DIGITS, True)
                ids = np.asarray(part.column(0))
                found: list[tuple] = []
                for n in sizes:
                    g, at = grams(words, ends, n)
                    hit = marked(packed.value, bits, g)
                    g, at = g[hit], at[hit]
                    doc = np.searchsorted(ends, at, side="right") - 1
                    found.append((ids[doc], g.view(np.int64), (at - ends[doc]).astype(np.int32), np.full(len(g), n, np.int32)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["doc_id", "gram", "at", "size"])

    seen = documents.select("doc_id", "text").where("doc_id is not null and text is not null and text <> ''").mapInArrow(places, "doc_id long, gram long, at int, size int")
    # The grams of the items once: the corpus's places are kept only where the gram really is an item's.
    real = stage(seen.join(known.select("gram", "size").distinct(), ["gram", "size"], "left_semi"), "places")
    counts = real.groupBy("gram", "size").agg(F.count("*").alias("freq"))
    ranked = known.join(counts, ["gram", "size"])  # a gram that the corpus lacks can seed nothing: its windows are not there
    reach = RUN - seed + 1
    last = known.groupBy("item_id").agg((F.max("pos") + 1).alias("n_grams"))
    windows = (
        known.join(last, "item_id")
        .where(F.col("pos") <= F.greatest(F.col("n_grams") - reach, F.lit(0)))
        .select("item_id", F.col("pos").alias("window"), F.least(F.lit(reach), "n_grams").alias("wide"))
    )
    inside = windows.select("item_id", "window", "wide", F.explode(F.sequence(F.col("window"), F.col("window") + F.col("wide") - 1)).alias("pos"))
    whole = inside.join(ranked, ["item_id", "pos"]).groupBy("item_id", "window", "wide").agg(F.count("*").alias("n"), F.min(F.struct("freq", "gram", "size")).alias("best"))
    chosen = whole.where("n = wide").select("item_id", "best.gram", "best.size", F.lit(True).alias("whole"))
    if edited:
        chosen = chosen.union(ranked.select("item_id", "gram", "size", F.lit(False)))
    chosen = chosen.groupBy("item_id", "gram", "size").agg(F.max("whole").alias("whole"))
    pairs = real.join(chosen, ["gram", "size"]).groupBy("doc_id", "item_id").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max("whole").alias("whole"))
    return pairs, texts


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over words, a row per item word: (best score, end in the document, end in the item, longest
    run of successive equal words)."""
    n = len(doc)
    up = np.zeros(n + 1, np.int64)
    run = np.zeros(n + 1, np.int64)
    slope = np.arange(n + 1) * -GAP
    best, best_at, best_row, longest = 0, 0, 0, 0
    for i, word in enumerate(item):
        same = doc == word
        row = np.zeros(n + 1, np.int64)
        row[1:] = np.maximum(up[:-1] + np.where(same, MATCH, MISMATCH), up[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope) - slope  # gaps along the document
        grown = np.zeros(n + 1, np.int64)
        grown[1:] = np.where(same, run[:-1] + 1, 0)
        top = int(row.argmax())
        if row[top] > best:
            best, best_at, best_row = int(row[top]), top, i + 1
        longest = max(longest, int(grown.max()))
        up, run = row, grown
    return best, best_at, best_row, longest


LEAK = "doc_id long, item_id long, score int, item_words int, longest_run int, item_end int, doc_end int"


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[] for _ in range(7)]
        for s in range(0, b.num_rows, 100):
            doc_ids, item_ids, firsts, lasts, whole, docs, passages = (c.to_pylist() for c in b.slice(s, 100).columns)
            words, ends = flat_words(docs + passages, LETTERS_DIGITS, True)
            for k, (doc_id, item_id, first, last) in enumerate(zip(doc_ids, item_ids, firsts, lasts)):
                doc, item = words[ends[k] : ends[k + 1]], words[ends[len(docs) + k] : ends[len(docs) + k + 1]]
                low = max(0, first - 2 * len(item))
                near = doc[low : last + RUN + 2 * len(item)]
                if not whole[k] and np.isin(item, near).sum() < EDITED * len(item):  # the score is at most the common words
                    continue
                score, at, row, run = align(near, item)
                for column, v in zip(rows, (doc_id, item_id, score, len(item), run, row, low + at)):
                    column.append(v)
        kinds = [pa.int64()] * 2 + [pa.int32()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], [x.split(" ")[0] for x in LEAK.split(", ")])


def leaks(documents: DataFrame, items: DataFrame, seed: int = SEED) -> DataFrame:
    """One row for each document and item of which it holds a passage, whole, in part or edited.

    score is the Smith-Waterman score over words (match 1, mismatch and gap -1), longest_run the longest run of
    successive equal words, item_end and doc_end where the best alignment ends. Rows are put out from a run of RUN
    words, or of all words of a shorter item, or a score of EDITED of the item's words; edited copies are looked for where they
    share `seed` successive words with the item, from 1 to RUN: with 1 none can be missed, and every document that shares a
    word is aligned. Words are longest runs of letters and
    digits without regard to case. Null and empty texts, and texts without words, have no rows; repeated rows count
    once; empty tables give no rows.
    """
    return _leaks(documents, items, True, seed)


def _leaks(documents: DataFrame, items: DataFrame, edited: bool, seed: int = SEED) -> DataFrame:
    pairs, texts = seeds(documents, items, edited, seed)
    pairs = stage(pairs, "pairs")
    held = documents.select("doc_id", "text").where("text is not null").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    wide = pairs.join(held, "doc_id").join(texts.withColumnRenamed("text", "passage"), "item_id")
    out = wide.select("doc_id", "item_id", "first", "last", "whole", "text", "passage").mapInArrow(_aligned, LEAK)
    return out.where(f"longest_run >= least({RUN}, item_words) or score >= {EDITED} * item_words")


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the alignment's longest run has RUN words, or all words of a shorter item."""
    return _leaks(documents, items, False).where(f"longest_run >= least({RUN}, item_words)").select("doc_id", "item_id")
