"""Long exact spans shared between texts, found through a log-structured fingerprint index.

Equal texts are one text with several owners. A text's fingerprints are the winnowed hashes of its K-character
windows: of every SPAN - K + 1 successive ones the smallest stay, so two texts that share SPAN characters share a
fingerprint taken from that stretch. Such a stretch reaches at least i/Q of the slack to the left of it or (Q-1-i)/Q to
the right for some i, so what is indexed are the Q wider windows around each fingerprint, by their hashes. They are all
made in the one pass that reads the texts, and the text itself is moved only for verification.

The index holds the keys as immutable runs, bucketed and sorted by key. A new batch becomes a sorted run of its own and is
merge-joined with each older run; before the next batch, runs of like size are compacted into one, so history is read by
merges and rewritten a logarithmic number of times. Given a folder, the index stays there and takes further batches later.

What comes of the keys depends on how many texts own them, and the result does not. Up to CROWD owners, with keys of the same
owners being one, are paired and verified on the texts. More are never paired: all whole windows of SPAN characters around
their keys make classes, each window of a class is traced to the class's first text, neighbouring windows with the same first
text are one stretch, and stretches are verified against that text character by character. That is one comparison per stretch,
however many texts share it. Only found(), which by definition lists pairs, expands classes, once for each set of owners and
in lanes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.components import components
from loomgraph.llm.words import mixed
from loomgraph.session import bucketed, remove, reopened, stage, tasks

SPAN = 400
K = 200
Q = 2
#: Owners of a key from which on they are classed by whole windows instead of paired.
CROWD = 8
#: Batches the table is cut into, by time.
BATCHES = 4
#: Keys a bucket of the index has room for, about, and keys of a character of text.
BUCKET_KEYS = 8_000_000
KEYS_PER_CHAR = 0.02
#: Members of a class in one lane when pairs are listed.
LANE = 1000
#: Characters worked on at a time; longer texts are read in overlapping parts.
CHUNK = 400_000
#: A run is merged with the one before it once it has at least 1 / GROWTH of its rows: runs of like size, so that a key is rewritten a
#: logarithmic number of times.
GROWTH = 1.5
#: Windows put out at a time.
PUT_OUT = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 8192)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Windows:
    """Hashes of any windows of a text by prefix sums."""

    def __init__(self, text: str):
        self.code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.code)
        up, self.down = _power(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(self.code.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def hashes(self, length: int, starts: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows of `length` characters at `starts`, or at every place."""
        if starts is None:
            n = len(self.code) - length + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])
        return mixed((self.sums[starts + length] - self.sums[starts]) * self.down[starts])


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least (or greatest) of every `width` successive values."""
    m = len(values) - width + 1
    blocks = np.r_[values, np.full(-len(values) % width, values[-1], np.uint64)].reshape(-1, width)
    ahead = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = best.accumulate(blocks, axis=1).ravel()
    return best(ahead[:m], behind[width - 1 : width - 1 + m])


def winnow(h: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the least of some `width` successive ones; none where h is shorter.

    A place is one if the greatest of the least values of the windows around it is its own. All equal values of a window are
    chosen, so that the choice depends on the text alone, not on where it stands."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    least = _sliding(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_sliding(np.r_[edge, least, edge], width, np.maximum) == h)


def parts(texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts of SPAN characters and more in chunks of about CHUNK: (joined text, where each begins, the number of each).
    A longer text comes in parts that overlap by SPAN, so that no stretch of SPAN characters is cut."""
    held: list[str] = []
    who: list[int] = []
    size = 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - SPAN), CHUNK):
            piece = t[at : at + CHUNK + SPAN]
            if len(piece) < SPAN:
                continue
            if held and size + len(piece) > CHUNK:
                yield "".join(held), np.cumsum([0, *map(len, held)]), np.asarray(who)
                held, who, size = [], [], 0
            held.append(piece)
            who.append(k)
            size += len(piece)
    if held:
        yield "".join(held), np.cumsum([0, *map(len, held)]), np.asarray(who)


def _unique(key: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, who))
    key, who = key[order], who[order]
    first = np.r_[True, (key[1:] != key[:-1]) | (who[1:] != who[:-1])] if len(key) else np.zeros(0, bool)
    return key[first], who[first]


def index_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each text, and its number."""
    slack = SPAN - K
    keys, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for text, begins, who in parts(texts):
        w = Windows(text)
        h = w.hashes(K)
        begin = np.repeat(begins[:-1], np.diff(begins))[: len(h)]
        end = np.repeat(begins[1:], np.diff(begins))[: len(h)]
        place = np.arange(len(h))
        h[place + K > end] = np.iinfo(np.uint64).max  # windows that reach into the next text are never chosen
        at = winnow(h, slack + 1)
        at = at[h[at] != np.iinfo(np.uint64).max]
        text_of = who[np.searchsorted(begins, at, side="right") - 1]
        for i in range(Q):
            left, right = slack * i // Q, slack * (Q - 1 - i) // Q
            ok = (at - left >= begin[at]) & (at + K + right <= end[at])
            keys.append(w.hashes(K + left + right, at[ok] - left))
            owner.append(text_of[ok])
    return _unique(np.concatenate(keys), np.concatenate(owner))


def whole_windows(text: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of SPAN characters that hold a window whose key is wanted: their hashes, and where they begin."""
    w = Windows(text)
    slack = SPAN - K
    mark = np.zeros(len(w.code) + 1, np.int64)  # a window at s holds one at p if p + size - SPAN <= s <= p
    for left, right in {(slack * i // Q, slack * (Q - 1 - i) // Q) for i in range(Q)}:
        size = K + left + right
        at = np.flatnonzero(np.isin(w.hashes(size), wanted))
        np.add.at(mark, np.maximum(at + size - SPAN, 0), 1)
        np.add.at(mark, at + 1, -1)
    starts = np.flatnonzero(np.cumsum(mark) > 0)
    starts = starts[starts + SPAN <= len(w.code)]
    return w.hashes(SPAN, starts), starts


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = np.asarray(b.column(0))
        for s in range(0, b.num_rows, 2000):
            keys, who = index_keys(b.column(1).slice(s, 2000).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[s:][who])], ["key", "doc"])


_WINDOW = "key long, doc long, pos int, once int"


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole windows around a text's wanted keys; once is 1 at a window's first place in its text, else 0."""
    for b in batches:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for doc, wanted, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            keys, at = whole_windows(text, np.asarray(wanted.values).view(np.uint64))
            once = np.zeros(len(keys), np.int32)
            once[np.unique(keys, return_index=True)[1]] = 1
            held.append((keys.view(np.int64), np.full(len(keys), doc), at.astype(np.int32), once))
            size += len(keys)
            if size > PUT_OUT:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], [c.split(" ")[0] for c in _WINDOW.split(", ")])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], [c.split(" ")[0] for c in _WINDOW.split(", ")])


def shared_spans(a: str, b: str, ha: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The stretches (begin, end) of a that stand in b in pieces of SPAN or more equal characters, and those of b that stand in a.
    ha: the hashes of a's windows, if they are at hand."""
    ha, hb = Windows(a).hashes(SPAN) if ha is None else ha, Windows(b).hashes(SPAN)
    ia, ib = np.flatnonzero(np.isin(ha, hb)), np.flatnonzero(np.isin(hb, ha))
    if len(ia):  # the hashes name the place, the characters decide
        j = int(ib[np.flatnonzero(hb[ib] == ha[ia[0]])[0]])
        if a[ia[0] : ia[0] + SPAN] != b[j : j + SPAN]:
            return [], []
    return _stretches(ia), _stretches(ib)


def _stretches(starts: np.ndarray) -> list[tuple[int, int]]:
    """Windows of SPAN characters at sorted starts, joined where they touch."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > SPAN)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + SPAN).tolist()))


_PAIR = "a long, b long, spans_a array<struct<begin:int,end:int>>, spans_b array<struct<begin:int,end:int>>"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        rows: list[list] = [[], [], [], []]
        last, held = None, None
        for x, y, s, t in zip(*(c.to_pylist() for c in b.columns)):
            if x != last:
                last, held = x, Windows(s).hashes(SPAN)
            own, theirs = shared_spans(s, t, held)
            if own:
                for column, v in zip(rows, (x, y, [{"begin": p, "end": q} for p, q in own], [{"begin": p, "end": q} for p, q in theirs])):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], kind), pa.array(rows[3], kind)], ["a", "b", "spans_a", "spans_b"])


def _owner_sums() -> list:
    """Aggregates that are the same for the same set of doc, and else are not."""
    return [F.sum(F.shiftright(F.xxhash64("doc"), 28)).alias("s1"), F.sum(F.shiftright(F.xxhash64("doc", F.lit(1)), 28)).alias("s2")]


def paired(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(a, b), a < b: all pairs of the names of one key; a key may have any number of them, its pairs are made in lanes."""
    lanes = rows.groupBy(key).agg(F.ceil(F.count("*") / LANE).cast("int").alias("lanes")).where("lanes > 1")
    spread = rows.join(lanes, key, "left").select(key, name, F.coalesce("lanes", F.lit(1)).alias("lanes"))
    left = spread.select(key, F.col(name).alias("a"), F.pmod(F.xxhash64(name), "lanes").cast("int").alias("lane"))
    right = spread.select(key, F.col(name).alias("b"), F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))
    return left.join(right, [key, "lane"]).where("a < b").select("a", "b")


@dataclass
class Candidates:
    """What a batch may share: pairs (a, b) of texts, and (key, doc) of the keys that a crowd owns."""

    pairs: DataFrame
    crowds: DataFrame


class FingerprintIndex:
    """Sorted runs of keys in the shared folder; add() compares a batch with all of them and with itself."""

    def __init__(self, spark: SparkSession, chars: int = 0, folder: str | None = None):
        """chars: characters to expect, for the number of buckets. folder: where the index stays, and where it is
        taken up again if it is there; without one it goes with the application."""
        self.spark, self.folder = spark, folder.rstrip("/") if folder else None
        self.name = f"fingerprints_{uuid.uuid4().hex[:12]}"
        self.buckets = max(tasks(spark), int(chars * KEYS_PER_CHAR / BUCKET_KEYS) + 1)
        self.runs: list[tuple[DataFrame, int, str]] = []
        self.written = self.version = self.compacted = 0
        if self.folder:
            self._take_up()

    def _take_up(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return
        listed = self.spark.read.schema("version int, place int, run string, rows long, buckets int, name string, written int").json(f"{self.folder}/manifest/*")
        rows = listed.join(listed.agg(F.max("version").alias("version")), "version").orderBy("place").collect()  # a row per run
        for r in rows:
            self.runs.append((reopened(self.spark, r.run, "key LONG, doc LONG", "key", r.buckets, self.folder), r.rows, r.run))
            self.buckets, self.name, self.written, self.version = r.buckets, r.name, r.written, r.version

    def _write(self, rows: DataFrame) -> tuple[DataFrame, int, str]:
        self.written += 1
        name = f"{self.name}_{self.written}"
        run = bucketed(rows, name, "key", self.buckets, self.folder)
        return run, run.count(), name

    def _note(self) -> None:
        """A new version of the list of runs, one small file."""
        if self.folder:
            self.version += 1
            rows = [(self.version, k, name, n, self.buckets, self.name, self.written) for k, (_, n, name) in enumerate(self.runs)]
            listed = self.spark.createDataFrame(rows, "version int, place int, run string, rows long, buckets int, name string, written int")
            listed.coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/{self.version}")

    def compact(self) -> None:
        """Merge the last runs as long as they are of like size."""
        old = []
        while len(self.runs) > 1 and self.runs[-1][1] * GROWTH >= self.runs[-2][1]:
            (x, _, i), (y, _, j) = self.runs.pop(), self.runs.pop()
            self.runs.append(self._write(x.unionByName(y)))
            self.compacted += 1
            old += [i, j]
        if old:
            self._note()
            for name in old if self.folder else []:
                remove(self.spark, f"{self.folder}/{name}")

    def add(self, batch: DataFrame) -> Candidates:
        """What the texts of a batch (doc, text; doc unique, and in no earlier batch) may share with each other and with all before.
        A text of SPAN characters that two of them share is in the result; verified() and classes() make it exact."""
        self.compact()
        run, rows, name = self._write(batch.select("doc", "text").where(F.length("text") >= SPAN).mapInArrow(_printed, "key long, doc long"))
        # Runs are bucketed and sorted by key: neither the grouping of one nor the merge of two moves a row.
        several = run.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("key")
        for old, _, _ in self.runs:
            several = several.unionByName(run.hint("merge").join(old.select("key"), "key", "left_semi").select("key"))
        several = stage(several.distinct(), "several")
        hits = run.withColumn("new", F.lit(True))
        for old, _, _ in self.runs:
            hits = hits.unionByName(old.withColumn("new", F.lit(False)))
        self.runs.append((run, rows, name))
        self._note()
        keyed = stage(hits.join(several, "key"), "keyed")
        owned = keyed.groupBy("key").agg(F.count("*").alias("n"), *_owner_sums())
        few = owned.where(F.col("n") <= CROWD).groupBy("n", "s1", "s2").agg(F.min("key").alias("key")).select("key")
        kept = keyed.join(few, "key")
        left = kept.select("key", F.col("doc").alias("a"), F.col("new").alias("new_a"))
        right = kept.select("key", F.col("doc").alias("b"), F.col("new").alias("new_b"))
        pairs = left.join(right, "key").where("a < b and (new_a or new_b)").select("a", "b").distinct()
        crowds = keyed.join(owned.where(F.col("n") > CROWD).select("key"), "key").select("key", "doc")
        return Candidates(pairs, crowds)


def _texts(corpus: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of the given docs; their list is written first, so that its size decides how it is joined."""
    return corpus.join(stage(docs.select("doc").distinct(), "docs"), "doc", "left_semi")


def verified(corpus: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose texts in corpus (doc, text) share a stretch, with all of them (spans_a, spans_b)."""
    texts = stage(_texts(corpus, pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc")))), "texts")
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    wide = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return stage(wide.mapInArrow(_verified, _PAIR), "spans")


def classes(corpus: DataFrame, crowds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the crowds' (key, doc): stretches (doc, begin, end, rep) of a text that rep, the first text of their windows' class, has too;
    and the windows they are of (key, doc). A rep's own windows are stretches of itself."""
    if crowds.isEmpty():
        spark = crowds.sparkSession
        return spark.createDataFrame([], "doc long, begin int, end int, rep long"), spark.createDataFrame([], "key long, doc long")
    wanted = crowds.groupBy("doc").agg(F.collect_set("key").alias("wanted"))  # as many as the text has keys
    texts = stage(_texts(corpus, crowds), "texts")
    windows = stage(wanted.join(texts, "doc").select("doc", "wanted", "text").mapInArrow(_widened, _WINDOW), "windows")
    first = windows.groupBy("key").agg(F.sum("once").alias("n"), F.min(F.struct("doc", "pos")).alias("f")).where("n > 1").select("key", F.col("f.doc").alias("rep"), F.col("f.pos").alias("at"))
    traced = windows.join(first, "key").withColumn("off", F.col("pos") - F.col("at"))
    # Windows that follow each other in the text and in rep are one stretch: their place less their number is the same.
    traced = stage(traced.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("doc", "rep", "off").orderBy("pos"))), "traced")
    islands = traced.groupBy("doc", "rep", "off", "island").agg(F.min("pos").alias("begin"), (F.max("pos") + SPAN).alias("end"))
    theirs = islands.where("doc <> rep").join(texts.select(F.col("doc").alias("rep"), F.col("text").alias("t")), "rep")
    theirs = theirs.select("doc", "rep", "off", "island", "begin", "end", F.expr("substring(t, begin - off + 1, end - begin)").alias("theirs"))
    sure = theirs.join(texts, "doc").where(F.expr("substring(text, begin + 1, end - begin) = theirs")).select("doc", "rep", "off", "island", "begin", "end")
    sure = stage(sure.unionByName(islands.where("doc = rep")), "sure")
    members = traced.where("once = 1").join(sure.select("doc", "rep", "off", "island"), ["doc", "rep", "off", "island"], "left_semi").select("key", "doc")
    return sure.select("doc", "begin", "end", "rep"), members


def owners(documents: DataFrame) -> DataFrame:
    """(doc_id, doc, same): each document and the smallest id that has the same text, for texts of SPAN characters or more; of
    several texts of one doc_id that with the smallest digest, which is `same`."""
    slim = documents.where(F.length("text") >= SPAN).where("doc_id is not null").select("doc_id", F.sha2("text", 256).alias("same")).groupBy("doc_id").agg(F.min("same").alias("same"))
    first = slim.groupBy("same").agg(F.min("doc_id").alias("doc"))
    return slim.join(first, "same").select("doc_id", "doc", "same")


def _spans(documents: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, doc), lengths (doc, chars), verified pairs of distinct texts, and the crowds' stretches and windows.

    The corpus goes into the index in BATCHES of about as many rows, in the order of ingested_at (null first), each compared
    with those before it. Only keys are moved, not texts, as long as the list of copies is short."""
    members = stage(owners(documents), "owners")
    copies = stage(members.where("doc_id <> doc").select(F.col("doc_id").alias("doc")), "copies")
    rows = documents.select(F.col("doc_id").alias("doc"), "text", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at")).where(F.length("text") >= SPAN).where("doc is not null")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.percentile_approx("at", [k / BATCHES for k in range(1, BATCHES)]).alias("cuts")).first()
    if size.n > members.count():  # a doc_id stands there more than once: the text that owners() chose, once
        rows = rows.withColumn("same", F.sha2("text", 256)).join(members.select(F.col("doc_id").alias("doc"), "same"), ["doc", "same"], "left_semi").drop("same").dropDuplicates(["doc"])
    corpus, lengths = rows.select("doc", "text"), rows.select("doc", F.length("text").cast("long").alias("chars"))
    index = FingerprintIndex(documents.sparkSession, size.chars or 0, folder)
    batch = sum((F.coalesce(F.col("at") > cut, F.lit(False)).cast("int") for cut in size.cuts or []), F.lit(0))
    texts = rows.join(copies, "doc", "left_anti").withColumn("batch", batch)
    seen = [index.add(texts.where(F.col("batch") == k)) for k in range(BATCHES)]
    pairs, crowds = seen[0].pairs, seen[0].crowds
    for c in seen[1:]:
        pairs, crowds = pairs.unionByName(c.pairs), crowds.unionByName(c.crowds)
    spans = verified(corpus, stage(pairs.distinct(), "pairs"))
    stretches, windows = classes(corpus, stage(crowds.distinct(), "crowds"))
    return members.select("doc_id", "doc"), lengths, spans, stretches, windows


def found(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: documents that have SPAN successive characters in common.

    Characters are code points, compared as they stand. Null, empty and shorter texts share nothing; repeated rows
    count once; an empty table gives no rows. Texts that are the same are compared as one and paired at the end.
    """
    members, _, spans, _, windows = _spans(documents)
    sets = windows.groupBy("key").agg(F.count("*").alias("n"), *_owner_sums()).groupBy("n", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    crowded = paired(stage(windows.join(sets, "key"), "sets"), "key", "doc")
    texts = spans.select("a", "b").unionByName(crowded).distinct()
    named = members.select("doc", "doc_id")
    x = texts.join(named.select(F.col("doc").alias("a"), F.col("doc_id").alias("i")), "a").join(named.select(F.col("doc").alias("b"), F.col("doc_id").alias("j")), "b")
    copies = paired(named, "doc", "doc_id").select(F.col("a").alias("i"), F.col("b").alias("j"))
    return copies.unionByName(x.select("i", "j")).select(F.least("i", "j").alias("doc_id_a"), F.greatest("i", "j").alias("doc_id_b"))


def shares(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, chars, shared_chars, shared_ratio: of each document with a shared stretch how many of its characters
    stand in stretches of SPAN or more that another document has; documents that share one, directly or through a chain, are
    a class, named by its smallest doc_id. A copy of another text is shared as a whole.

    No pairs are made of the documents that share one stretch. Null, empty and shorter texts share nothing; repeated rows count
    once (of several texts of one doc_id that with the smallest SHA-256); an empty table gives no rows.
    """
    members, lengths, spans, stretches, _ = _spans(documents)
    sides = spans.select(F.col("a").alias("doc"), F.explode("spans_a").alias("s")).unionByName(spans.select(F.col("b").alias("doc"), F.explode("spans_b").alias("s"))).select("doc", "s.begin", "s.end")
    flat = sides.unionByName(stretches.select("doc", "begin", "end")).distinct()
    w = "partition by doc order by begin, end rows between unbounded preceding and 1 preceding"
    grown = flat.withColumn("before", F.expr(f"coalesce(max(end) over ({w}), 0)"))
    covered = grown.groupBy("doc").agg(F.sum(F.greatest(F.col("end") - F.greatest("begin", "before"), F.lit(0))).cast("long").alias("shared"))
    links = spans.select("a", "b").unionByName(stretches.where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b")))
    joined = components(links)
    sizes = members.groupBy("doc").agg(F.count("*").alias("owners"))
    each = sizes.join(lengths, "doc").join(covered, "doc", "left").join(joined.withColumnRenamed("node", "doc"), "doc", "left").where("owners > 1 or shared is not null")
    each = each.select("doc", "owners", F.coalesce("component", "doc").alias("class_id"), "chars", F.when(F.col("owners") > 1, F.col("chars")).otherwise(F.col("shared")).alias("shared_chars"))
    each = stage(each, "each")
    wide = each.groupBy("class_id").agg(F.sum("owners").alias("class_size"))
    out = members.join(each, "doc").join(wide, "class_id")
    return out.select("doc_id", "class_id", "class_size", "chars", "shared_chars", F.round(F.col("shared_chars") / F.col("chars"), 6).alias("shared_ratio"))
