import hashlib
import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import spans as s

D = "doc_id long, text string, ingested_at timestamp_ntz, fp string, doc string"
T0 = datetime(2025, 1, 1)


def frame(spark, docs):
    r = random.Random(1)
    return spark.createDataFrame([(i, t, None if i and i % 7 == 0 else T0 + timedelta(hours=r.randint(0, 999)), "x", "y") for i, t in docs], D)


def plain(docs):
    docs = {i: t for i, t in docs if i is not None and t}
    windows = {i: {t[a : a + s.SPAN] for a in range(len(t) - s.SPAN + 1)} for i, t in docs.items()}
    return {(a, b) for a in docs for b in docs if a < b and windows[a] & windows[b]}


def text(r, n):
    return "".join(r.choice("abcdefgh é日\n") for _ in range(n))


def corpus(seed=2):
    r = random.Random(seed)
    docs = [(i, text(r, r.randint(0, 1500))) for i in range(25)]
    for i in range(30, 75):
        _, source = r.choice(docs[:25])
        a, n = r.randint(0, max(0, len(source) - 400)), r.choice([200, 380, 399, 400, 401, 450, 900])
        docs.append((i, text(r, r.randint(0, 300)) + source[a : a + n] + text(r, r.randint(0, 300))))
    docs += [(80, None), (81, ""), (82, "x" * 399), (83, "x" * 400), (84, "y" * 5 + "x" * 900), (85, "ab" * 400), (86, "c" + "ab" * 260), (87, docs[0][1]), (88, docs[30][1]), (89, docs[30][1] + "!"), (None, docs[30][1])]
    return docs


def test_against_plain_rule(spark):
    docs = corpus()
    got = [tuple(r) for r in s.found(frame(spark, [*docs, docs[3]])).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(docs)


def shared(docs):
    """doc_id -> (class, characters in shared windows) by the plain rule."""
    docs = {i: t for i, t in docs if i is not None and t and len(t) >= s.SPAN}
    holders = {}
    for i, t in docs.items():
        for a in range(len(t) - s.SPAN + 1):
            holders.setdefault(t[a : a + s.SPAN], set()).add(i)
    own, chars = {i: i for i in docs}, {}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for i, t in docs.items():
        marked = set()
        for a in range(len(t) - s.SPAN + 1):
            who = holders[t[a : a + s.SPAN]]
            if len(who) > 1:
                marked |= set(range(a, a + s.SPAN))
                for j in who:
                    x, y = sorted((root(i), root(j)))
                    own[y] = x
        if marked:
            chars[i] = len(marked)
    return {i: (root(i), n) for i, n in chars.items()}


def test_shares(spark):
    r = random.Random(5)
    common, a, b = text(r, 500), text(r, 300), text(r, 200)
    docs = [(1, a + common), (2, common + b), (3, common + b), (4, b + a), (5, text(r, 900))]
    got = {x.doc_id: (x.class_id, x.class_size, x.chars, x.shared_chars, x.shared_ratio) for x in s.shares(frame(spark, docs)).collect()}
    assert got == {1: (1, 3, 800, 500, 0.625), 2: (1, 3, 700, 700, 1.0), 3: (1, 3, 700, 700, 1.0)}


def test_shares_against_plain_rule(spark, monkeypatch):
    docs = corpus(4)
    want = shared(docs)
    for crowd in (2, 8):  # the route differs, the rows do not
        monkeypatch.setattr(s, "CROWD", crowd)
        got = s.shares(frame(spark, [*docs, docs[3]])).collect()
        assert {x.doc_id: (x.class_id, x.shared_chars) for x in got} == want and len(got) == len(want)
        assert all(x.class_size == sum(c == x.class_id for c, _ in want.values()) for x in got)


def test_repeated_id(spark):
    """Of two texts under one doc_id the one of the smaller SHA-256 counts, wherever it is used."""
    r = random.Random(12)
    x, y = sorted((text(r, 900), text(r, 900)), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    docs = [(1, x), (1, y), (2, "q" + x[:500]), (3, "q" + y[:450])]
    assert [tuple(p) for p in s.found(frame(spark, docs)).collect()] == [(1, 2)]
    assert {d.doc_id: d.shared_chars for d in s.shares(frame(spark, docs)).collect()} == {1: 500, 2: 500}


def test_header_of_all(spark, monkeypatch):
    """A header that all documents share costs one stretch each, no pairs."""
    r = random.Random(13)
    header = text(r, 400)
    seen = []
    plain_paired = s.paired
    monkeypatch.setattr(s, "paired", lambda rows, *a: seen.append(a) or plain_paired(rows, *a))
    docs = [(i, text(r, 30) + header + text(r, 30)) for i in range(20_000)]
    got = s.shares(frame(spark, docs)).agg(F.count("*"), F.min("class_size"), F.min("shared_chars"), F.max("shared_chars"), F.max("class_id")).first()
    assert tuple(got)[:2] == (20_000, 20_000) and 400 <= got[2] <= got[3] < 430 and got[4] == 0 and not seen  # neighbours of the header may agree by chance


def test_lanes(spark, monkeypatch):
    monkeypatch.setattr(s, "LANE", 7)
    rows = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 5), (2, 9), (3, 1)], "k long, d long")
    got = [tuple(x) for x in s.paired(rows, "k", "d").collect()]
    assert sorted(got) == sorted([(a, b) for b in range(40) for a in range(b)] + [(5, 9)])


def test_hot_stretch(spark):
    r = random.Random(6)
    common = text(r, 450)
    docs = [(i, text(r, 20) + common + text(r, 20)) for i in range(60)] + [(100 + i, text(r, 20) + common[:390] + text(r, 20)) for i in range(40)]
    assert s.found(frame(spark, docs)).count() == 60 * 59 // 2


def test_crowd_with_two_stretches(spark, monkeypatch):
    """The same crowd shares a stretch that is too short and one that is not: whichever has the smaller key, all pairs are found."""
    monkeypatch.setattr(s, "CROWD", 4)
    r = random.Random(11)
    docs = []
    for group in range(8):
        short, long = text(r, 390), text(r, 430)
        docs += [(100 * group + i, text(r, 450) + short + text(r, 450) + long + text(r, 450)) for i in range(6)]
    got = [tuple(x) for x in s.found(frame(spark, docs)).collect()]
    assert len(got) == len(set(got)) == 8 * 15 and set(got) == plain(docs)


def test_index_over_batches(spark, tmp_path):
    docs = [(i, t) for i, t in corpus(9) if i is not None and t]
    unique = {t: i for i, t in reversed(docs)}
    all_texts = spark.createDataFrame([(i, t) for t, i in unique.items()], "doc long, text string")
    want = plain([(i, t) for t, i in unique.items()])

    def pairs(candidates):
        crowd = s.paired(s.classes(all_texts, candidates.crowds.distinct())[1], "key", "doc")
        return {(r.a, r.b) for r in s.verified(all_texts, candidates.pairs).select("a", "b").unionByName(crowd).collect()}

    index, got = s.FingerprintIndex(spark), set()
    for k in range(4):
        got |= pairs(index.add(all_texts.where(f"doc % 4 = {k}")))
    assert got == want and index.compacted >= 1 and len(index.runs) < 4
    got = set()
    for k in range(4):  # an index in a folder is taken up again for each batch
        index = s.FingerprintIndex(spark, folder=str(tmp_path / "index"))
        assert bool(index.runs) == (k > 0)
        got |= pairs(index.add(all_texts.where(f"doc % 4 = {k}")))
    assert got == want and len(index.runs) < 4
    assert len([p for p in (tmp_path / "index").iterdir() if p.name != "manifest"]) == len(index.runs)  # runs that were compacted are gone


def test_empty_and_long(spark):
    assert s.found(frame(spark, [])).count() == 0 and s.shares(frame(spark, [(1, None)])).count() == 0
    r = random.Random(8)
    long = text(r, 400_000)
    assert {tuple(x) for x in s.found(frame(spark, [(1, long), (2, "z" + long[250_000:250_400] + "z"), (3, long[:399])])).collect()} == {(1, 2)}


def test_winnow_guarantee():
    r = random.Random(3)
    for alphabet in ("abcdefghij", "ab", "a"):
        t = "".join(r.choice(alphabet) for _ in range(1200))
        h = s.Windows(t).hashes(s.K)
        places = set(s.winnow(h, s.SPAN - s.K + 1).tolist())
        want = {i for a in range(len(h) - s.SPAN + s.K) for i in range(a, a + s.SPAN - s.K + 1) if h[i] == h[a : a + s.SPAN - s.K + 1].min()}
        assert places == want
        a = r.randint(100, 700)
        other = "Q" * 50 + t[a : a + s.SPAN] + "Z" * 50
        keys, who = s.index_keys(["short", t, other])
        assert set(keys[who == 1].tolist()) & set(keys[who == 2].tolist()) and not (who == 0).any()
    assert len(s.winnow(np.zeros(5, np.uint64), 9)) == 0


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(s, "CHUNK", 1000)
    r = random.Random(4)
    t = text(r, 5000)
    for a in range(0, 4600, 97):
        keys, who = s.index_keys([t, "Z" * 30 + t[a : a + 400] + "Y"])
        assert set(keys[who == 0].tolist()) & set(keys[who == 1].tolist())


def test_whole_windows():
    r = random.Random(5)
    t = text(r, 1500)
    w = s.Windows(t)
    got, at = s.whole_windows(t, w.hashes(300, np.array([700])))
    assert at.tolist() == list(range(600, 701)) and got.tolist() == w.hashes(s.SPAN, at).tolist()
