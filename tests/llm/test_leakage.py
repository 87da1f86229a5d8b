import random
import re

import numpy as np

from loomgraph.llm import leakage as k

D = "doc_id long, text string, gram string, size string"
I = "item_id long, text string, gram string, suite string"  # noqa: E741


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in docs], D), spark.createDataFrame([(i, t, "x", "y") for i, t in items], I)


def plain(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, t in items:
        w = words(t)
        n = min(12, len(w))
        runs = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if n else set()
        for d, s in docs:
            v = words(s)
            if d is not None and i is not None and any(tuple(v[a : a + n]) in runs for a in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_against_plain_rule(spark):
    r = random.Random(3)
    pool = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [(i, text(r.choice([3, 5, 6, 8, 11, 12, 13, 30, 60]))) for i in range(40)] + [(90, None), (91, ""), (92, "?!"), (93, "one"), (94, items_dup := "Seven Words_are in This ITEM here"), (95, items_dup), (None, "w1 w2 w3")]
    docs = [(d, text(r.randint(0, 80))) for d in range(30)] + [(500, None), (501, ""), (502, "x ONE y"), (503, "so: seven words are, in this item-here!"), (504, "seven words are in that item here"), (505, "one " * 50_000)]
    for d in range(100, 160):
        _, source = r.choice(items[:40])
        w = source.split()
        a = r.randint(0, max(0, len(w) - 11))
        docs.append((d, text(10) + " " + " ".join(w[a : a + r.choice([10, 11, 12, 13, 40])]).upper() + ". " + text(5)))
    docs.append(docs[-1])
    got = k.found(*frames(spark, docs, items)).collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(x) for x in got} == plain(docs, items)


def test_recall_of_edited_copies(spark):
    """Copies with up to a fifth of their words changed, dropped or added, against an alignment of all pairs: seeds of one word find all,
    those of five nearly all."""
    r = random.Random(21)
    pool = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(pool) for _ in range(r.randint(30, 60)))) for i in range(30)]
    docs = []
    for d in range(200):
        w = r.choice(items)[1].split()
        for _ in range(r.randint(1, len(w) // 5)):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([["new"], [], [w[at], "more"]])
        docs.append((d, " ".join(["before"] * 9 + w + ["after"] * 9)))
    want = set()
    for d, text in docs:
        for i, item in items:
            x, y = (np.array([hash(v) for v in re.findall(r"[^\W_]+", t.lower())]) for t in (text, item))
            score, _, _, run = k.align(x, y)
            if run >= 12 or score >= k.EDITED * len(y):
                want.add((d, i))
    assert len(want) > 150
    got = {seed: {(x.doc_id, x.item_id) for x in k.leaks(*frames(spark, docs, items), seed=seed).collect()} for seed in (1, k.SEED)}
    assert got[1] == want and got[k.SEED] <= want and len(got[k.SEED]) >= 0.98 * len(want)


def test_bitmap():
    g = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    bitmap = np.zeros(1 << 16, bool)
    bitmap[(g[:100] >> np.uint64(48)).astype(np.int64)] = True
    hit = k.marked(np.packbits(bitmap), 16, g)
    assert hit[:100].all() and (hit == bitmap[(g >> np.uint64(48)).astype(np.int64)]).all()


def test_edited_copy(spark):
    item = "when the window turns pending the lane will classify its vault and drain the stale parcel for every reader"
    copy = item.replace("pending", "idle").replace("stale ", "")
    docs, items = frames(spark, [(1, f"before this {copy} after that"), (2, "nothing of the kind is here at all"), (3, item)], [(7, item)])
    got = {r.doc_id: r for r in k.leaks(docs, items).collect()}
    assert set(got) == {1, 3} and got[3].score == 19 and got[1].longest_run < 12 and got[1].score >= 0.6 * 19
    assert {r.doc_id for r in k.found(docs, items).collect()} == {3}


def test_edited_copy_in_many(spark):
    """A copy with a word changed in every 11 is found however many documents hold it, also beside a whole one."""
    item = [f"t{i}" for i in range(60)]
    edited = lambda d: " ".join(f"z{d}x{i}" if i % 11 == 10 else w for i, w in enumerate(item))
    far = [(900, "u1 u2 t3 t4 t5 t6 t7 u3 u4"), (901, "nothing of the kind")]
    for more in ([], [(500, " ".join(item))]):
        docs = [(d, edited(d)) for d in range(40)] + more + far
        got = {r.doc_id: r for r in k.leaks(*frames(spark, docs, [(1, " ".join(item))])).collect()}
        assert set(got) == {d for d, _ in docs} - {900, 901} and got[0].score == 50 and got[0].longest_run == 10
        assert {r.doc_id for r in k.found(*frames(spark, docs, [(1, " ".join(item))])).collect()} == {d for d, _ in more}


def test_everywhere(spark):
    """A passage in every document: all are found, also where nothing in it is rare."""
    item = " ".join(f"t{i}" for i in range(20))
    docs = [(d, item) for d in range(200)]
    assert k.found(*frames(spark, docs, [(1, item), (2, item)])).count() == 400


def test_empty(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a b")])
    assert k.found(docs.limit(0), items).count() == 0 and k.found(docs, items.limit(0)).count() == 0 and k.leaks(docs, items).count() == 1


def test_align():
    a = lambda *x: np.array(x, np.uint64)
    assert k.align(a(9, 1, 2, 3, 9), a(1, 2, 3)) == (3, 4, 3, 3)
    assert k.align(a(1, 2, 9, 3, 4), a(1, 2, 3, 4))[0] == 3
    assert k.align(a(1, 2, 4, 5), a(1, 2, 3, 4, 5))[0] == 3
    assert k.align(a(5), a(6)) == (0, 0, 0, 0) and k.align(a(), a(1)) == (0, 0, 0, 0)
