import random

import numpy as np

from loomgraph.llm import nearcode as n
from loomgraph.llm.components import components, merged

F = "fn_id long, body string, body_hash string, key string, rep string"


def groups(spark, rows):
    df = spark.createDataFrame([(i, b, "wrong", "clash", "clash") for i, b in rows], F)
    return {r.fn_id: r.group_id for r in n.groups(df).collect()}


def plain(rows):
    bodies = {}
    for i, b in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1]), reverse=True):
        bodies[i] = b
    ids, sets = sorted(bodies), {i: n.shingles(b) for i, b in bodies.items()}
    own = {i: i for i in ids}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and (bodies[a] == bodies[b] or both and 10 * both >= 7 * len(sets[a] | sets[b])):
                x, y = sorted((root(a), root(b)))
                own[y] = x
    out = {i: root(i) for i in ids}
    return {i: g for i, g in out.items() if list(out.values()).count(g) > 1}


def body(r, size=120):
    return " ".join(f"w{r.randint(0, 5000)}" for _ in range(size))


def edited(r, text, share):
    words = text.split()
    for k in range(len(words)):
        if r.random() < share:
            words[k] = f"e{r.randint(0, 9999)}"
    return " ".join(words)


def test_against_all_pairs(spark):
    r = random.Random(4)
    rows, k = [], 0
    for _ in range(25):
        text = body(r)
        for _ in range(r.randint(1, 5)):
            rows.append((k, text))
            k += 1
            text = edited(r, text, r.choice([0, 0.01, 0.04, 0.1]))  # chains drift away from where they began
    rows += [(k + i, x) for i, x in enumerate(("", "", "a b", "a b", "a c", "b a", None, "a b c", "a, b c", "x y z w"))]
    rows += [(0, rows[0][1]), (None, rows[0][1])]
    r.shuffle(rows)
    assert groups(spark, rows) == plain(rows)


def test_hot_group(spark):
    r = random.Random(5)
    text = body(r)
    rows = [(i, edited(r, text, 0.01)) for i in range(150)] + [(200 + i, text) for i in range(50)] + [(300 + i, body(r)) for i in range(50)]
    got = groups(spark, rows)
    assert set(got) == {*range(150), *range(200, 250)} and set(got.values()) == {0}


def boilerplate():
    """Three shingles of which each is the least, among very many, for one of the first three symbols."""
    text = " ".join(f"q{i}" for i in range(200_000))
    g, at = n.grams(*n.flat_words([text], n.CODE_WORDS, False), n.SHINGLE)
    out = []
    for seed in n._SEEDS[:3]:
        h = g * seed
        k = int(at[(h ^ (h >> np.uint64(31))).argmin()])
        out += [f"q{k}", f"q{k + 1}", f"q{k + 2}"]
    return " ".join(out)


def test_boilerplate_chunk(spark, monkeypatch):
    """5,000 unlike bodies that share a chunk key are split by further chunks, not compared with each other; those that are alike
    among them are found."""
    r, common = random.Random(9), boilerplate()
    rows = [(i, f"{common} {body(r, 40)}") for i in range(5000)]
    rows += [(6000 + i, f"{common} {edited(r, rows[i][1][len(common) :], 0.02)}") for i in range(40)]
    key = n.chunk_keys(n.signatures([b for _, b in rows])[1])[:, n.WIDTH - 1]
    assert np.unique(key, return_counts=True)[1].max() > 4900
    compared, verified = [], n._verified
    monkeypatch.setattr(n, "_verified", lambda pairs, *a: compared.append(pairs.count()) or verified(pairs, *a))
    got = {x.fn_id: x.group_id for x in n.groups(spark.createDataFrame(rows, "fn_id long, body string")).collect()}
    want = {}
    for i in range(40):
        x, y = n.shingles(rows[i][1]), n.shingles(rows[5000 + i][1])
        if 10 * len(x & y) >= 7 * len(x | y):
            want |= {i: i, 6000 + i: i}
    assert got == want and len(want) > 20 and sum(compared) < 8 * len(rows)


def test_crowded_chunk_loses_nothing(spark):
    """Alike bodies that meet in no bucket but that of a chunk key which 300 unlike ones share too: 30 of them stand there again with a
    tail that has the least shingle for another symbol of that chunk and for two of each other chunk."""
    r, common, tail = random.Random(11), boilerplate(), []
    g, _ = n.grams(*n.flat_words([" ".join(f"z{i}" for i in range(200_000))], n.CODE_WORDS, False), n.SHINGLE)
    for s in (n.WIDTH - 1, *(c * n.WIDTH + k for c in range(1, n.CHUNKS) for k in (0, 1))):
        h = g * n._SEEDS[s]
        k = int((h ^ (h >> np.uint64(31))).argmin())
        tail += [f"z{k}", f"z{k + 1}", f"z{k + 2}"]
    rows = [(i, f"{common} {body(r, 110)}") for i in range(300)]
    rows += [(1000 + i, f"{rows[i][1]} {' '.join(tail)}") for i in range(30)]
    keys = n.chunk_keys(n.signatures([b for _, b in rows])[1])
    for i in range(30):
        x, y = n.shingles(rows[i][1]), n.shingles(rows[300 + i][1])
        assert 10 * len(x & y) >= 7 * len(x | y) and set(keys[i]) & set(keys[300 + i]) == {keys[i][n.WIDTH - 1]}
    want = {i: i for i in range(30)} | {1000 + i: i for i in range(30)}
    assert {x.fn_id: x.group_id for x in n.groups(spark.createDataFrame(rows, "fn_id long, body string")).collect()} == want


def test_hot_and_exact(spark, monkeypatch):
    """Buckets split at once, and all compared: the same groups."""
    r = random.Random(10)
    rows = []
    for k in range(6):
        text = body(r, 60)
        rows += [(100 * k + i, edited(r, text, 0.008)) for i in range(12)]
    df = spark.createDataFrame(rows, "fn_id long, body string")
    want = plain(rows)
    for hot in (2, None):
        assert {x.fn_id: x.group_id for x in n.groups(df, hot).collect()} == want


def test_edges_of_the_input(spark):
    assert groups(spark, []) == {}
    long = "word " * 200_000 + "tail one two"
    assert groups(spark, [(1, long), (2, long + " three"), (3, "other thing here now")]) == {1: 1, 2: 1}
    df = spark.createDataFrame([(2, "a b c", None, None, None), (1, "a b  c", None, None, None)], F)
    assert [tuple(x) for x in n.found(df).collect()] == [(1, 2)]


def test_guarantee():
    r = random.Random(6)
    import numpy as np

    for _ in range(50):  # any pair within 2 * CHUNKS - 1 unlike symbols shares a key
        a = np.array([[r.randint(0, 65535) for _ in range(n.SYMBOLS)]], np.uint64)
        b = a.copy()
        for k in r.sample(range(n.SYMBOLS), 2 * n.CHUNKS - 1):
            b[0, k] ^= np.uint64(1)
        assert set(n.chunk_keys(a)[0].tolist()) & set(n.chunk_keys(b)[0].tolist())


def test_components(spark):
    r = random.Random(7)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 500)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(60)} == {100} and 500 not in got
    assert all(got[a] == got[b] for a, b in links if a != b)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merged(spark):
    r = random.Random(8)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(160)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    want = {x.node: x.component for x in components(frame(links)).collect()}
    for cut in (1, 80, 159):
        got = merged(components(frame(links[:cut])), frame(links[cut:])).collect()
        assert {x.node: x.component for x in got} == want and len(got) == len(want)
    assert merged(components(frame(links)), frame([])).count() == len(want)
