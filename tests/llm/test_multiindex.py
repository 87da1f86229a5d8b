import numpy as np

from loomgraph.llm import multiindex as m

S = "id string, kind string, embed_type string, embedding array<float>, loaded_at timestamp_ntz, cell int, same string"


def frame(spark, rows):
    return spark.createDataFrame([(i, k, t, [float(x) for x in v] if v is not None else None, None, 7, "clash") for i, k, t, v in rows], S)


def plain(rows):
    own = {}
    for i, k, t, v in rows:
        if i is not None and k == "interface" and t in m.TYPES and v is not None and len(v) == m.DIMENSIONS and np.isfinite(v).all() and np.any(np.asarray(v) != 0):
            x = np.asarray(v, np.float32).astype(np.float64)
            own[i] = (t, x / np.linalg.norm(x))
    out = set()
    for i, (t, x) in own.items():
        near = sorted((-round(float(x @ y), 6), j) for j, (u, y) in own.items() if u == t and j != i and round(float(x @ y), 6) >= m.LEAST_SIMILARITY)
        out |= {(min(i, j), max(i, j)) for _, j in near[: m.K]}
    return out


def found(spark, rows):
    return {tuple(r) for r in m.pairs(m.neighbours(frame(spark, rows))).collect()}


def clustered(count, seed=3):
    r = np.random.default_rng(seed)
    rows, k = [], 0
    while k < count:
        centre = r.normal(size=m.DIMENSIONS)
        for _ in range(r.integers(1, 12)):
            rows.append((f"interface:{k:05d}", "interface", m.TYPES[k % 7 == 0], (centre + r.normal(size=m.DIMENSIONS) * r.uniform(0, 0.9)) * r.uniform(0.2, 6)))
            k += 1
    return rows


def test_small(spark):
    rows = clustered(300)
    v = rows[0][3]
    rows += [(f"interface:dup{i:02d}", "interface", "explicit_code", rows[1][3]) for i in range(20)]
    rows += [("x1", "class", "explicit_code", v), ("x2", "interface", None, v), ("x3", "interface", "other", v), ("x4", "interface", "explicit_code", None), ("x5", "interface", "explicit_code", []), ("x6", "interface", "explicit_code", v[:383])]
    rows += [("x7", "interface", "explicit_code", np.zeros(384)), ("x8", "interface", "explicit_code", [float("nan"), *v[1:]]), ("x9", "interface", "explicit_code", [float("inf"), *v[1:]]), (None, "interface", "explicit_code", v), rows[3]]
    assert found(spark, rows) == plain(rows)


def test_recall(spark):
    """Against brute force, with a visit of a hundredth of the collection; and exact where all is visited."""
    rows = clustered(3000, 8)
    want = plain(rows)
    got = {tuple(r) for r in m.pairs(m.neighbours(frame(spark, rows), visit=30)).collect()}
    assert len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.97 * len(got)
    assert {tuple(r) for r in m.pairs(m.neighbours(frame(spark, rows), visit=len(rows))).collect()} == want


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_ROWS", 10)
    begin, wide, count = m.blocks(np.array([[4, 5, 0], [3, 25, 2]]), np.array([0, 1, 3, 4, 5]))
    assert begin.tolist() == [0, 0, 0, 1, 2, 5] and wide.tolist() == [1, 1, 1, 1, 3, 1] and count == 6
    rows = clustered(300)
    rows += [(f"near{i:03d}", "interface", "explicit_code", rows[0][3] * (1 + i / 1000)) for i in range(60)]  # one crowded cell
    assert found(spark, rows) == plain(rows)


def test_moved_rows(monkeypatch):
    """What moves follows the visits: entries by the slices of their own block, queries by the blocks they visit."""
    monkeypatch.setattr(m, "BLOCK_ROWS", 400)
    monkeypatch.setattr(m, "SLICE_ROWS", 800)
    moved = []
    for count in (2000, 8000, 32_000):
        r = np.random.default_rng(9)
        centres = r.normal(size=(count // 5, m.DIMENSIONS))
        x = m.unit(np.repeat(centres, 5, axis=0) + 0.5 * r.normal(size=(count, m.DIMENSIONS)))
        books = m.fit(x[:: max(1, count // 2000)], 32)
        cell = m.distances(x[:, :192], books[0]).argmin(1) * 32 + m.distances(x[:, 192:], books[1]).argmin(1)
        sizes = np.bincount(cell, minlength=1024).reshape(32, 32)
        plan = m.planned(sizes, 32, books, x[:: max(1, count // 2000)], 60)
        entries = sum(int(plan.slices[plan.begin[c] + lane]) * n // plan.wide[c] for c, n in enumerate(sizes.ravel()) for lane in range(plan.wide[c]))
        moved.append(entries / count)
    assert max(moved) < 3 and moved[-1] < 2 * moved[0]


def test_hot_region(spark, monkeypatch):
    """A third of all vectors lie close together: all but the best hits are dropped on the way, none of the best."""
    monkeypatch.setattr(m, "HITS", 2000)
    monkeypatch.setattr(m, "TILE", 64)
    r = np.random.default_rng(4)
    rows, centre = clustered(300), r.normal(size=m.DIMENSIONS)
    rows += [(f"hot{i:03d}", "interface", "explicit_code", centre + 0.3 * r.normal(size=m.DIMENSIONS)) for i in range(150)]
    got = {tuple(x) for x in m.pairs(m.neighbours(frame(spark, rows), visit=len(rows))).collect()}
    assert got == plain(rows)


def test_traverse_in_order():
    r = np.random.default_rng(1)
    sizes = r.integers(0, 3, (12, 12))
    lists = [np.flatnonzero(x) for x in sizes]
    d1, d2 = r.random(12), r.random(12)
    order = [divmod(c, 12) for c in m.traverse(d1, d2, lists, sizes, 10**9)]
    sums = [d1[i] + d2[j] for i, j in order]
    assert sums == sorted(sums) and set(order) == {(i, j) for i in range(12) for j in range(12) if sizes[i, j]}
    assert sizes[tuple(zip(*[divmod(c, 12) for c in m.traverse(d1, d2, lists, sizes, 20)]))].sum() >= 20


def test_empty_and_ranks(spark):
    assert found(spark, []) == set()
    one = np.eye(1, m.DIMENSIONS)[0]
    assert found(spark, [("a", "interface", "explicit_code", one)]) == set()
    rows = [(f"i{k}", "interface", "explicit_code", one * (k + 1)) for k in range(9)]
    got = m.neighbours(frame(spark, rows)).where("id = 'i8'").orderBy("rank").collect()
    assert [(r.neighbour, r.similarity, r.rank) for r in got] == [(f"i{k}", 1.0, k + 1) for k in range(5)]
