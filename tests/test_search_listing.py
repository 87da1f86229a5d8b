import pytest
from pyspark.sql import functions as F

from loomgraph.errors import LoomError
from loomgraph.operators import listing, search

S = "id string, kind string, name string, file_path string, line_start int, line_end int, embedding array<float>, summary string"
R = "id string, content_type string, file_path string, content string, embedding array<float>"


@pytest.fixture(scope="module")
def symbols(spark):
    nan = float("nan")
    return spark.createDataFrame(
        [
            ("function:a", "function", "alpha", "x.rs", 1, 2, [1.0, 0.0], "alpha text"),
            ("function:b", "function", "beta", "x.rs", 3, 9, [0.0, 1.0], "beta text"),
            ("class:c", "class", "alpha", "y.rs", 1, 2, [0.7, 0.7], None),
            ("interface:z", "interface", "gamma", "y.rs", 5, 6, [0.0, 0.0], ""),
            ("interface:n", "interface", "nanny", "y.rs", 7, 8, [nan, 1.0], ""),
            ("interface:0", "interface", "none", "z.rs", 1, 1, None, ""),
        ],
        S,
    )


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([("1", "spec", "a.md", "the alpha rule", [1.0, 0.0]), ("2", "doc", "b.md", "alpha alpha beta", None), ("3", "doc", "c.md", None, [0.0, 1.0]), ("4", "doc", "d.md", "", [1.0, 0.0])], R)


def test_nearest(symbols):
    out = search.nearest_symbols(symbols, [1.0, 0.0], 10).collect()
    assert [r.id for r in out] == ["function:a", "class:c", "function:b", "interface:z"]
    assert out[0].score == 1.0 and all(0 <= r.score <= 1 for r in out)
    assert search.nearest_symbols(symbols, [1.0, 0.0], 0).count() == 0
    assert [r.id for r in search.nearest_symbols(symbols, [1.0, 0.0], 5, ("class",)).collect()] == ["class:c"]
    assert search.nearest_symbols(symbols.limit(0), [1.0, 0.0], 5).count() == 0


def test_content(records):
    assert [r.id for r in search.nearest_content(records, [1.0, 0.0], 2).collect()] == ["1", "4"]
    assert [r.id for r in search.nearest_content(records, [1.0, 0.0], 5, "doc").collect()] == ["4", "3"]
    assert [r.id for r in search.keyword_search(records, "alpha", 2).collect()] == ["1", "2"]
    out = {r.id: r.score for r in search.hybrid_search(records, "beta", [1.0, 0.0], 10).collect()}
    assert set(out) == {"1", "2", "3", "4"} and out["1"] == 0.7 and out["3"] == 0.0
    assert [r.id for r in search.content_by_keyword(records, "beta alpha").orderBy(F.desc("score"), "id").collect()] == ["2", "1"]


def test_unified(symbols, records):
    out = search.unified(symbols, records, " alpha ", [1.0, 0.0], 4).collect()
    assert [(r.region, r.id) for r in out][:3] == [("code", "function:a"), ("content", "1"), ("content", "4")]
    assert out[0].line_range == "L1-L2"
    assert [r.id for r in search.unified(symbols, records, "alpha", None, 4).collect()] == ["1", "2"]
    for bad, name in (("  ", "QueryEmpty"), ("x" * 2001, "QueryTooLong")):
        with pytest.raises(LoomError) as e:
            search.unified(symbols, records, bad, None)
        assert e.value.name == name
    with pytest.raises(LoomError):
        search.unified(symbols, records, "x", None, region="task")


def test_precision(spark):
    got = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 6), ("p", "x", 1)], "query string, id string, rank int")
    want = spark.createDataFrame([("q", "a"), ("q", "c"), ("p", "y")], "query string, id string")
    assert search.precision_at(got, want).first().precision == 0.25


def test_pages(symbols):
    where = listing.symbol_filter(name="a")
    assert [r.id for r in listing.page(symbols, where).collect()] == ["class:c", "function:a", "function:b", "interface:z", "interface:n"]
    assert [r.id for r in listing.page(symbols, where, 1, 1).collect()] == ["function:a"]
    assert [r.id for r in listing.page(symbols, where, 1, 0, per_kind=True).collect()] == ["class:c", "function:a", "interface:z"]
    assert [r.id for r in listing.page(symbols, listing.symbol_filter("y.rs", "nonsense", "a")).collect()] == ["class:c", "interface:z", "interface:n"]
    assert {r.id for r in listing.page(symbols, listing.symbol_filter("y.rs", None, "al", loose=True)).collect()} == {"class:c", "function:a"}
    assert tuple(listing.total(symbols, where, 2, 0).first()) == (5, True) and tuple(listing.total(symbols, where, 5, 0).first()) == (5, False)
    assert [r.kind for r in listing.by_name(symbols, "alpha").collect()] == ["function", "class"]


def test_counts(spark, symbols):
    edges = spark.createDataFrame([("calls", "function:a", "function:b")], "edge_type string, src string, dst string")
    files = spark.createDataFrame([("code_file:1", "x.rs")], "id string, path string")
    s = listing.statistics(files, symbols, edges).first()
    assert (s.code_files, s.functions, s.classes, s.interfaces, s.edges, s.total_symbols) == (1, 2, 1, 3, 1, 6)
    assert s.symbols_with_embeddings == 4 and s.coverage_percent == 66.666667
    empty = listing.statistics(files.limit(0), symbols.limit(0), edges.limit(0)).first()
    assert (empty.code_files, empty.functions, empty.total_symbols, empty.coverage_percent) == (0, 0, 0, 0.0)
