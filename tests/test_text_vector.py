import math

from pyspark.sql import functions as F

from loomgraph.functions import text, vector


def value(spark, column, **cells):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()]).select(column.alias("v")).first().v


def test_keyword_score(spark):
    score = lambda q, d: value(spark, text.keyword_score(F.lit(q), F.col("d").cast("string")), d=d)
    assert score("alpha beta", "Alpha") == 0.5
    assert score("alpha alpha beta", "ALPHAbet x") == 2 / 3 / (1 + math.log(2))
    assert score("", "x") == 0.0 and score("  ", "x") == 0.0
    assert score("x", None) == 0.0
    assert abs(score("a", "a b c") - 1 / (1 + math.log(3))) < 1e-12


def test_summary_and_lines(spark):
    cut = lambda s: value(spark, text.summary(F.col("d").cast("string")), d=s)
    assert cut("short") == "short" and cut(None) is None
    assert cut("word " * 50) == ("word " * 40).rstrip() + "…"
    assert cut("é" * 300) == "é" * 200 + "…"
    body = lambda s, a, b: value(spark, text.body_lines(F.col("d").cast("string"), F.lit(a), F.lit(b)), d=s)
    assert body("a\nb\nc\n", 2, 3) == "b\nc" and body("a\n", 2, 3) == "" and body(None, 1, 1) == "" and body("a", 0, 1) == ""
    assert value(spark, text.line_range(F.lit(3), F.lit(None).cast("int")), d=1) == "L3"


def test_paths(spark):
    ex = lambda p, anywhere=True: value(spark, text.is_excluded(F.col("d"), anywhere=anywhere), d=p)
    assert ex("target/x") and ex("a/node_modules/b") and ex(".env") and ex("a/.git")
    assert not ex(".env.local") and not ex("targets/x") and not ex("a/target/x", False) and ex("target", False)
    lang = lambda p: value(spark, text.language_of(F.col("d")), d=p)
    assert [lang(p) for p in ("a/b.rs", "x.py", "x.go", "Makefile", ".hidden")] == ["rust", "python", "go", "unknown", "unknown"]
    glob = lambda p, g, n=False: value(spark, text.matches_glob(F.col("d"), g, n), d=p)
    assert glob("a/b/c.md", "**/*.md") and glob("c.md", "**/*.md") and glob("x.md", "[bad") and glob("q/x1.md", "x?.md", True)
    assert not glob("c.txt", "*.md") and glob("a.rs", "*.{rs,py}")
    assert value(spark, text.record_table(F.col("d")), d="task:a:b") == "task" and value(spark, text.record_table(F.col("d")), d="x") == "unknown"
    assert value(spark, text.is_binary(F.col("d")), d=bytearray(b"a\0b")) and not value(spark, text.is_binary(F.col("d")), d=bytearray(b"ab"))


def test_tier(spark):
    t = lambda body, n, doc: value(spark, text.tier(F.lit(body), F.lit(n), F.lit("fn a()"), F.lit(doc).cast("string")), d=1)
    assert tuple(t("body", 512, None)) == ("explicit_code", "body")
    assert tuple(t("body", 513, "Doc.")) == ("summary_pointer", "fn a()\n\nDoc.")
    assert t("1\n2\n3\n4\n5\n6", 513, "").summary == "fn a()\n\n1\n2\n3\n4\n5"
    assert t("", 513, None).summary == "fn a()"


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0],), ([0.7, 0.7],), ([0.0, 0.0],), ([1.0],), ([],), (None,), ([float("nan"), 1.0],), ([-1.0, 0.0],)], "e array<float>")
    out = [r.s for r in rows.select(vector.cosine(F.col("e"), vector.literal([1, 0])).alias("s")).collect()]
    assert out[0] == 1.0 and abs(out[1] - 0.70710678) < 1e-6 and out[2:6] == [0.0, 0.0, 0.0, 0.0] and out[7] == -1.0
    held = [r.s for r in rows.select(vector.score(vector.cosine(F.col("e"), vector.literal([1, 0]))).alias("s")).collect()]
    assert held[6] is None or held[6] == 0.0
    assert held[7] == 0.0
    assert [r.f for r in rows.select(vector.is_finite(F.col("e")).alias("f")).collect()] == [True, True, True, True, True, None, False, True]
    assert [r.f for r in rows.select(vector.is_meaningful(F.col("e")).alias("f")).collect()] == [True, True, False, True, False, False, True, True]


def test_similarity(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [-1.0, 0.0]), (3, None), (4, []), (5, [1.0]), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "id int, e array<float>").repartition(3)
    got = {r.id: r.s for r in df.select("id", F.round(vector.similarity(F.col("e"), [2.0, 0.0]), 6).alias("s")).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 0.0, 3: None, 4: None, 5: None, 6: 0.0, 7: None, 8: None, 9: None, 10: 0.707107}
    assert {r.s for r in df.select(vector.similarity(F.col("e"), [0.0, 0.0]).alias("s")).collect()} == {0.0, None}
    assert spark.range(1).select(vector.literal([1.5, -2e-8, 0.0]).alias("v")).first().v == [1.5, -2e-8, 0.0]
