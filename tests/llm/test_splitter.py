from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import splitter as s


def check(text, limit, overlap):
    pieces = s.cut(text, limit, overlap)
    limit, done, out = max(1, limit), 0, ""
    for k, (a, b) in enumerate(pieces):
        assert a <= done < b or not text
        assert len(text[a:b].encode()) // 4 <= limit
        assert k == 0 or len(text[a:done].encode()) // 4 <= min(max(0, overlap), limit - 1)
        out += text[done:b]
        done = b
    assert out == text
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t{}é日🚀", max_size=300), st.integers(-1, 12), st.integers(-1, 14))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


def test_boundaries():
    text = "a1\na2\n\nb1\nb2\n\nc1\nc2\n"
    assert [text[a:b] for a, b in s.cut(text, 2, 0)] == ["a1\na2\n\n", "b1\nb2\n\n", "c1\nc2\n"]
    lines = "alpha\nbeta\ngamma\ndelta\n"
    assert [lines[a:b] for a, b in s.cut(lines, 2, 0)] == ["alpha\nbeta\n", "gamma\n", "delta\n"]
    assert [lines[a:b] for a, b in s.cut("x\n" + "y" * 60, 9, 0)][0] == lines[:2]  # an early boundary counts too
    assert [len("x" * 100) and b - a for a, b in s.cut("x" * 100, 5, 0)] == [23, 23, 23, 23, 8]
    over = s.cut("x" * 100, 5, 2)
    assert all(d - c == 8 for (_, d), (c, _) in zip(over, over[1:]))
    check("x" * 500_000 + "\n" + "日" * 100_000, 512, 64)


def test_units_at_the_outermost_indent():
    def blocks(text):
        return [text[i:].split("\n")[0].strip() for i in s.boundaries(text)[0]]

    assert blocks("def a():\n    x\ndef b():\n    y\n    z\ndef c():\n    w") == ["def b():", "def c():"]
    assert blocks("fn a() {\n    x;\n}\nfn b() {\n    y;\n}\n") == ["fn b() {"]
    assert blocks("fn f() {\n    let a;\n    for x {\n        y;\n    }\n    let b;\n    if z {\n        w;\n    }\n}") == ["let b;"]
    assert blocks("a\nb\nc\n") == [] and blocks("") == [] and blocks("a\n\n\nb\n\n") == ["b"]
    text = "def a():\n    xxxx\ndef b():\n    yyyy\ndef c():\n    zzzz\n"
    assert [text[a:b] for a, b in s.cut(text, 9, 0)] == ["def a():\n    xxxx\ndef b():\n    yyyy\n"[:18] + "def b():\n    yyyy\n", "def c():\n    zzzz\n"]


def plain_cut(text, limit, overlap):
    """The rule without arrays: the longest piece that ends at a block, else at a line, else anywhere."""
    limit, overlap = max(1, limit), min(max(0, overlap), max(1, limit) - 1)
    blocks, lines = (set(x.tolist()) for x in s.boundaries(text))
    if len(text.encode()) // 4 <= limit:
        return [(0, len(text))]
    out, begin, known = [], 0, 0
    while True:
        fits = [e for e in range(known + 1, len(text) + 1) if len(text[begin:e].encode()) // 4 <= limit] or [known + 1]
        if fits[-1] == len(text):
            return [*out, (begin, len(text))]
        end = next((max(e for e in fits if e in marks) for marks in (blocks, lines) if any(e in marks for e in fits)), fits[-1])
        out.append((begin, end))
        back = [b for b in range(begin + 1, end + 1) if len(text[b:end].encode()) <= 4 * overlap]
        begin, known = min(back, default=end), end


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n{}é日", max_size=120), st.integers(1, 9), st.integers(0, 9))
def test_against_plain_rule(text, limit, overlap):
    assert s.cut(text, limit, overlap) == plain_cut(text, limit, overlap)


def test_tables(spark):
    f = spark.createDataFrame(
        [(1, "w", "x" * 100, 1, "k"), (1, "w", "x" * 100, 1, "k"), (2, "w", "x" * 19, 99, "k"), (3, "none", "y" * 2052, None, "k"), (4, "none", "y" * 2051, 1, "k"), (5, None, "z" * 3000, 1, "k"), (6, "w", None, 1, "k"), (7, "w", "", 1, "k"), (None, "w", "x" * 100, 1, "k"), (8, "n", "é" * 1026, 1, "k")],
        "fn_id long, workspace string, body string, token_count int, token_limit string",
    )
    c = spark.createDataFrame([("w", 4, 1, "k"), ("w", 4, 1, "k"), ("n", None, 0, "k")], "workspace string, token_limit int, overlap_tokens int, body string")
    assert sorted(r.fn_id for r in s.oversized(f, c).collect()) == [1, 3, 5, 8]
    got = s.split_bodies(f, c).where("fn_id = 1").orderBy("piece").collect()
    assert "".join(r.text[r.overlap_chars :] for r in got) == "x" * 100 and max(r.token_count for r in got) == 4 and [r.piece for r in got] == list(range(len(got)))
    assert s.oversized(f.limit(0), c).count() == 0 and sorted(r.fn_id for r in s.oversized(f, c.limit(0)).collect()) == [3, 5, 8]


def test_limits_below_one(spark):
    f = spark.createDataFrame([(1, "zero", "abcd"), (2, "zero", "abc"), (3, "less", ""), (4, "less", "abcdefgh"), (5, "less", None), (6, "zero", "")], "fn_id long, workspace string, body string")
    c = spark.createDataFrame([("zero", 0, 0), ("less", -1, 0)], "workspace string, token_limit int, overlap_tokens int")
    assert sorted(r.fn_id for r in s.oversized(f, c).collect()) == [1, 3, 4]
    got = s.split_bodies(f, c).orderBy("fn_id", "piece").collect()
    assert {r.fn_id: "".join(x.text for x in got if x.fn_id == r.fn_id) for r in got} == {1: "abcd", 3: "", 4: "abcdefgh"} and max(r.token_count for r in got) == 1
