from loomgraph.llm import docpairs as d

RUST = '''/// Counts every visible marker before the frame closes again.
#[cfg(
    feature = "extra"
)]
pub fn count(a: &str) -> usize { let s = "} /// fake"; let c = '}'; { s.len() } }

// Counts every visible marker before the frame closes again.
fn plain() {}

/// Counts every visible marker before the frame closes again.

fn apart() {}
/* /* nested */ fn no() {} */
/** Sorts incoming rows so later stages stay cheap. */ fn same_line<'a>(x: &'a u8) {}
trait T { /// Nothing here has any body at all today.
    fn decl(&self); }
//// Four slashes are an ordinary comment with many words inside.
fn four() { r#"fn inner() { "#; }
'''
SCRIPT = '''/**
 * Walks over every queued packet and drops stale ones.
 * @param {Map} items
 */
export async function walkItems(items) { const t = `}${items}`; return /[}"]/.test(t); }
class A {
  /** Reads one setting, falling back towards sane defaults. */
  readOne(key) {
    if (key) { return 1; }
  }
}
/* Walks over every queued packet and drops stale ones. */
function plain() {}
'''
PYTHON = '''class A:
    def one(self, a: dict[str, int] = {"}": 1}) -> None:
        """Keeps track of everything that moved since yesterday."""
        x = """
def fake():
    "nothing that counts as documentation in here"
"""
        return x

def two(): return 1
def three(
    a,
):
    # first a comment
    r\'\'\'Collects what other modules left behind earlier.\'\'\'
async def four():
    x = "Not the opening statement, so this describes nothing."
    "Neither does this long string further down here."
'''


def by_name(path, text):
    return {f.name: f for f in d.extract(path, text)}


def test_rust():
    f = by_name("a.rs", RUST)
    assert set(f) == {"count", "plain", "apart", "same_line", "four"}
    assert f["count"].documentation.startswith("/// Counts") and f["count"].line_start == 5 and f["count"].signature == "pub fn count(a: &str) -> usize" and f["count"].body.endswith("{ s.len() } }")
    assert f["same_line"].documentation.startswith("/** Sorts") and f["plain"].documentation == f["apart"].documentation == f["four"].documentation == ""


def test_script():
    f = by_name("a.ts", SCRIPT)
    assert set(f) == {"walkItems", "readOne", "plain"}
    assert "Walks over" in f["walkItems"].documentation and f["walkItems"].body.endswith("test(t); }") and "Reads one" in f["readOne"].documentation and not f["plain"].documentation
    assert d.comment_text(f["walkItems"].documentation) == "Walks over every queued packet and drops stale ones.\n@param {Map} items"


def test_python():
    f = by_name("a.py", PYTHON)
    assert set(f) == {"one", "two", "three", "four"}
    assert d.comment_text(f["one"].documentation).startswith("Keeps track") and f["one"].body.endswith("return x") and (f["one"].line_start, f["one"].line_end) == (2, 8)
    assert d.comment_text(f["three"].documentation).startswith("Collects") and not f["two"].documentation and not f["four"].documentation


def n(doc, name="f", signature="fn f()"):
    return len(d.own_words(doc, name, signature))


def test_words():
    assert n("/// One two three four five six.") == 6 and n("/// One one ONE two.") == 2
    assert n("/// sortZoneRows: zone rows, sort them", "sortZoneRows", "fn sortZoneRows(zone: Zone)") == 1
    assert n("/** @param alpha first second\n * @returns third */") == 4
    for nothing in (
        "/// TODO document what all of this does and why it matters so much",
        "/// Copyright (c) 2020 the authors. All rights reserved by many people.",
        "/// ----------", "/** */", '""""""', "/// Docs pending, to be filled in by the owner of this module.",
        "/// let total = count(left, right, middle, upper, lower);\n/// while let Some(row) = rows.next() { total += row.size; }",
        "/// ```\n/// one two three four five six seven\n/// ```",
    ):
        assert n(nothing) < d.LEAST_WORDS, nothing


def test_broken_sources():
    for ext in ("rs", "ts", "py"):
        for text in ("", "fn", "function f(", "def f(", '"', "'", "/*", "{{{", "}}}", "`", "fn f() {", "def f():", '"""', "#[", "\x00", "function f() {" * 300, "(" * 5000, "a = '" * 2000):
            d.extract("x." + ext, text)
    assert d.extract("x.go", RUST) == [] and d.extract("noext", RUST) == []


def test_tables(spark):
    sources = spark.createDataFrame([("a.rs", RUST, "x"), ("a.rs", RUST, "x"), ("b.ts", None, "x"), (None, RUST, "x")], "path string, source string, body string")
    functions = spark.createDataFrame([(1, "a.rs", "count", 5, "clash"), (1, "a.rs", "count", 5, "clash"), (2, "a.rs", "plain", 8, "x"), (3, "a.rs", "count", 9, "x"), (None, "a.rs", "count", 5, "x"), (4, None, None, None, None)], "fn_id long, file_path string, name string, line_start int, docstring string")
    got = d.pairs(sources, functions).collect()
    assert [(r.fn_id, r.signature, r.docstring) for r in got] == [(1, "pub fn count(a: &str) -> usize", "Counts every visible marker before the frame closes again.")]
    assert d.found(sources.limit(0), functions).count() == 0 and d.found(sources, functions.limit(0)).count() == 0


HEADS = '''class A {
  /** doc */
  constructor(a = 1, { b, c }: { b: string; c: number } = { b: ")", c: 2 }) { this.a = a; }
  /** doc */
  delete(key) { return this.map.delete(key); }
  /** doc */
  one(cb: (x: number) => void): Promise<{ a: number }> { cb(1); }
  /** doc */
  two<T extends { id: string }>(
    x: T, // with { in a comment
    y = () => { return 1; },
  ): T {
    return x;
  }
  /** doc */
  declared(a: string): void;
}
/** doc */
const three = async ({ a, b } = {}, cb: (x) => void) => { await cb(a); };
/** doc */
export const four: Handler = (x = "}"): x is string => {
  call(x, () => { return 2; });
};
/** doc */
function five({ a, b }, c = { d: 1 }): { e: number } { return { e: a }; }
delete(key);
run(key, function six() { return 3; });
'''


def test_script_heads():
    f = by_name("a.ts", HEADS)
    assert set(f) == {"constructor", "delete", "one", "two", "three", "four", "five", "six"}
    assert all(x.documentation == "/** doc */" for x in f.values() if x.name != "six") and not f["six"].documentation
    assert f["one"].signature == "one(cb: (x: number) => void): Promise<{ a: number }>" and f["one"].body.endswith("{ cb(1); }")
    assert (f["two"].line_start, f["two"].line_end) == (9, 14) and f["five"].body.endswith("{ return { e: a }; }") and f["constructor"].body.endswith("{ this.a = a; }")
