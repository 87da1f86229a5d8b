import random

from loomgraph.llm import handwritten as h

F = "id string, path string, size_bytes long, language string, same string, tool string"
S = "file_id string, path string, source string, same string, features string"

HAND = "use crate::a::Thing;\n\n/// Adds what the caller asks for.\npub fn {0}(left: u32, right: u32) -> u32 {{\n    // keep it simple\n    let total_{0} = left.wrapping_add(right);\n    if total_{0} > {1} {{ return {1}; }}\n    total_{0}\n}}\n"
WORDS = "harbor ledger orbit packet ribbon socket tablet vault window zone anchor beacon".split()


def hand(k):
    r = random.Random(k)
    return "".join(HAND.format("_".join(r.sample(WORDS, 3)), r.randint(1, 9999)) for _ in range(r.randint(2, 6)))


def made(k):
    r = random.Random(k)
    return "".join(f"pub fn get_f{i:03d}(m: &M) -> u64 {{ m.f[{i}] }}\npub fn set_f{i:03d}(m: &mut M, v: u64) {{ m.f[{i}] = v; }}\n" for i in range(r.randint(20, 60)))


def verdicts(spark, rows):
    files = spark.createDataFrame([(i, p, None, None, "x", "y") for i, p, _ in rows], F)
    sources = spark.createDataFrame([(i, p, s, "x", "y") for i, p, s in rows if s != "absent"], S)
    return {r.id: r for r in h.verdicts(files, sources).collect()}


def test_signs():
    assert h.notices("// Code generated by x. DO NOT EDIT.\n\nfn a() {}")[:2] == (True, False)
    assert h.notices("// Hello.\n// @generated by y\nfn a() {}") == (True, False, "// Hello.\nfn a() {}")
    assert h.notices("# Vendored from upstream z at revision 1\nx = 1")[:2] == (False, True)
    assert h.notices("/*! a.js v1.2.3 */\nvar a")[:2] == (True, False)
    for own in ('const B: &str = "@generated by us";', "// Do not edit a sparse node while it moves.\nfn a() {}", "use a;\n// Code generated by x. DO NOT EDIT.\n", ""):
        assert h.notices(own)[:2] == (False, False)
    hit = lambda p: bool(h._PATH.search(p))
    assert all(map(hit, ("a/vendor/b/c.rs", "node_modules/x.js", "x.min.js", "x-min.ts", "a/b_pb2.py", "a/x.pb.rs", "target/debug/build/o.rs")))
    assert not any(map(hit, ("src/vendored_parser.rs", "src/codegen/a.rs", "src/generated_beacon.py", "src/target/a.rs", "distance/x.rs", "a/minify.js")))


def test_features():
    share = lambda path, text: h.features(path, text)[0][h.FEATURES.index("code_share")]
    assert share("a.rs", "pub const T: [u8; 900] = [" + "0x78, " * 900 + "];") < h.DATA_SHARE
    assert share("a.py", 'X = ("' + "Ab9/" * 300 + '")') < h.DATA_SHARE
    assert share("a.rs", hand(1) + 'let s = "' + "lorem " * 60 + '";') > h.CLEAR_SHARE
    assert h.features("vendor/a.rs", "fn a() {}")[0][-1] == 1.0 and h.features("src/a.rs", "fn a() {}")[0][-1] == 0.0
    for odd in ("", "\n", "é" * 10, "\x00", '"' * 99, "x" * 300_000):
        assert len(h.features("a.py", odd)[0]) == len(h.FEATURES)


def collection(scale=1):
    rows = [(f"h{k}", f"src/h{k}.rs", hand(k)) for k in range(60 * scale)]
    rows += [(f"g{k}", f"src/g{k}.rs", "// Code generated by x. DO NOT EDIT.\n" + made(k)) for k in range(12 * scale)]
    rows += [(f"v{k}", f"vendor/a{k}/b.rs", "// Vendored from upstream a at revision 1.\n" + hand(5000 + k)) for k in range(12 * scale)]
    return rows + [(f"d{k}", f"src/d{k}.rs", "pub const T: [u16; 400] = [" + ", ".join(str((i * (k + 3)) % 997) for i in range(400)) + "];\n") for k in range(8 * scale)]


def test_verdicts(spark):
    """What carries a notice teaches the forest what does not: all of that is found, and hardly a file too many (the forest needs examples; of
    a few dozen it learns chance)."""
    rows = collection(5)
    quiet = [(f"quiet{k}", f"src/quiet{k}.rs", made(900 + k)) for k in range(10)]
    vend = [(f"vend{k}", f"vendor/z{k}/b.rs", hand(9000 + k)) for k in range(10)]
    rows += [*quiet, *vend, ("copy", "src/copy.rs", hand(9000)), ("big", "src/big.rs", None), ("gone", "src/gone.rs", "absent"), ("h0", "src/h0.rs", hand(0)), ("odd", "src/odd.rs", "// Imported copy of z.\n" + hand(9100))]
    got = verdicts(spark, rows)
    want = {i for i, _, _ in rows if i[0] in "gvdq" and i != "gone"} | {"copy", "big", "odd"}
    assert want <= set(got) and len(set(got) - want) <= 0.02 * 300
    assert all(got[i].by_forest and not got[i].by_notice for i, _, _ in quiet + vend) and got["d0"].by_forest and got["g0"].by_forest and got["g0"].by_notice
    assert got["copy"].by_copy and got["big"].by_size and got["odd"].by_notice


def test_held_out(spark):
    rows = [(f"{i}-{k}", p, s) for k in range(3) for i, p, s in collection()]
    sources = spark.createDataFrame([(i, p, s, "x", "y") for i, p, s in rows], S)
    n = {(r.kind, r.forest): r.n for r in h.evaluation(sources).collect()}
    right = n.get(("hand", False), 0) + sum(n.get((k, True), 0) for k in ("tool", "third", "data"))
    assert right >= 0.95 * sum(n.values()) and sum(n.values()) >= 0.1 * len(rows)


def test_empty(spark):
    assert verdicts(spark, []) == {}
    assert verdicts(spark, [("a", "src/a.rs", hand(1)), (None, None, None)]) == {}
    assert set(verdicts(spark, [("a", None, hand(1)), ("b", "x.min.js", None)])) == {"b"}
