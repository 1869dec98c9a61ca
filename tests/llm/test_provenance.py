import random

from lakeloom.llm import provenance as P


def _code(seed, n=40):
    r = random.Random(seed)
    forms = ["let {a} = {b}.map(|x| x + {n});", "if {a} > {n} {{ return {b}; }}", "for {a} in {b}.iter() {{ {a}.push({n}); }}", "match {a} {{ Some(v) => {b} += v, None => stop({n}) }}", "{a}.insert(\"{b}\", {n});", "let mut {b} = Vec::with_capacity({n});", "self.{a}({b}, {n})?;", "while let Some({a}) = {b}.pop() {{ drop({a}); }}"]
    return "\n".join(r.choice(forms).format(a=r.choice("abcdefg") + "x", b=r.choice("hijklm") + "y", n=r.randrange(999)) for _ in range(n))


def test_kinds(spark):
    lib = _code(1)
    rows = [
        ("r1", "src/a.rs", _code(2)), ("r1", "src/util/x/lib.rs", lib), ("r2", "lib/common/y/lib.rs", "// other head\n" + lib), ("r1", "src/gen.rs", "// Code generated by x-gen 1. DO NOT EDIT.\n" + _code(3)),
        ("r1", "pb/m.pb.go", _code(4)), ("r2", "src/talk.rs", _code(5) + '\n// prints DO NOT EDIT into the output\nout("# Code generated by tool. DO NOT EDIT.");'), ("r2", "src/generators/t.rs", _code(6)),
        ("r1", "dist/app.js", "var a=1;" + "!function(q){e.v&&(x=7)}(e);" * 60), ("r1", "data/t.py", "T = [\n" + "1, 2, 3, 4,\n" * 80 + "]"), ("r1", "x/package-lock.json", '{"a": {"integrity": "sha512-x"}}'), ("r1", "x/node_modules/z/1.2.3/i.js", "x"),
        ("r1", "docs/a.md", "# Code generated by x-gen"), ("r1", "empty.py", ""), ("r1", "null.py", None),
    ]
    df = spark.createDataFrame([(f"i{k}", r, p, "file", 1, c, "e") for k, (r, p, c) in enumerate([*rows, rows[0]])], "id string, repo_name string, module_path string, chunk_type string, start_line int, content string, family string")
    got = {(r["repo_name"], r["module_path"]): r["kind"] for r in P.classify(spark, df).collect()}
    assert {k: v for k, v in got.items() if v} == {
        ("r1", "src/util/x/lib.rs"): "vendored", ("r2", "lib/common/y/lib.rs"): "vendored", ("r1", "src/gen.rs"): "generated", ("r1", "pb/m.pb.go"): "generated", ("r1", "dist/app.js"): "minified",
        ("r1", "data/t.py"): "blob", ("r1", "x/package-lock.json"): "lock", ("r1", "x/node_modules/z/1.2.3/i.js"): "vendored",
    }
    assert len(got) == len(rows)


def test_crowded_bucket_loses_no_link(spark, monkeypatch):
    """A bucket over several blocks: all copies still meet."""
    monkeypatch.setattr(P, "BLOCK", 3)
    lib = _code(9, 60)
    rows = [(f"i{k}", f"r{k}", f"u/x{k}.rs", "file", 1, lib + f"\nlet extra{k} = {k};") for k in range(11)]
    df = spark.createDataFrame(rows, "id string, repo_name string, module_path string, chunk_type string, start_line int, content string")
    out = P.classify(spark, df).collect()
    assert len({r["copy"] for r in out}) == 1 and all(r["kind"] == "vendored" for r in out)


def test_empty(spark):
    df = spark.createDataFrame([], "id string, repo_name string, module_path string, chunk_type string, start_line int, content string")
    assert P.classify(spark, df).count() == 0


COLUMNS = "id string, repo_name string, module_path string, chunk_type string, start_line int, content string"


def _kinds(spark, rows):
    df = spark.createDataFrame([(f"i{k}", r, p, "file", 1, c) for k, (r, p, c) in enumerate(rows)], COLUMNS)
    return {(r["repo_name"], r["module_path"]): r["kind"] for r in P.classify(spark, df).collect()}


def test_cluster_decides_for_members_without_a_mark(spark):
    body, other = _code(20, 80), _code(21, 80)
    notice = "// Code generated by x-gen 1. DO NOT EDIT.\n"
    nums = "1, 22, 333, 4,\n"
    got = _kinds(spark, [
        ("r1", "a.rs", notice + body), ("r1", "b.rs", notice + body + "\nlet q = 3;"), ("r1", "c.rs", body + "\nlet z = 9;"),  # a family, two of three marked
        ("r6", "x/node_modules/z/i.rs", other), ("r6", "src/own/i.rs", other), ("r7", "g.rs", notice + _code(24, 80)), ("r7", "h.rs", _code(25, 80)), ("r7", "i.rs", _code(26, 80)),  # a copy of a package's file
        ("r2", "t1.py", "T = [\n" + nums * 60 + "]"), ("r2", "t2.py", "T = [\n" + nums * 75 + "]"), ("r2", "v.py", "T = [\n" + nums + "]"),  # short masked texts cluster; a small list is no blob's size
        ("r3", "h1.rs", _code(22, 80)), ("r3", "h2.rs", _code(23, 80)), ("r4", "e1.py", "import a"), ("r5", "e2.py", "import a"),
    ])
    assert {k: v for k, v in got.items() if v} == {
        ("r1", "a.rs"): "generated", ("r1", "b.rs"): "generated", ("r1", "c.rs"): "generated", ("r6", "x/node_modules/z/i.rs"): "vendored", ("r6", "src/own/i.rs"): "vendored", ("r7", "g.rs"): "generated",
        ("r2", "t1.py"): "blob", ("r2", "t2.py"): "blob", ("r2", "v.py"): "blob",
    }


def test_notice_far_down_the_head(spark):
    head = "".join(f"// remark {i}\n" for i in range(90)) + "// @generated\n"
    assert _kinds(spark, [("r", "a.rs", head + _code(30))]) == {("r", "a.rs"): "generated"}


def test_forest_keeps_chains_and_prefers_the_most_similar():
    import numpy as np

    sim = np.array([[1, 0.85, 0.1, 0], [0.85, 1, 0.95, 0], [0.1, 0.95, 1, 0], [0, 0, 0, 1]], dtype=np.float32)
    assert {tuple(sorted(p)) for p in P.forest(sim)} == {(0, 1), (1, 2)}


def test_bucket_of_unlike_centres_ends(spark, monkeypatch):
    """Centres that don't get fewer are worked by pairs of blocks: it ends, and no link is lost."""
    monkeypatch.setattr(P, "BLOCK", 2)
    monkeypatch.setattr(P, "band_hashes", None, raising=False)
    from pyspark.sql import functions as F

    from lakeloom.sources.tables import Scratch

    texts = [_code(40 + i, 30) for i in range(6)]
    rows = [(f"r{i}", f"f{i}", t) for i, t in enumerate([*texts, texts[4] + "\nlet a = 1;"])]
    monkeypatch.undo()
    feats = P.features(spark.createDataFrame(rows, "repo_name string, module_path string, content string"))
    one = F.array(F.lit(7).cast("long"))
    s = Scratch(spark, "test")
    feats = s.save(feats.withColumns({"over": one, "kin": F.array().cast("array<long>")}), "f")
    monkeypatch.setattr(P, "BLOCK", 2)
    found = P.links(feats, s).select("key", "other").collect()
    assert [sorted(k.split("\x00")[1] for k in r) for r in found] == [["f4", "f6"]]
