import math

import pytest

from loamdex.operators import evaluate as EV, graph as G, tables as T

E = "source_id string, target_id string, edge_type string, metadata map<string,string>"


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, t, m[0] if m else None) for a, b, t, *m in rows], E)


def ids(df):
    return sorted(r["node_id"] for r in df.collect())


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def test_small_graph(spark):
    e = edges(spark, ("s1", "s2", "DEFINES"), ("s2", "s3", "CALLS"), ("s2", "s3", "CALLS"))
    assert ids(G.callers(e, "s3")) == ["s2"] and ids(G.callees(e, "s2")) == ["s3"]
    assert ids(G.neighbourhood(e, nodes(spark, "s2"))) == ["s1", "s2", "s3"]
    assert ids(G.neighbourhood(e, nodes(spark, "alone"))) == ["alone"]
    assert ids(G.neighbourhood(e, nodes(spark, "s1"), 2, ["DEFINES"])) == ["s1", "s2"]
    assert {(r["node_id"], r["is_direct"]) for r in G.impact(e, nodes(spark, "s1")).collect()} == {("s2", True)}


def test_impact_on_a_loop(spark):
    e = edges(spark, ("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("d", "a", "CALLS"), ("x", "y", "IMPORTS"))
    assert ids(G.impact(e, nodes(spark, "a"))) == ["a", "b", "c", "d"]
    assert ids(G.impact(e, nodes(spark, "y"))) == []


def test_flow(spark):
    e = edges(spark, ("a", "c", "CALLS"), ("a", "b", "CALLS"), ("b", "d", "CALLS"), ("c", "d", "CALLS"), ("d", "a", "CALLS"))
    got = sorted((r["path"], r["depth"]) for r in G.trace_flow(e, nodes(spark, "a")).collect())
    assert got == [("a", 0), ("a > b", 1), ("a > b > d", 2), ("a > c", 1)]
    assert len(G.trace_flow(e, nodes(spark, "a"), 1).collect()) == 3


def test_linker_rules(spark):
    s = spark.createDataFrame([
        ("p/a.py:run", "p/a.py", "function", "run", 1), ("p/a.py:load", "p/a.py", "function", "load", 9), ("p/b.py:load", "p/b.py", "function", "load", 1), ("q/c.py:only", "q/c.py", "function", "only", 1),
        ("q/d.py:Base", "q/d.py", "class", "Base", 1), ("p/k.py:Kid", "p/k.py", "class", "Kid", 1), ("p/k.py:go", "p/k.py", "function", "go", 5),
    ], "node_id string, file_path string, kind string, name string, start_line int")
    e = edges(
        spark, ("p/a.py:run", "call:load", "CALLS"), ("p/k.py:go", "call:load", "CALLS"), ("p/k.py:go", "call:b.load", "CALLS"), ("p/k.py:go", "call:self.only", "CALLS"), ("nobody", "call:only", "CALLS"),
        ("p/k.py:Kid", "symbol:Base", "INHERITS"), ("p/k.py:go", "call:go", "CALLS"), ("p/k.py:go", "call:unknown", "CALLS"),
        ("file:p/k.py", "symbol:p.b.load", "IMPORTS", {"module": "p.b", "name": "load", "alias": None, "line": "2"}), ("file:p/k.py", "symbol:p.b", "IMPORTS", {"module": "p", "name": "b", "alias": None, "line": "1"}),
    )
    got = {(r["source_id"], r["original"]): (r["target_id"], r["rule"]) for r in G.link(s, e).collect()}
    assert got == {
        ("p/a.py:run", "call:load"): ("p/a.py:load", 2), ("p/k.py:go", "call:load"): ("p/b.py:load", 3), ("p/k.py:go", "call:b.load"): ("p/b.py:load", 3),
        ("p/k.py:go", "call:self.only"): ("q/c.py:only", 4), ("nobody", "call:only"): ("q/c.py:only", 5), ("p/k.py:Kid", "symbol:Base"): ("q/d.py:Base", 5),
    }
    after = G.linked_edges(e, G.link(s, e))
    assert after.count() == e.count()
    assert after.where("target_id = 'p/a.py:load'").first()["metadata"] == {"original_target": "call:load", "resolved": "true"}


def test_export(spark, tmp_path):
    e = edges(spark, ('A"', "B<", "CALLS"))
    s = spark.createDataFrame([("A", "function", "A", "a.py")], "node_id string, kind string, name string, file_path string")
    assert G.dot_lines(e).first()[0] == '  "A\\"" -> "B<" [label="CALLS"];'
    assert '&quot;' in G.graphml_lines(e).first()[0] and "&lt;" in G.graphml_lines(e).first()[0]
    G.export_graph(s, e, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/links")).count() == 1
    with pytest.raises(ValueError):
        G.export_graph(s, e, str(tmp_path / "h"), "pdf")


def test_resolve_order(spark):
    got = [r[0] for r in G.resolve(nodes(spark, "call:handle", "x/handle", "symbol:handle", "a:handle", "other"), "handle").collect()]
    assert got == ["a:handle", "x/handle", "symbol:handle", "call:handle"]


def test_manifest_changes(spark, rows):
    f = "file_path string, content_hash string, mtime double, size bigint"
    old = spark.createDataFrame([("same", "h", 1.0, 5), ("touched", "h", 1.0, 5), ("changed", "h", 1.0, 5), ("deleted", "h", 1.0, 5), ("nulls", None, None, None)], f)
    new = spark.createDataFrame([("same", "x", 1.00001, 5), ("touched", "h", 2.0, 5), ("changed", "g", 1.0, 6), ("added", "h", 1.0, 5), ("nulls", None, None, None)], f)
    assert dict(rows(T.manifest_changes(old, new))) == {"same": "same", "touched": "touched", "changed": "changed", "deleted": "deleted", "added": "added", "nulls": "changed"}


def test_upsert_and_ignore(spark, rows):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), (None, 1, "c"), ("k", None, "z")], "k string, seq int, v string")
    assert sorted(r["v"] for r in T.upsert(d, ["k"], [F.col("seq")]).collect()) == ["b", "c"]
    assert sorted(r["v"] for r in T.insert_ignore(d, ["k"], [F.col("seq")]).collect()) == ["a", "c"]


def test_remove_files(spark):
    t = {
        "symbols": spark.createDataFrame([("a:f", "a"), ("b:g", "b")], "node_id string, file_path string"), "edges": edges(spark, ("a:f", "b:g", "CALLS"), ("b:g", "call:x", "CALLS"), ("b:g", "a:f", "CALLS")),
        "chunks": spark.createDataFrame([("c1", "a"), ("c2", "b")], "chunk_id string, file_path string"), "chunk_vectors": spark.createDataFrame([("c1",), ("c2",)], "chunk_id string"),
        "file_manifest": spark.createDataFrame([("a",), ("b",)], "file_path string"),
    }
    left = T.remove_files(t, spark.createDataFrame([("a",)], "file_path string"))
    assert {k: v.count() for k, v in left.items()} == {k: 1 for k in t}


def test_intervals_against_brute_force(spark):
    import random

    r = random.Random(3)
    side = lambda p: [("f" if r.random() < 0.9 else "g", f"{p}{i}", s, s + r.randrange(300)) for i in range(80) for s in [r.randrange(1, 1000)]] + [("f", f"{p}n", None, 4), ("f", f"{p}b", 9, 3)]
    left, right = side("l"), side("r")
    f = "file_path string, id string, first int, last int"
    want = {(a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] and b[2] and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and a[3] >= b[2]}
    got = EV.interval_matches(spark.createDataFrame(left, f), spark.createDataFrame(right, f)).collect()
    assert {(g["left_id"], g["right_id"]) for g in got} == want and len(got) == len(want)


def test_ndcg(spark):
    asked = spark.createDataFrame([("q", 2), ("p", 1), ("n", 0), ("none", 3)], "query string, n_targets int")
    hits = spark.createDataFrame([("q", 1), ("q", 1), ("q", 3), ("p", 12), ("n", 1)], "query string, rank int")
    got = {r["query"]: (round(r["ndcg"], 6), r["top1"]) for r in EV.ndcg(asked, hits).collect()}
    best = 1 + 1 / math.log2(3)
    assert got == {"q": (round(1.5 / best, 6), 1), "p": (0.0, 0), "n": (0.0, 1), "none": (0.0, 0)}


def test_evaluation(spark):
    results = spark.createDataFrame([("q", 1, "src/a.py", 1, 9), ("q", 2, "src/b.py", 20, 30), ("q", 3, "src/b.py", 1, 9), ("r", 1, "x.py", 1, 2)], "query string, rank int, file_path string, start_line int, end_line int")
    targets = spark.createDataFrame([("q", "symbol", "b.py", 5, 6), ("q", "symbol", "repo/src/a.py", None, None), ("r", "semantic", "y.py", None, None), ("none", "semantic", None, None, None)], "query string, category string, path string, start_line int, end_line int")
    assert {(r["query"], r["target"]["path"], r["rank"]) for r in EV.first_hits(results, targets).collect()} == {("q", "b.py", 3), ("q", "repo/src/a.py", 1)}
    per, means = EV.evaluation(results, targets)
    got = {r["query"]: (r["n_targets"], round(r["ndcg10"], 4), r["top1"]) for r in per.collect()}
    assert got == {"q": (2, round(1.5 / (1 + 1 / math.log2(3)), 4), 1), "r": (1, 0.0, 0), "none": (0, 0.0, 0)}
    assert {r["category"]: r["n_queries"] for r in means.collect()} == {None: 3, "symbol": 1, "semantic": 2}


def test_exports_are_whole_documents(spark, tmp_path):
    import xml.etree.ElementTree as ET

    sym = spark.createDataFrame([('a"<', "function", "a", "f.py"), ("lone", "function", "l", "f.py")], "node_id string, kind string, name string, file_path string")
    edges = spark.createDataFrame([('a"<', "b&", "CALLS"), ('a"<', "b&", "CALLS"), (None, "c", "CALLS")], "source_id string, target_id string, edge_type string")
    read = lambda form: "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / form).glob("part-*")) if p.stat().st_size)
    for form in ("dot", "graphml"):
        G.export_graph(sym, edges, str(tmp_path / form), form.upper())
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    tree = ET.fromstring(read("graphml").encode())
    assert {n.get("id") for n in tree.iter(f"{ns}node")} == {'a"<', "b&", "lone", "c"} and [(e.get("source"), e.get("target")) for e in tree.iter(f"{ns}edge")] == [('a"<', "b&")]
    dot = read("dot").split("\n")
    assert dot[0] == "digraph G {" and dot[-1] == "}" and '  "a\\"<" -> "b&" [label="CALLS"];' in dot and '  "lone";' in dot


def test_wiki_holds_everything(spark):
    from loamdex.operators import wiki as K

    row = "node_id string, file_path string, kind string, name string, signature string, docstring string, start_line int, end_line int"
    rows = [("file:a.py", "a.py", "module", "a", None, "About the file.\nAll of it.", 1, 99)] + [(f"a.py:f{i}", "a.py", "function", f"f{i}", None, f"First {i}.\nSecond {i}.", i, i + 1) for i in range(25)]
    s = spark.createDataFrame(rows, row)
    e = spark.createDataFrame([("a.py:f0", f"call:g{i:02}", "CALLS") for i in range(47)], "source_id string, target_id string, edge_type string")
    pages = K.module_pages(s, e, most=10)
    got = {r["part_no"]: r["content"] for r in pages.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and "About the file.\nAll of it." in got[1]
    text = "\n".join(got.values())
    assert all(f"### function `f{i}`\nLines {i}-{i + 1}\nFirst {i}.\nSecond {i}." in text for i in range(25)) and all(f"- `call:g{i:02}`" in text for i in range(47))
    assert all(t.count("### ") <= 10 and t.count("- `") <= 10 for t in got.values())
    assert K.page_chunks(pages).select("chunk_id").distinct().count() == 5
    steps = K.workflows(e).orderBy("part_no").collect()
    assert [x for r in steps for x in r["steps"]] == [f"call:g{i:02}" for i in range(47)] and max(len(r["steps"]) for r in steps) == K.STEPS
