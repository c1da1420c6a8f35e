import math

import pytest
from pyspark.sql import functions as F

from loamdex.functions import text as T, vectors as V
from loamdex.operators import search as S

CHUNK = "chunk_id string, symbol_id string, file_path string, chunk_type string, content string, start_line int, end_line int, language string, is_definition boolean, identifiers array<string>, identifier_tokens array<string>"


def chunk(i, content, path="src/a.py", symbol=None, definition=False):
    return (i, symbol, path, "code", content, 1, 9, "python", definition, None, None)


@pytest.mark.parametrize("name,parts", [
    ("camelCase", ["camel", "case"]), ("PascalCase", ["pascal", "case"]), ("snake_case_variable", ["snake", "case", "variable"]), ("AuthMiddleware", ["auth", "middleware"]),
    ("get_recommendations", ["get", "recommendations"]), ("getHTTPResponse_codeX2y", ["get", "httpresponse", "code", "x2y"]),
])
def test_split_identifier(spark, name, parts):
    assert T.identifier_parts(name) == parts
    assert spark.createDataFrame([(name,)], "n string").select(T.split_identifier(F.col("n"))).first()[0] == parts


def test_query_weights():
    for q in ("AuthMiddleware.authenticate", "get_token", "JWT"):
        assert T.query_weights(q) == (0.6, 0.4)
    assert T.query_weights("how does user authentication and validation work?") == (0.3, 0.7)


def test_terms_keep_case_variants():
    assert T.query_terms("Flask app_ctx") == ["Flask", "app", "ctx", "flask"]


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("sky", "sky"), ("generalization", "gener"), ("adoption", "adopt"), ("controll", "control"), ("agreed", "agre"), ("filing", "file")])
def test_porter(word, stem):
    assert T.porter(word) == stem


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, ""), (4, None), (5, "delta"), (6, "eps"), (7, "zeta")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in S.bm25(docs, "doc_id", T.tokens(F.col("text")), ["bet"]).collect()}
    avg, idf = (3 + 2 + 3) / 7, math.log((7 - 1 + 0.5) / 1.5)
    assert set(got) == {1} and got[1] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg)), abs=1e-6)
    assert S.bm25(docs, "doc_id", T.tokens(F.col("text")), []).count() == 0
    assert S.bm25(docs.limit(0), "doc_id", T.tokens(F.col("text")), ["bet"]).count() == 0


def test_semantic_order_and_bad_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", None), ("e", [1.0]), ("f", [None, 1.0]), ("a", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    assert [r["chunk_id"] for r in S.semantic(v, "chunk_id", "embedding", [1.0, 0.0]).collect()] == ["a", "c", "b"]


def test_planted_chunk_first_and_boosts(spark):
    c = spark.createDataFrame([chunk("c1", "def verify_signature(token): check"), chunk("c2", "other text"), chunk("c3", "verify_signature in a test", "tests/test_a.py"), chunk("c4", None)], CHUNK)
    v = spark.createDataFrame([], "chunk_id string, embedding array<float>, dim int")
    got = S.search(c, v, "verify_signature", None, mode="semantic").collect()
    assert [r["chunk_id"] for r in got] == ["c1", "c3"]


def test_worked_example(spark):
    c = spark.createDataFrame([chunk("c1", "token", symbol="src/a.py:token", definition=True), chunk("c2", "x"), chunk("c3", "y"), chunk("c4", "z")], CHUNK)
    v = spark.createDataFrame([], "chunk_id string, embedding array<float>, dim int")
    got = S.search(c, v, "token", None, mode="lexical").collect()
    assert [(r["chunk_id"], round(r["score"], 5)) for r in got] == [("c1", round(0.6 / 61 * 1.25 * 2 * 1.2, 5))]


def test_fallback_finds_inner_parts(spark):
    c = spark.createDataFrame([chunk("c1", "the recache call"), chunk("c2", "none")], CHUNK)
    v = spark.createDataFrame([], "chunk_id string, embedding array<float>, dim int")
    assert [r["chunk_id"] for r in S.search(c, v, "cache", None).collect()] == ["c1"]


def test_neighbours(spark):
    found = spark.createDataFrame([("c1", "m"), ("c2", None)], "chunk_id string, symbol_id string")
    e = spark.createDataFrame([("m", "h", "CALLS"), ("m", "h", "DEFINES"), ("x", "m", "CALLS"), ("m", "call:p", "CALLS")], "source_id string, target_id string, edge_type string")
    s = spark.createDataFrame([("m", "function", "m", None, "a", 1), ("h", "function", "h", None, "a", 2), ("x", "class", "x", None, "b", 1)], "node_id string, kind string, name string, signature string, file_path string, start_line int")
    got = {r["chunk_id"]: r["neighbours"] for r in S.attach_neighbours(found, e, s).collect()}
    assert [n["node_id"] for n in got["c1"]] == ["h", "x"] and got["c2"] is None


def test_all_neighbours_to_any_depth(spark):
    found = spark.createDataFrame([("c1", "m"), ("c2", "n0")], "chunk_id string, symbol_id string")
    e = spark.createDataFrame([*(("m", f"n{i}", "CALLS") for i in range(30)), ("n7", "far", "CALLS"), ("far", "m2", "CALLS")], "source_id string, target_id string, edge_type string")
    s = spark.createDataFrame([(x, "function", x, None, "a", 1) for x in ("m", "far", "m2", *(f"n{i}" for i in range(30)))], "node_id string, kind string, name string, signature string, file_path string, start_line int")
    assert {r["chunk_id"]: len(r["neighbours"]) for r in S.attach_neighbours(found, e, s).collect()} == {"c1": 30, "c2": 1}
    got = [(r["chunk_id"], r["neighbour"]["node_id"], r["level"]) for r in S.neighbour_rows(found, e, s, 2).collect()]
    assert len(got) == len(set(got)) and {g for g in got if g[0] == "c1"} == {*(("c1", f"n{i}", 1) for i in range(30)), ("c1", "far", 2)}
    assert len([g for g in got if g[0] == "c2"]) == 30


def test_embedder_is_stable(spark):
    a = spark.createDataFrame([("parse the header",), ("parse a header",), ("",), (None,)], "t string").select(V.embedder(32)("t").alias("e")).collect()
    assert all(len(r["e"]) == 32 for r in a) and a[2]["e"] == a[3]["e"] == [0.0] * 32
    assert sum(x * y for x, y in zip(a[0]["e"], a[1]["e"])) > 0.4
