from pyspark.sql import functions as F

from loamdex.operators import orphans as O


def frames(spark, symbols, edges, chunks, vectors):
    return (
        spark.createDataFrame(symbols, "node_id string, parent_id string"),
        spark.createDataFrame(edges, "source_id string, target_id string, edge_type string, key string"),
        spark.createDataFrame(chunks, "chunk_id string, symbol_id string, file_path string"),
        spark.createDataFrame(vectors, "chunk_id string"),
    )


def test_spellings_and_kinds(spark, rows):
    t = frames(
        spark,
        [("file:r/a.py", None), ("r/a.py:f", "file:r/a.py"), ("r/b.py:g", " "), (None, None), ("r/b.py:h", "r/b.py:gone")],
        [
            ("./r/a.py:f", "r\\b.py:g ", "CALLS", "k"), ("r/a.py:f", "r//x/../a.py:f", "CALLS", "k"), ("r/a.py:f", "r/a.py:F", "CALLS", "k"), ("r/a.py:f", "call:print", "CALLS", "k"),
            ("r/a.py:f", "", "CALLS", "k"), (None, "r/a.py:f", None, "k"), ("gone", "r/a.py:f", None, "k"), ("gone", "r/a.py:f", None, "k"), ("file:./r/a.py", "r/b.py:g", "DEFINES", "k"),
        ],
        [("chunk:r/a.py:f", "r/a.py:f", None), ("c2", "nowhere", "r/b.py"), ("c3", None, "r/b.py")],
        [("chunk:./r/a.py:f",), ("c9",), (None,)],
    )
    got = rows(O.orphan_references(*t).drop("ref_file"))
    assert got == sorted([
        ("edges", "target_id", "r/a.py:f", "r/a.py:F", "CALLS"), ("edges", "source_id", "r/a.py:f", "gone", ""), ("symbols", "parent_id", "r/b.py:h", "r/b.py:gone", ""),
        ("chunks", "symbol_id", "c2", "nowhere", ""), ("chunk_vectors", "chunk_id", "c9", "c9", ""),
    ])


def test_filter_never_denies_a_key(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    words = O.bloom_words(keys, 5000)
    assert O.may_exist(keys, words).where("not maybe").count() == 0
    others = spark.range(5000).select(F.concat(F.lit("x"), "id").alias("key"))
    assert O.may_exist(others, words).where("maybe").count() < 200


def test_empty_tables(spark):
    assert O.orphan_references(*frames(spark, [], [], [], [])).count() == 0
    assert O.orphan_references(*frames(spark, [], [("a", "b", None, None)], [], [])).count() == 2


def test_report(spark, rows):
    found = spark.createDataFrame([("edges", "target_id", "a", "b", "CALLS", "r/a.py"), ("edges", "target_id", "a", "c", "CALLS", "r/b.py")], "table_name string, field_name string, owner_id string, missing_id string, edge_type string, ref_file string")
    passes = spark.sql("select 'r/a.py' as file_path, timestamp_ntz'2024-03-05 00:00:00' as indexed_at union all select './r/a.py', timestamp_ntz'2024-05-01 00:00:00' union all select 'r/b.py', null")
    assert rows(O.orphan_report(found, passes)) == [("edges", "target_id", "CALLS", "", 1), ("edges", "target_id", "CALLS", "2024-05", 1)]
