"""Queries of the training-data operators; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamdex.llm import chunking as C, docpairs as D, encode as E, languages as L, neighbours as N, packing as P
from loamdex.session import Stages, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods with documentation that says something."""
    return D.documentation(table(spark, sf_dir, "symbols")).select("node_id", "start_line")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and documentation of the same functions."""
    return D.documented(table(spark, sf_dir, "symbols"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of oversized chunks on which an item begins."""
    found = C.natural_boundaries(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "size_limits"))
    return found.select("chunk_id", "line_no")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized chunks in pieces of the allowed size."""
    return C.split_items(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "size_limits"))


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every oversized chunk, how many characters its pieces hold without their overlaps, and how many pieces are too large."""
    limits = table(spark, sf_dir, "size_limits")
    kind = limits.where("item_kind like 'chunk:%'").select(F.expr("substring(item_kind, 7)").alias("chunk_type"), "max_size", "overlap")
    p = C.split_items(table(spark, sf_dir, "chunks"), limits).join(F.broadcast(kind), "chunk_type")  # a row per chunk_type
    own = F.length("content") - F.when(F.col("piece_no") > 0, F.col("overlap")).otherwise(0)
    too_large = F.when(F.length("content") > F.col("max_size"), 1)
    return p.groupBy("chunk_id", "chunk_type").agg(F.sum(own).alias("n_chars"), F.count(too_large).alias("n_too_large"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors with a cosine of at least 0.94."""
    return N.similar_pairs(table(spark, sf_dir, "chunk_vectors"), 0.94).select("chunk_id_a", "chunk_id_b")


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every usable vector."""
    return N.nearest(table(spark, sf_dir, "chunk_vectors"), 10)


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of p4_nearest: how many of the neighbours it gives to the keys with a hash divisible by 20 are as near as the tenth nearest of all rows."""
    v = table(spark, sf_dir, "chunk_vectors")
    found = N.nearest(v, 10).join(N.brute_force(v, 10), "chunk_id")
    hit = F.sum(F.when(F.col("cosine") >= F.col("kth") - 0.002, 1).otherwise(0))
    return found.agg(F.countDistinct("chunk_id").alias("n_queries"), F.count("*").alias("n_neighbours"), (hit / F.count("*")).alias("recall"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "size_limits").where("item_kind = 'document'").first()["max_size"]


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = Stages(spark, "sizes").save(E.encode(docs, out="n_tokens", lengths_only=True))
    return P.pack(sizes, _capacity(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of every piece of one that is too large."""
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled."""
    full = _capacity(spark, sf_dir)
    per = _packed(spark, sf_dir).groupBy("container_id").agg(F.sum("n").alias("used"), F.count("*").alias("n_items"))
    return per.agg(
        F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("used").alias("n_tokens"),
        F.max("used").alias("largest"), (F.sum("used") / (F.count("*") * F.lit(full))).alias("fill"),
    )


def p7_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that was placed (an empty one takes no room), whether its pieces follow each other without a gap, and how many of their containers are too full."""
    full = _capacity(spark, sf_dir)
    placed = Stages(spark, "placed").save(_packed(spark, sf_dir))
    over = placed.groupBy("container_id").agg((F.sum("n") > full).cast("int").alias("over"))
    per = placed.join(over, "container_id").groupBy("doc_id").agg(F.max(F.col("first") + F.col("n")).alias("end"), F.sum("n").alias("n"), F.sum("over").alias("n_too_full"))
    return per.select("doc_id", (F.col("end") == F.col("n")).alias("whole"), "n_too_full")


def _profiles(spark: SparkSession, sf_dir: str):
    docs, codes = table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_codes")
    return docs, codes, L.train(docs, codes)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages in which a document has a whole sentence and that its label doesn't name."""
    per = L.label_documents(*_profiles(spark, sf_dir))
    return per.where("lang is not null and n_sentences > 0 and (given is null or given <> lang)").select("doc_id", F.col("lang").alias("true_lang"))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of sentences in one language, with a confidence."""
    docs, _, profiles = _profiles(spark, sf_dir)
    return L.segments(docs, profiles)


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_pieces, p2_coverage, p4_found, p4_nearest, p4_recall, p6_ids, p7_containers, p7_fill, p7_placed, p8_found, p8_segments)}

_USABLE = """usable AS (
    SELECT DISTINCT chunk_id, dim, embedding::DOUBLE[] AS e FROM chunk_vectors
    WHERE chunk_id IS NOT NULL AND len(embedding) = dim AND dim > 0
      AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))"""

SQL = {
    "p2_coverage": """WITH big AS (SELECT DISTINCT chunk_id, chunk_type, start_line, content FROM chunks c JOIN size_limits l ON l.item_kind = 'chunk:' || c.chunk_type WHERE length(content) > max_size)
        SELECT chunk_id, chunk_type, sum(length(content))::BIGINT AS n_chars, 0 AS n_too_large FROM big GROUP BY chunk_id, chunk_type""",
    "p7_placed": "SELECT doc_id, true AS whole, 0 AS n_too_full FROM documents WHERE text <> ''",
    "p4_found": f"""WITH {_USABLE}
        SELECT DISTINCT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM usable a JOIN usable b ON a.dim = b.dim AND a.chunk_id < b.chunk_id
        WHERE list_cosine_similarity(a.e, b.e) >= 0.94""",
}
