"""Lexical, semantic and hybrid search over chunks or documents.

Only the few best rows of either signal travel on: everything after the two
top-k selections works on at most ``2 * CANDIDATES`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loamdex.functions import text as T, vectors as V
from loamdex.operators.graph import both_ways, reach_each
from loamdex.session import Stages

#: Candidates of each signal.
CANDIDATES = 50
RRF_K = 60
# The usual constants of BM25, and the floor of the inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def _top(df: DataFrame, score: str, key: str, limit: int, least_first: bool = False) -> DataFrame:
    return df.orderBy(F.asc(score) if least_first else F.desc(score), key).limit(limit)


def term_rows(docs: DataFrame, key: str, words: Column, terms: list[str], stem: Callable[[str], str] | None = None, version: Column | None = None) -> DataFrame:
    """``key, len`` and the count ``tf0, tf1, ...`` of each prefix term per row.

    Terms are counted inside the row. ``version`` tells rows of one key apart: of
    these the one with the smallest version stays, and only counts are moved for that.
    """
    prefix = [stem(t.lower()) if stem else t.lower() for t in terms]
    count = lambda p: F.size(F.filter("__w", lambda w: F.startswith(w, F.lit(p))))
    rows = docs.where(F.col(key).isNotNull()).select(key, (F.lit(0) if version is None else version).alias("__v"), F.coalesce(words, F.array().cast("array<string>")).alias("__w"))
    cols = [F.size("__w").alias("len"), *(count(p).alias(f"tf{i}") for i, p in enumerate(prefix))]
    narrow = rows.select(key, "__v", *cols)
    if version is None:
        return narrow.drop("__v")
    return narrow.groupBy(key).agg(F.min(F.struct("__v", "len", *(f"tf{i}" for i in range(len(terms))))).alias("r")).select(key, "r.*").drop("__v")


def bm25(docs: DataFrame, key: str, words: Column, terms: list[str], limit: int = CANDIDATES, stem: Callable[[str], str] | None = None, version: Column | None = None) -> DataFrame:
    """``key, score``: the best rows by BM25 of an OR of prefix terms, higher is better.

    ``words`` is an array of tokens. The statistics of the corpus are one row,
    taken first; then a row is scored where it lies and only the top rows move.
    Every term counts on its own, also if it folds to the same prefix as another.
    No terms, no rows; a row without tokens has length 0. Scores are rounded to 6
    digits, ties go to the smaller key. See ``term_rows`` for repeated keys.
    """
    none = docs.select(key, F.lit(0.0).alias("score")).limit(0)
    if not terms:
        return none
    rows = Stages(docs.sparkSession, "terms").save(term_rows(docs, key, words, terms, stem, version))  # read twice
    return _scored(rows, rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg")), key, len(terms), limit)


def _scored(rows: DataFrame, corpus: DataFrame, key: str, n_terms: int, limit: int) -> DataFrame:
    """Top rows of ``key, len, tf0, ...`` given the one-row corpus statistics ``n, avg``."""
    every = range(n_terms)
    counts = rows.agg(*(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"n{i}") for i in every)).first()
    whole = corpus.first()
    seen = [i for i in every if counts[f"n{i}"]]
    if not seen:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)

    def part(i: int) -> Column:
        f, n = F.col(f"tf{i}"), counts[f"n{i}"]
        idf = max(math.log((whole["n"] - n + 0.5) / (n + 0.5)), IDF_FLOOR)
        return F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(whole["avg"])))

    hit = rows.where(reduce(lambda x, y: x | y, (F.col(f"tf{i}") > 0 for i in seen)))
    score = reduce(lambda x, y: x + y, map(part, seen))
    return _top(hit.select(key, F.round(score, 6).alias("score")), "score", key, limit)


def build_postings(docs: DataFrame, key: str, words: Column, version: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Inverted index: ``term, key, tf`` in the order of terms, and ``key, len``.

    Write both; in the sorted files a prefix of a term is a range that the parquet
    reader can skip to. Repeated keys as in ``term_rows``.
    """
    rows = docs.where(F.col(key).isNotNull()).select(key, (F.lit(0) if version is None else version).alias("__v"), F.coalesce(words, F.array().cast("array<string>")).alias("w"))
    if version is not None:
        rows = rows.groupBy(key).agg(F.min(F.struct("__v", "w")).alias("r")).select(key, "r.w")
    tf = rows.select(key, F.explode("w").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
    return tf.repartitionByRange("term", key).sortWithinPartitions("term", key), rows.select(key, F.size("w").alias("len"))


def bm25_postings(postings: DataFrame, lengths: DataFrame, key: str, terms: list[str], limit: int = CANDIDATES, stem: Callable[[str], str] | None = None) -> DataFrame:
    """``bm25`` from an inverted index: only the postings of the terms are read. ``stem`` as the index was built."""
    if not terms:
        return lengths.select(key, F.lit(0.0).alias("score")).limit(0)
    match = [F.startswith("term", F.lit(stem(t.lower()) if stem else t.lower())) for t in terms]
    mine = postings.where(reduce(lambda x, y: x | y, match))
    tf = mine.groupBy(key).agg(*(F.coalesce(F.sum(F.when(m, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, m in enumerate(match)))
    return _scored(tf.join(lengths, key), lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg")), key, len(terms), limit)


def chunk_words(stemmed: bool = False) -> Column:
    """Tokens of the four searched columns of a chunk."""
    parts = [F.col("file_path"), F.col("content"), F.array_join(F.coalesce("identifiers", F.array().cast("array<string>")), " "), F.array_join(F.coalesce("identifier_tokens", F.array().cast("array<string>")), " ")]
    whole = F.concat_ws(" ", *parts)
    return T.stemmed_tokens(whole) if stemmed else T.tokens(whole)


def like_fallback(docs: DataFrame, key: str, body: Column, names: Column, terms: list[str], limit: int = CANDIDATES) -> DataFrame:
    """``key, score``: rows that hold one of the first five terms anywhere, whatever its case.

    A row counts each exact occurrence in the body once and in the names twice.
    Per term the 50 best rows take part, a repeated key with its best row. Used where the index finds nothing.
    """
    found = None
    for t in terms[:5]:
        hit = docs.where(F.contains(F.lower(body), F.lit(t.lower())) | F.contains(F.lower(names), F.lit(t.lower())))
        score = F.coalesce(T.occurrences(body, t), F.lit(0)) + 2 * F.coalesce(T.occurrences(names, t), F.lit(0))
        part = _top(hit.groupBy(key).agg(F.max(score).alias("score")), "score", key, CANDIDATES)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.select(key, F.lit(0).cast("long").alias("score")).limit(0)
    return _top(found.groupBy(key).agg(F.sum("score").alias("score")), "score", key, limit)


def semantic(vectors: DataFrame, key: str, embedding: str, query: list[float], limit: int = CANDIDATES) -> DataFrame:
    """``key, score``: the nearest rows by cosine. Vectors of another length or with nulls are left out."""
    e = F.col(embedding)
    fit = vectors.where(F.col(key).isNotNull() & (F.size(e) == len(query)) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x)))
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = fit.select(key, F.round(V.cosine(V.doubles(e), q), 6).alias("score")).where("score is not null")
    return _top(scored.groupBy(key).agg(F.max("score").alias("score")), "score", key, limit)


def ranked(top: DataFrame, key: str, name: str) -> DataFrame:
    """``key, name``: rank from 1 of the few rows of a top-k."""
    return top.select(key, F.row_number().over(W.orderBy(F.desc("score"), key)).alias(name))


def rrf(lexical: DataFrame, near: DataFrame, key: str, weights: tuple[float, float], k: int = RRF_K) -> DataFrame:
    """``key, lexical_rank, semantic_rank, score``: reciprocal rank fusion of two top-k tables."""
    both = ranked(lexical, key, "lexical_rank").join(ranked(near, key, "semantic_rank"), key, "full_outer")
    part = lambda w, c: F.coalesce(F.lit(w) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return both.withColumn("score", part(weights[0], "lexical_rank") + part(weights[1], "semantic_rank"))


def boost(rows: DataFrame, query: str) -> DataFrame:
    """Multiply ``score`` of fused chunk rows by what symbol, file and path say about the query."""
    q = query.strip().lower()
    lit = F.lit(q)
    symbol = F.lower(F.substring_index(F.coalesce("symbol_id", F.lit("")), ":", -1))
    stem = F.lower(T.file_stem(F.col("file_path")))
    words = [w for w in q.split() if len(w) > 2]
    s = F.col("score") * F.when(F.col("is_definition"), 1.25).otherwise(1.0)
    s = s * F.when((symbol != "") & ((symbol == lit) | F.endswith(symbol, F.lit("." + q))), 2.0).otherwise(1.0)
    s = s * F.when(T.same_but_plural(stem, lit), 1.4).when(stem.isin(*words) if words else F.lit(False), 1.2).otherwise(1.0)
    asks_for_tests = F.lit(q).rlike(T.TEST_QUERY)
    path = F.coalesce("file_path", F.lit(""))
    s = s * F.when(asks_for_tests, 1.0).when(path.rlike(T.TEST_PATH), 0.35).when(path.rlike(T.COMPAT_PATH), 0.5).otherwise(1.0)
    return rows.withColumn("score", s)


def cohere(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Lift the best chunk of each file by the share of the file in the result. ``rows`` are few."""
    every, file = W.partitionBy(), W.partitionBy("file_path")
    best = F.row_number().over(file.orderBy(F.desc("score"), key)) == 1
    r = rows.withColumn("__m", F.max("score").over(every)).withColumn("__f", F.sum("score").over(file)).withColumn("__b", best)
    r = r.withColumn("__fm", F.max("__f").over(every))
    lift = F.when(F.col("__b") & (F.col("__m") > 0), 0.2 * F.col("__m") * F.col("__f") / F.col("__fm")).otherwise(0.0)
    return r.withColumn("score", F.col("score") + lift).drop("__m", "__f", "__b", "__fm")


def chunk_version() -> Column:
    """Tells the rows of one chunk_id apart."""
    return F.md5(F.concat_ws("\u0001", "content", "file_path", "symbol_id").cast("binary"))


def fetch_chunks(chunks: DataFrame, few: DataFrame) -> DataFrame:
    """The chunks of a few chunk_ids, one row each, with the columns of ``few``."""
    keep = ["symbol_id", "file_path", "chunk_type", "content", "start_line", "end_line", "language", "is_definition", "identifiers", "identifier_tokens"]
    rows = chunks.join(F.broadcast(few.select("chunk_id")), "chunk_id", "left_semi")  # 2 * CANDIDATES rows at most
    rows = rows.groupBy("chunk_id").agg(F.min(F.struct(chunk_version().alias("v"), *keep)).alias("r"))
    return rows.select("chunk_id", *(F.col(f"r.{c}").alias(c) for c in keep)).join(few, "chunk_id")


def search(chunks: DataFrame, vectors: DataFrame, query: str, query_vector: list[float] | None, limit: int = 5, mode: str = "hybrid", stemmed: bool = False, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Best chunks for a query, with score and both ranks.

    ``mode`` is hybrid, lexical or semantic; semantic without a vector falls back
    to lexical. Repeated chunks count once. Where no word begins with a term, the
    terms are looked for as substrings. ``index`` is what ``build_postings`` made
    of the chunks, of stemmed words if ``stemmed``; without it the chunks are read.
    """
    terms = T.query_terms(query)
    empty = chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    lexical = near = empty
    if mode in ("hybrid", "lexical") or query_vector is None:
        lexical = bm25_postings(*index, "chunk_id", terms, stem=T.porter if stemmed else None) if index else bm25(chunks, "chunk_id", chunk_words(stemmed), terms, stem=T.porter if stemmed else None, version=chunk_version())
        if lexical.isEmpty():
            lexical = like_fallback(chunks, "chunk_id", F.col("content"), F.array_join("identifiers", " "), terms).withColumn("score", F.col("score").cast("double"))
    if mode in ("hybrid", "semantic") and query_vector is not None:
        near = semantic(vectors, "chunk_id", "embedding", query_vector)
    fused = rrf(lexical, near, "chunk_id", T.query_weights(query))
    rows = fetch_chunks(chunks, fused)
    return _top(cohere(boost(rows, query)).withColumn("score", F.round("score", 6)), "score", "chunk_id", limit)


def neighbour_rows(results: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int = 1) -> DataFrame:
    """``chunk_id, level, neighbour``: a row for every known symbol within ``depth`` hops of a result's symbol, as a struct."""
    r = results.where(F.col("symbol_id").isNotNull()).select("chunk_id", F.col("symbol_id").alias("origin"))
    st = Stages(results.sparkSession, "neighbours")
    r = st.save(r)
    near = reach_each(r.select("origin"), both_ways(edges), depth).where("level > 0")
    info = symbols.groupBy("node_id").agg(F.min(F.struct("kind", "name", "signature", "file_path", "start_line")).alias("i"))
    named = near.join(info, "node_id").select("origin", "level", F.struct("node_id", "i.*").alias("neighbour"))
    return named.join(r, "origin").select("chunk_id", "level", "neighbour")


def attach_neighbours(results: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int = 1) -> DataFrame:
    """``results`` with ``neighbours``: all that ``neighbour_rows`` gives for each, in one array by node_id."""
    lists = neighbour_rows(results, edges, symbols, depth).groupBy("chunk_id").agg(F.array_sort(F.collect_set("neighbour")).alias("neighbours"))
    return results.join(lists, "chunk_id", "left")


def answer(results: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Results as they are shown: scores to four digits, and the ids of the first three neighbours (of ``neighbour_rows``)."""
    shown = results.withColumn("score", F.round("score", 4)).select("chunk_id", "symbol_id", "file_path", "chunk_type", "start_line", "end_line", "content", "score")
    if near is None:
        return shown
    rank = F.row_number().over(W.partitionBy("chunk_id").orderBy("level", "neighbour.node_id"))
    three = near.withColumn("n", rank).where("n <= 3").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("n", F.col("neighbour.node_id").alias("id")))).alias("x"))
    ids = F.coalesce(F.col("x.id"), F.array().cast("array<string>"))
    return shown.join(three, "chunk_id", "left").withColumn("neighbours", ids).drop("x")


def distance_score(distance: Column) -> Column:
    """Similarity of a cosine distance: one less it, 0 at least."""
    return F.greatest(F.lit(0.0), 1 - distance)
