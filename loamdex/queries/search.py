"""Queries of the search operators, over documents, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from loamdex.functions import text as T, vectors as V
from loamdex.operators import evaluate as EV, search as S
from loamdex.session import Stages, table

# The questions asked of the tables.
WORDS = ["cach", "schedul", "spelling", "megabyt"]
CODE_QUERY = "rotate_handle beacon"
LIKE_TERMS = ["Cache", "disk", "lock"]
#: Query vectors that a row is compared with in one step.
ASKED_AT_ONCE = 256


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def _example(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector of the hybrid search: that of the smallest chunk_id with a vector of length 64."""
    v = table(spark, sf_dir, "chunk_vectors").where("dim = 64 and size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x)) and exists(embedding, x -> x <> 0)")
    return [float(x) for x in v.orderBy("chunk_id", "embedding").select("embedding").first()[0]]


def lexical_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bm25(_docs(spark, sf_dir), "doc_id", T.tokens(F.col("text")), WORDS)


def postings_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As lexical_bm25_topk, from an inverted index that is written first."""
    postings, lengths = S.build_postings(_docs(spark, sf_dir), "doc_id", T.tokens(F.col("text")))
    st = Stages(spark, "postings")
    return S.bm25_postings(st.save(postings), st.save(lengths), "doc_id", WORDS)


def lexical_bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bm25(_docs(spark, sf_dir), "doc_id", T.stemmed_tokens("text"), ["caches", "scheduler", "spellings"], stem=T.porter)


def chunks_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bm25(table(spark, sf_dir, "chunks"), "chunk_id", S.chunk_words(), T.query_terms(CODE_QUERY), version=S.chunk_version())


def lexical_like_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.like_fallback(_docs(spark, sf_dir), "doc_id", F.col("text"), F.col("source"), LIKE_TERMS)


def vector_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.semantic(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _first_vector(spark, sf_dir))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = lexical_bm25_topk(spark, sf_dir).withColumnRenamed("doc_id", "id")
    sem = vector_cosine_topk(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return S.rrf(lex, sem, "id", (0.6, 0.4)).withColumn("score", F.round("score", 8))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_vectors"), CODE_QUERY, _example(spark, sf_dir), 20)
    return found.select("chunk_id", "file_path", "lexical_rank", "semantic_rank", "score")


def search_with_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_vectors"), CODE_QUERY, None, 20, "lexical")
    more = S.neighbour_rows(found, table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols"))
    return found.select("chunk_id").join(more, "chunk_id", "left").select("chunk_id", F.col("neighbour.node_id").alias("neighbour_id"))


def vector_knn_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors to the first one, of each label."""
    e = table(spark, sf_dir, "embeddings")
    q = F.array(*(F.lit(float(x)) for x in _first_vector(spark, sf_dir)))
    scored = e.select("vec_id", "label", F.round(V.cosine(V.doubles(F.col("embedding")), q), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where("rank <= 3")


def ndcg_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well vectors find their own label: every vec_id divisible by 20 asks all other rows for ten, averaged per label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("e"))
    asks = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("want"), F.col("e").alias("q"))
    blocks = -(-asks.count() // ASKED_AT_ONCE) or 1
    asks = asks.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    met = e.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(asks, "block").where("vec_id <> query")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("s"), "vec_id"))
    top = met.select("query", "want", "label", "vec_id", F.round(V.cosine("e", "q"), 6).alias("s")).withColumn("rank", rank).where("rank <= 10")
    targets = e.groupBy(F.col("label").alias("want")).agg((F.count("*") - 1).alias("n_targets"))
    per = EV.ndcg(asks.join(targets, "want").select("query", "n_targets"), top.where("label = want").select("query", "rank"))
    by_label = per.join(asks.select("query", "want"), "query").groupBy(F.col("want").alias("label"))
    return by_label.agg(F.count("*").alias("n_queries"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("top1"), 6).alias("top1"))


def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", V.embedder()("text").alias("embedding"))


def split_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "symbols").select("name").distinct()
    return s.select("name", F.array_join(T.split_identifier(F.col("name")), " ").alias("parts"))


def query_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a query."""
    return table(spark, sf_dir, "documents").select("doc_id", T.lexical_weight(F.col("text")).alias("lexical_weight"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").select("chunk_id", F.sha2("content", 256).alias("hash"), "content_hash")
    return c.select("chunk_id", "hash", (F.col("hash") == F.col("content_hash")).alias("agrees")).distinct()


def path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "symbols").select("file_path").distinct()
    f = F.col("file_path")
    return p.select("file_path", T.file_stem(f).alias("stem"), T.language_of(f).alias("language"), f.rlike(T.TEST_PATH).alias("is_test"), f.rlike(T.COMPAT_PATH).alias("is_compat"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.latencies(table(spark, sf_dir, "events"), "event_type", "value")


def context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").groupBy("chunk_type").agg(EV.token_estimate(F.col("content")).alias("tokens"))


def interval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and definitions of one file whose lines overlap, counted by chunk_type."""
    c = table(spark, sf_dir, "chunks").select("file_path", F.concat_ws("|", "chunk_type", "chunk_id", "start_line").alias("id"), F.col("start_line").alias("first"), F.col("end_line").alias("last")).distinct()
    s = table(spark, sf_dir, "symbols").where("kind in ('class', 'function', 'method')").select("file_path", F.concat_ws("|", "node_id", "start_line").alias("id"), F.col("start_line").alias("first"), F.col("end_line").alias("last")).distinct()
    m = EV.interval_matches(c, s)
    return m.groupBy(F.substring_index("left_id", "|", 1).alias("chunk_type")).agg(F.count("*").alias("n_pairs"), F.countDistinct("right_id").alias("n_definitions"))


QUERIES = {
    f.__name__: f
    for f in (
        lexical_bm25_topk, postings_bm25_topk, lexical_bm25_stemmed, chunks_bm25_topk, lexical_like_fallback, vector_cosine_topk, rrf_fusion, hybrid_search, search_with_neighbours,
        vector_knn_per_label, ndcg_eval, embed_documents, split_identifiers, query_classify, content_hash, path_flags, latency_percentiles, context_tokens, interval_match,
    )
}


def _bm25_sql(source: str, key: str, words: str, terms: list[str]) -> str:
    tf = lambda t: f"len(list_filter(w, lambda x: starts_with(x, '{t.lower()}')))"
    cols = ", ".join(f"{tf(t)} AS f{i}" for i, t in enumerate(terms))
    idf = lambda i: f"greatest(coalesce(ln(CASE WHEN (n - n{i} + 0.5) / (n{i} + 0.5) > 0 THEN (n - n{i} + 0.5) / (n{i} + 0.5) END), 1e-6), 1e-6)"
    part = lambda i: f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / a))"
    counts = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(terms)))
    return f"""toks AS (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce({words}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {source}),
        rws AS (SELECT {key}, len(w) AS len, {cols} FROM toks),
        st AS (SELECT count(*) AS n, avg(len) AS a, {counts} FROM rws),
        lex AS (SELECT {key}, round({' + '.join(part(i) for i in range(len(terms)))}, 6) AS score FROM rws, st WHERE {' OR '.join(f'f{i} > 0' for i in range(len(terms)))}
                ORDER BY score DESC, {key} LIMIT 50)"""


_CHUNKS = """ch AS (SELECT chunk_id, r.* FROM (SELECT chunk_id, min({'v': md5(concat_ws(chr(1), content, file_path, symbol_id)), 'symbol_id': symbol_id, 'file_path': file_path, 'chunk_type': chunk_type, 'content': content, 'start_line': start_line, 'end_line': end_line,
        'language': language, 'is_definition': is_definition, 'identifiers': identifiers, 'identifier_tokens': identifier_tokens}) AS r FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id))"""
_CHUNK_WORDS = "concat_ws(' ', file_path, content, coalesce(array_to_string(identifiers, ' '), ''), coalesce(array_to_string(identifier_tokens, ' '), ''))"
_COS = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6)"
_CODE_TERMS = T.query_terms(CODE_QUERY)
_SEM = f"sem AS (SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50)"
_Q = CODE_QUERY.lower()
_HYBRID = f"""WITH {_CHUNKS}, {_bm25_sql('ch', 'chunk_id', _CHUNK_WORDS, _CODE_TERMS)},
    uv AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE chunk_id IS NOT NULL AND len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x)))),
    qv AS (SELECT embedding::DOUBLE[] AS q FROM chunk_vectors WHERE dim = 64 AND len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) ORDER BY chunk_id, embedding LIMIT 1),
    cs AS (SELECT chunk_id, max(round(CASE WHEN list_bool_or(list_transform(e, lambda x: x <> 0)) THEN list_cosine_similarity(e, q) ELSE 0 END, 6)) AS score FROM uv, qv GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 50),
    lr AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS lexical_rank FROM lex),
    sr AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS semantic_rank FROM cs),
    fu AS (SELECT chunk_id, lexical_rank, semantic_rank, coalesce(0.6 / (60 + lexical_rank), 0) + coalesce(0.4 / (60 + semantic_rank), 0) AS s FROM lr FULL JOIN sr USING (chunk_id)),
    j AS (SELECT f.*, c.file_path, c.is_definition, lower(split_part(coalesce(c.symbol_id, ''), ':', -1)) AS sym, lower(regexp_replace(split_part(c.file_path, '/', -1), '(.)\\.[^.]*$', '\\1')) AS stem FROM fu f JOIN ch c USING (chunk_id)),
    bo AS (SELECT *, s * CASE WHEN is_definition THEN 1.25 ELSE 1 END * CASE WHEN sym <> '' AND (sym = '{_Q}' OR ends_with(sym, '.{_Q}')) THEN 2 ELSE 1 END
           * CASE WHEN stem = '{_Q}' OR stem || 's' = '{_Q}' OR stem = '{_Q}s' THEN 1.4 WHEN stem IN ({', '.join(f"'{w}'" for w in _Q.split())}) THEN 1.2 ELSE 1 END
           * CASE WHEN regexp_matches(coalesce(file_path, ''), '{T.TEST_PATH}') THEN 0.35 WHEN regexp_matches(coalesce(file_path, ''), '{T.COMPAT_PATH}') THEN 0.5 ELSE 1 END AS b FROM j),
    co AS (SELECT *, max(b) OVER () AS m, sum(b) OVER (PARTITION BY file_path) AS fs, row_number() OVER (PARTITION BY file_path ORDER BY b DESC, chunk_id) AS rn FROM bo),
    fm AS (SELECT *, max(fs) OVER () AS fmax FROM co)
    SELECT chunk_id, file_path, lexical_rank, semantic_rank, round(b + CASE WHEN rn = 1 AND m > 0 THEN 0.2 * m * fs / fmax ELSE 0 END, 6) AS score FROM fm ORDER BY score DESC, chunk_id LIMIT 20"""

_LIKE = " UNION ALL ".join(
    f"""(SELECT doc_id, coalesce((length(text) - length(replace(text, '{t}', ''))) // {len(t)}, 0) + 2 * coalesce((length(source) - length(replace(source, '{t}', ''))) // {len(t)}, 0) AS score
         FROM documents WHERE contains(lower(text), '{t.lower()}') OR contains(lower(source), '{t.lower()}') ORDER BY score DESC, doc_id LIMIT 50)"""
    for t in LIKE_TERMS
)
_LANG = " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in T.LANGUAGES.items())

SQL = {
    "lexical_bm25_topk": f"WITH {_bm25_sql('documents', 'doc_id', 'text', WORDS)} SELECT * FROM lex",
    "postings_bm25_topk": f"WITH {_bm25_sql('documents', 'doc_id', 'text', WORDS)} SELECT * FROM lex",
    "chunks_bm25_topk": f"WITH {_CHUNKS}, {_bm25_sql('ch', 'chunk_id', _CHUNK_WORDS, _CODE_TERMS)} SELECT * FROM lex",
    "lexical_like_fallback": f"SELECT doc_id, sum(score)::BIGINT AS score FROM ({_LIKE}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50",
    "vector_cosine_topk": f"WITH {_SEM} SELECT * FROM sem",
    "rrf_fusion": f"""WITH {_bm25_sql('documents', 'doc_id', 'text', WORDS)}, {_SEM},
        l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS lexical_rank FROM lex), s AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS semantic_rank FROM sem)
        SELECT id, lexical_rank, semantic_rank, round(coalesce(0.6 / (60 + lexical_rank), 0) + coalesce(0.4 / (60 + semantic_rank), 0), 8) AS score FROM l FULL JOIN s USING (id)""",
    "hybrid_search": _HYBRID,
    "vector_knn_per_label": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, label, {_COS} AS score FROM embeddings)) WHERE rank <= 3",
    "ndcg_eval": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        q AS (SELECT x.vec_id AS query, x.label AS want, x.e AS q, t.n FROM e x JOIN (SELECT label, count(*) - 1 AS n FROM e GROUP BY label) t ON x.label = t.label WHERE x.vec_id % 20 = 0),
        t AS (SELECT q.query, q.want, e.label, row_number() OVER (PARTITION BY q.query ORDER BY round(list_cosine_similarity(e.e, q.q), 6) DESC, e.vec_id) AS rank FROM q JOIN e ON e.vec_id <> q.query),
        d AS (SELECT query, sum(1 / log2(rank + 1)) AS dcg, max(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS top1 FROM t WHERE rank <= 10 AND label = want GROUP BY query),
        s AS (SELECT q.query, q.want, CASE WHEN q.n > 0 THEN coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(q.n, 10) + 1) r(i)) ELSE 0 END AS ndcg, coalesce(top1, 0) AS top1 FROM q LEFT JOIN d ON q.query = d.query)
        SELECT want AS label, count(*) AS n_queries, round(avg(ndcg), 6) AS ndcg, round(avg(top1), 6) AS top1 FROM s GROUP BY want""",
    "split_identifiers": """SELECT name, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[_\\W]+'), lambda x: x <> ''), ' ') AS parts
        FROM (SELECT DISTINCT name FROM symbols)""",
    "query_classify": f"""SELECT doc_id, CASE WHEN q IS NULL THEN NULL WHEN regexp_matches(trim(q, ' '), '{T.IDENTIFIER_QUERY}') OR len(regexp_split_to_array(trim(q, ' '), '\\s+')) <= 2 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS lexical_weight
        FROM (SELECT doc_id, text AS q FROM documents)""",
    "content_hash": "SELECT DISTINCT chunk_id, sha256(content) AS hash, sha256(content) = content_hash AS agrees FROM chunks",
    "path_flags": f"""SELECT file_path, regexp_replace(split_part(file_path, '/', -1), '(.)\\.[^.]*$', '\\1') AS stem, CASE lower(regexp_extract(file_path, '(\\.[^./]*)$', 1)) {_LANG} END AS language,
        regexp_matches(file_path, '{T.TEST_PATH}') AS is_test, regexp_matches(file_path, '{T.COMPAT_PATH}') AS is_compat FROM (SELECT DISTINCT file_path FROM symbols)""",
    "latency_percentiles": """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
        round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""",
    "context_tokens": "SELECT chunk_type, (coalesce(sum(length(content)), 0) // 4)::BIGINT AS tokens FROM chunks GROUP BY chunk_type",
    "interval_match": """WITH c AS (SELECT DISTINCT file_path, chunk_type, chunk_id, start_line, end_line FROM chunks WHERE end_line >= start_line),
        s AS (SELECT DISTINCT file_path, node_id, start_line, end_line FROM symbols WHERE kind IN ('class', 'function', 'method') AND end_line >= start_line)
        SELECT chunk_type, count(*) AS n_pairs, count(DISTINCT s.node_id || '|' || s.start_line) AS n_definitions FROM c JOIN s ON c.file_path = s.file_path AND c.start_line <= s.end_line AND c.end_line >= s.start_line GROUP BY chunk_type""",
}
SQL["search_with_neighbours"] = f"""WITH {_CHUNKS}, {_bm25_sql('ch', 'chunk_id', _CHUNK_WORDS, _CODE_TERMS)},
    lr AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS lexical_rank FROM lex),
    fu AS (SELECT chunk_id, {T.query_weights(CODE_QUERY)[0]} / (60 + lexical_rank) AS s, NULL AS semantic_rank, lexical_rank FROM lr),{_HYBRID.split("    fu AS")[1].split(chr(10), 1)[1].rsplit("    SELECT chunk_id, file_path", 1)[0].rstrip()},
    top AS (SELECT chunk_id, round(b + CASE WHEN rn = 1 AND m > 0 THEN 0.2 * m * fs / fmax ELSE 0 END, 6) AS score FROM fm ORDER BY score DESC, chunk_id LIMIT 20),
    o AS (SELECT DISTINCT t.chunk_id, c.symbol_id FROM top t JOIN ch c USING (chunk_id) WHERE c.symbol_id IS NOT NULL),
    nb AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
    near AS (SELECT DISTINCT o.chunk_id, nb.b AS neighbour_id FROM o JOIN nb ON nb.a = o.symbol_id AND nb.b <> o.symbol_id WHERE nb.b IN (SELECT node_id FROM symbols))
    SELECT top.chunk_id, near.neighbour_id FROM top LEFT JOIN near USING (chunk_id)"""
