"""Queries of the graph, linking, table and wiki operators, over symbols, edges and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamdex.operators import graph as G, tables as T, wiki as K
from loamdex.session import table
from loamdex.sources import history as H, parse as P

# The questions asked of the tables: the class that defines most, the function that most call, and the one that calls most.
_MOST = "SELECT {c} AS node_id FROM edges WHERE {w} GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1"
_DEFINES, _CALLS = "edge_type = 'DEFINES' AND source_id NOT LIKE 'file:%'", "edge_type = 'CALLS' AND target_id NOT LIKE 'call:%'"
SEED, CALLED, ENTRY = _MOST.format(c="source_id", w=_DEFINES), _MOST.format(c="target_id", w=_CALLS), _MOST.format(c="source_id", w=_CALLS)
PART = "handle"


def _t(spark: SparkSession, sf_dir: str, *names: str):
    got = [table(spark, sf_dir, n) for n in names]
    return got[0] if len(got) == 1 else got


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "edges")


def _most(spark: SparkSession, sf_dir: str, where: str, end: str) -> DataFrame:
    e = _edges(spark, sf_dir).where(where).groupBy(F.col(end).alias("node_id")).count()
    return e.orderBy(F.desc("count"), "node_id").limit(1).select("node_id")


def neighbourhood_1hop(spark, sf_dir):
    return G.neighbourhood(_edges(spark, sf_dir), _most(spark, sf_dir, _DEFINES, "source_id"), 1)


def neighbourhood_2hop(spark, sf_dir):
    return G.neighbourhood(_edges(spark, sf_dir), _most(spark, sf_dir, _DEFINES, "source_id"), 2, ["DEFINES", "INHERITS"])


def impact_closure(spark, sf_dir):
    return G.impact(_edges(spark, sf_dir), _most(spark, sf_dir, _CALLS, "target_id")).select("node_id", F.col("is_direct"))


def callers_callees(spark, sf_dir):
    return G.callers_callees(_edges(spark, sf_dir))


def trace_flow(spark, sf_dir):
    return G.trace_flow(_edges(spark, sf_dir), _most(spark, sf_dir, _CALLS, "source_id"))


def node_resolve_rank(spark, sf_dir):
    e = _edges(spark, sf_dir).select(F.explode(F.array("source_id", "target_id")).alias("node_id"))
    return G.resolve(e, PART, 20)


def module_rollup(spark, sf_dir):
    return G.module_dependencies(_edges(spark, sf_dir))


def node_cards(spark, sf_dir):
    e = _edges(spark, sf_dir).select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    return e.select("node_id", G.node_card(F.col("node_id")).alias("c")).select("node_id", "c.*")


def export_dot(spark, sf_dir):
    return G.dot_document(*_t(spark, sf_dir, "symbols", "edges"))


def export_graphml(spark, sf_dir):
    return G.graphml_document(*_t(spark, sf_dir, "symbols", "edges"))


def link_symbols(spark, sf_dir):
    return G.link(*_t(spark, sf_dir, "symbols", "edges"))


def linked_edge_types(spark, sf_dir):
    """Edges by type and by whether their target is known by name only, after linking."""
    s, e = _t(spark, sf_dir, "symbols", "edges")
    after = G.linked_edges(e, G.link(s, e))
    return after.groupBy("edge_type", F.col("target_id").rlike("^(call|symbol|module):").alias("by_name")).agg(F.count("*").alias("n_edges"))


def upsert_last_wins(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return T.upsert(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


def insert_ignore(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return T.insert_ignore(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


def latest_manifest(spark, sf_dir):
    m = _t(spark, sf_dir, "file_manifest")
    last = T.upsert(m, ["file_path"], [F.col("indexed_at"), F.col("mtime"), F.col("content_hash"), F.col("size"), F.col("language")])
    return last.select("file_path", "content_hash", "size")


def manifest_diff(spark, sf_dir):
    """From the last pass over each file before the middle of all passes to the last one after it."""
    m = _t(spark, sf_dir, "file_manifest").where("indexed_at is not null")
    seq = [F.col("indexed_at"), F.col("mtime"), F.col("content_hash"), F.col("size")]
    middle = m.agg(F.floor((F.min(F.unix_micros(F.col("indexed_at").cast("timestamp"))) + F.max(F.unix_micros(F.col("indexed_at").cast("timestamp")))) / 2).alias("m")).first()["m"]
    early = F.unix_micros(F.col("indexed_at").cast("timestamp")) <= F.lit(middle)
    return T.manifest_changes(T.upsert(m.where(early), ["file_path"], seq), T.upsert(m.where(~early), ["file_path"], seq))


def cascade_delete(spark, sf_dir):
    """The rows that are left of each table without the test files, by their keys."""
    names = ("symbols", "edges", "chunks", "chunk_vectors", "file_manifest")
    tables = dict(zip(names, _t(spark, sf_dir, *names)))
    files = tables["symbols"].where(F.col("file_path").contains("/tests/")).select("file_path").distinct()
    left = T.remove_files(tables, files)
    keys = {"symbols": ["node_id"], "edges": ["source_id", "target_id", "edge_type"], "chunks": ["chunk_id"], "chunk_vectors": ["chunk_id"], "file_manifest": ["file_path"]}
    parts = [left[t].select(F.lit(t).alias("table_name"), F.concat_ws("|", *k).alias("row_key")) for t, k in keys.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("table_name", "row_key").agg(F.count("*").alias("n_rows"))


def index_stats(spark, sf_dir):
    names = ("symbols", "edges", "chunks", "chunk_vectors", "file_manifest")
    return T.index_stats(dict(zip(names, _t(spark, sf_dir, *names))))


def unknown_kinds(spark, sf_dir):
    names = ("symbols", "edges", "chunks")
    return T.unknown_kinds(dict(zip(names, _t(spark, sf_dir, *names))))


def commit_log(spark, sf_dir):
    logs = _t(spark, sf_dir, "chunks").where("chunk_type = 'git'").select("chunk_id", "content").distinct()
    return H.commits(logs, keep=["chunk_id"])


def author_churn(spark, sf_dir):
    return H.churn(commit_log(spark, sf_dir), "author", "commit_id")


def file_churn(spark, sf_dir):
    """Commits per file, of the files that the logs name."""
    logs = _t(spark, sf_dir, "chunks").where("chunk_type = 'git'").select("content").distinct()
    return H.churn(H.file_changes(logs), "file_path", "commit_id")


def changed_files(spark, sf_dir):
    """Files with more than one content, and files of which only the symbols know."""
    s, m = _t(spark, sf_dir, "symbols", "file_manifest")
    several = m.groupBy("file_path").agg(F.countDistinct("content_hash").alias("n")).where("n > 1")
    untracked = s.join(m, "file_path", "left_anti")
    return H.changed_files(several, several.limit(0), untracked)


def impact_size(spark, sf_dir):
    """How many nodes a change reaches, and how many of them at once."""
    return impact_closure(spark, sf_dir).agg(F.count("*").alias("affected_count"), F.count(F.when(F.col("is_direct"), 1)).alias("direct_count"))


def wiki_index(spark, sf_dir):
    """Index, architecture and workflow pages."""
    s, e = _t(spark, sf_dir, "symbols", "edges")
    return K.index_pages(s).unionByName(K.architecture_pages(s, e)).unionByName(K.workflow_pages(e))


def wiki_module_table(spark, sf_dir):
    return K.module_table(_t(spark, sf_dir, "symbols"))


def wiki_architecture(spark, sf_dir):
    return K.architecture_edges(_edges(spark, sf_dir))


def wiki_workflows(spark, sf_dir):
    return K.workflows(_edges(spark, sf_dir)).select("source_id", "part_no", F.array_join("steps", " ").alias("steps"))


def wiki_pages(spark, sf_dir):
    return K.module_pages(*_t(spark, sf_dir, "symbols", "edges"))


def wiki_chunks(spark, sf_dir):
    """The pages as chunks; the two lists are given as words, so that SQL can compare them."""
    words = lambda c: F.array_join(c, " ").alias(c)
    chunks = K.page_chunks(wiki_pages(spark, sf_dir))
    return chunks.select(*(words(c) if c.startswith("identifier") else c for c in chunks.columns))


def _parsed(spark, sf_dir) -> dict[str, DataFrame]:
    s = _t(spark, sf_dir, "symbols").where("node_id like 'file:%'").select("file_path", "language", F.col("source_code").alias("content")).distinct()
    return P.split(P.parse(s))


def parse_symbols(spark, sf_dir):
    return _parsed(spark, sf_dir)["symbols"].drop("source_code")


def parse_edges(spark, sf_dir):
    return _parsed(spark, sf_dir)["edges"].select("source_id", "target_id", "edge_type")


def _other_files(spark, sf_dir) -> DataFrame:
    """Texts of files that are read by the beginnings of their definitions."""
    return _t(spark, sf_dir, "symbols").where("node_id like 'file:%' and source_code is not null and file_path is not null and coalesce(language, '') <> 'python'")


def parse_definitions(spark, sf_dir):
    """Classes and functions of the files in other languages than Python."""
    s = _other_files(spark, sf_dir).select("file_path", "language", F.col("source_code").alias("content")).distinct()
    return P.split(P.parse(s))["symbols"].where("kind <> 'module'").select("file_path", "kind", "name").distinct()


def parse_imports(spark, sf_dir):
    """Imports of the files in other languages than Python."""
    s = _other_files(spark, sf_dir).select("file_path", "language", F.col("source_code").alias("content")).distinct()
    return P.split(P.parse(s))["edges"].where("edge_type = 'IMPORTS'").select("source_id", "target_id").distinct()


def parse_chunks(spark, sf_dir):
    return _parsed(spark, sf_dir)["chunks"].select("chunk_id", "symbol_id", "chunk_type", "content_hash", "start_line", "end_line")


QUERIES = {
    f.__name__: f
    for f in (
        neighbourhood_1hop, neighbourhood_2hop, impact_closure, callers_callees, trace_flow, node_resolve_rank, module_rollup, node_cards, export_dot, export_graphml, link_symbols,
        linked_edge_types, upsert_last_wins, insert_ignore, latest_manifest, manifest_diff, cascade_delete, index_stats, unknown_kinds, commit_log, author_churn, file_churn, changed_files, impact_size, wiki_index, wiki_module_table,
        wiki_architecture, wiki_workflows, wiki_pages, wiki_chunks, parse_symbols, parse_edges, parse_chunks, parse_definitions, parse_imports,
    )
}

_BOTH = "b AS (SELECT source_id AS a, target_id AS b, edge_type FROM edges UNION ALL SELECT target_id, source_id, edge_type FROM edges)"
_MODULE = "replace(replace(split_part({c}, ':', 1), '/', '_'), '.', '_')"
_ROLLUP = f"""SELECT DISTINCT src, tgt FROM (SELECT {_MODULE.format(c='source_id')} AS src, {_MODULE.format(c='target_id')} AS tgt FROM edges WHERE edge_type IN ('IMPORTS', 'CALLS'))
    WHERE length(src) BETWEEN 1 AND 39 AND length(tgt) BETWEEN 1 AND 39 AND src <> tgt"""
_ENDS = "SELECT DISTINCT node_id FROM (SELECT source_id AS node_id FROM edges UNION ALL SELECT target_id FROM edges)"
_NODES = "SELECT node_id FROM symbols UNION SELECT source_id FROM edges UNION SELECT target_id FROM edges"
_SEQ = "indexed_at {d} NULLS LAST, mtime {d} NULLS LAST, content_hash {d} NULLS LAST, size {d} NULLS LAST"
_X = "replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_LINK = """
    sym AS (SELECT node_id, r.file_path, r.start_line, r.name FROM (SELECT node_id, min({'file_path': file_path, 'start_line': start_line, 'name': name}) AS r FROM symbols WHERE node_id IS NOT NULL AND name IS NOT NULL GROUP BY node_id)),
    raw AS (SELECT DISTINCT e.source_id, e.target_id AS original, e.edge_type, regexp_replace(e.target_id, '^(call|symbol):', '') AS want, s.file_path AS file
            FROM edges e LEFT JOIN sym s ON e.source_id = s.node_id
            WHERE (e.edge_type = 'CALLS' AND e.target_id LIKE 'call:%') OR (e.edge_type = 'INHERITS' AND e.target_id LIKE 'symbol:%')),
    uniq AS (SELECT name, min(node_id) AS hit FROM sym GROUP BY name HAVING count(*) = 1),
    imp AS (SELECT DISTINCT regexp_replace(source_id, '^file:', '') AS file, metadata['module'] AS module, metadata['name'] AS nm, metadata['alias'] AS al, coalesce(try_cast(metadata['line'] AS INT), 0) AS seq
            FROM edges WHERE edge_type = 'IMPORTS' AND source_id LIKE 'file:%'),
    r2 AS (SELECT r.source_id, r.original, r.edge_type, 2 AS rule, arg_max(s.node_id, {'l': s.start_line, 'n': s.node_id}) AS hit FROM raw r JOIN sym s ON r.file = s.file_path AND r.want = s.name GROUP BY ALL),
    r3 AS (SELECT source_id, original, edge_type, 3 AS rule, node_id AS hit FROM (
            SELECT r.*, s.node_id, row_number() OVER (PARTITION BY r.source_id, r.original, r.edge_type
                ORDER BY i.seq, i.module NULLS FIRST, i.nm, CASE WHEN contains(replace(s.file_path, '/', '.'), coalesce(i.module, '')) THEN 0 ELSE 1 END, s.file_path, s.start_line, s.node_id) AS k
            FROM raw r JOIN imp i ON r.file = i.file AND (r.want = i.nm OR r.want = i.al) JOIN sym s ON s.name = i.nm WHERE r.edge_type = 'CALLS') WHERE k = 1),
    dot AS (SELECT *, split_part(want, '.', -1) AS fn, substring(want, 1, length(want) - length(split_part(want, '.', -1)) - 1) AS mod FROM raw WHERE edge_type = 'CALLS' AND contains(want, '.')),
    r3b AS (SELECT source_id, original, edge_type, 3 AS rule, node_id AS hit FROM (
            SELECT r.*, s.node_id, row_number() OVER (PARTITION BY r.source_id, r.original ORDER BY i.seq, i.module NULLS FIRST, s.file_path, s.start_line, s.node_id) AS k
            FROM dot r JOIN imp i ON r.file = i.file AND (i.al = r.mod OR i.nm = r.mod OR ends_with(i.module, r.mod)) JOIN sym s ON s.name = r.fn WHERE contains(replace(s.file_path, '/', '.'), r.mod)) WHERE k = 1),
    r4 AS (SELECT source_id, original, edge_type, 4 AS rule, u.hit FROM dot d JOIN uniq u ON d.fn = u.name),
    r5 AS (SELECT source_id, original, edge_type, 5 AS rule, u.hit FROM raw r JOIN uniq u ON r.want = u.name),
    hits AS (SELECT source_id, original, edge_type, min({'rule': rule, 'hit': hit}) AS h FROM (SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r3b UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5) GROUP BY ALL),
    links AS (SELECT source_id, original, edge_type, h.hit AS target_id, h.rule AS rule FROM hits WHERE h.hit <> source_id)
"""
_STATS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("symbols", "edges", "chunks", "chunk_vectors", "file_manifest"))

SQL = {
    "neighbourhood_1hop": f"""WITH {_BOTH}, s AS ({SEED}) SELECT node_id, 0 AS level FROM s UNION ALL SELECT DISTINCT b.b, 1 FROM b JOIN s ON b.a = s.node_id WHERE b.b NOT IN (SELECT node_id FROM s)""",
    "neighbourhood_2hop": f"""WITH RECURSIVE {_BOTH}, r(node_id, level) AS (SELECT node_id, 0 FROM ({SEED}) UNION SELECT b.b, level + 1 FROM r JOIN b ON b.a = r.node_id AND edge_type IN ('DEFINES', 'INHERITS') WHERE level < 2)
        SELECT node_id, min(level) AS level FROM r GROUP BY node_id""",
    "impact_closure": f"""WITH RECURSIVE st AS (SELECT target_id AS a, source_id AS b FROM edges WHERE edge_type = 'CALLS' UNION ALL SELECT source_id, target_id FROM edges WHERE edge_type = 'DEFINES'),
        s AS ({CALLED}), d AS (SELECT DISTINCT st.b AS node_id FROM st JOIN s ON st.a = s.node_id),
        r(node_id) AS (SELECT node_id FROM d UNION SELECT st.b FROM r JOIN st ON st.a = r.node_id)
        SELECT node_id, node_id IN (SELECT node_id FROM d) AS is_direct FROM r""",
    "callers_callees": """WITH c AS (SELECT DISTINCT source_id, target_id FROM edges WHERE edge_type = 'CALLS')
        SELECT node_id, sum(i)::BIGINT AS n_callers, sum(o)::BIGINT AS n_callees FROM (SELECT target_id AS node_id, 1 AS i, 0 AS o FROM c UNION ALL SELECT source_id, 0, 1 FROM c) GROUP BY node_id""",
    "trace_flow": f"""WITH RECURSIVE c AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges WHERE edge_type = 'CALLS'),
        r(node_id, depth, path) AS (SELECT node_id, 0, node_id FROM ({ENTRY}) UNION SELECT c.b, depth + 1, path || ' > ' || c.b FROM r JOIN c ON c.a = r.node_id WHERE depth < 10)
        SELECT node_id, depth, min(path) AS path FROM (SELECT *, min(depth) OVER (PARTITION BY node_id) AS d FROM r) WHERE depth = d GROUP BY node_id, depth""",
    "node_resolve_rank": f"""SELECT node_id FROM ({_ENDS}) WHERE contains(node_id, '{PART}')
        ORDER BY starts_with(node_id, 'call:'), starts_with(node_id, 'module:'), starts_with(node_id, 'symbol:'), length(node_id), node_id LIMIT 20""",
    "module_rollup": _ROLLUP,
    "node_cards": f"""SELECT node_id, split_part(regexp_replace(node_id, '^(call|module|symbol|file):', ''), ':', -1) AS name, k AS kind, CASE WHEN k IN ('file', 'definition') THEN split_part(regexp_replace(node_id, '^(call|module|symbol|file):', ''), ':', 1) END AS file_path
        FROM (SELECT node_id, CASE WHEN starts_with(node_id, 'call:') THEN 'call' WHEN starts_with(node_id, 'module:') THEN 'module' WHEN starts_with(node_id, 'symbol:') THEN 'symbol' WHEN starts_with(node_id, 'file:') THEN 'file' ELSE 'definition' END AS k FROM ({_ENDS}))""",
    "export_dot": f"""SELECT 0 AS part, 'digraph G {{' AS line UNION ALL SELECT 1, '  rankdir=LR;' UNION ALL SELECT 4, '}}'
        UNION ALL SELECT 2, '  "' || replace(node_id, '"', '\\"') || '";' FROM ({_NODES}) WHERE node_id IS NOT NULL
        UNION ALL (SELECT DISTINCT 3, '  "' || replace(source_id, '"', '\\"') || '" -> "' || replace(target_id, '"', '\\"') || '" [label="' || replace(coalesce(edge_type, ''), '"', '\\"') || '"];' AS line FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL)""",
    "export_graphml": f"""SELECT 0 AS part, '<?xml version="1.0" encoding="utf-8"?>' AS line UNION ALL SELECT 1, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' UNION ALL SELECT 2, '<key id="type" for="edge" attr.name="type" attr.type="string"/>'
        UNION ALL SELECT 3, '<graph edgedefault="directed">' UNION ALL SELECT 6, '</graph>' UNION ALL SELECT 7, '</graphml>'
        UNION ALL SELECT 4, '<node id="' || {_X.format(c='node_id')} || '"/>' FROM ({_NODES}) WHERE node_id IS NOT NULL
        UNION ALL (SELECT DISTINCT 5, '<edge source="' || {_X.format(c='source_id')} || '" target="' || {_X.format(c='target_id')} || '"><data key="type">' || {_X.format(c="coalesce(edge_type, '')")} || '</data></edge>' AS line FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL)""",
    "link_symbols": f"WITH {_LINK} SELECT * FROM links",
    "linked_edge_types": f"""WITH {_LINK} SELECT e.edge_type, regexp_matches(coalesce(l.target_id, e.target_id), '^(call|symbol|module):') AS by_name, count(*) AS n_edges
        FROM edges e LEFT JOIN links l ON e.source_id = l.source_id AND e.target_id = l.original AND e.edge_type = l.edge_type GROUP BY ALL""",
    "upsert_last_wins": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "insert_ignore": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
    "latest_manifest": f"SELECT file_path, content_hash, size FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY {_SEQ.format(d='DESC')}) AS k FROM file_manifest) WHERE k = 1",
    "manifest_diff": f"""WITH m AS (SELECT *, indexed_at <= make_timestamp((SELECT floor((epoch_us(min(indexed_at)) + epoch_us(max(indexed_at))) / 2)::BIGINT FROM file_manifest)) AS early FROM file_manifest WHERE indexed_at IS NOT NULL),
        f AS (SELECT *, row_number() OVER (PARTITION BY file_path, early ORDER BY {_SEQ.format(d='DESC')}) AS z FROM m), o AS (SELECT * FROM f WHERE early AND z = 1), n AS (SELECT * FROM f WHERE NOT early AND z = 1)
        SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.early IS NULL THEN 'added' WHEN n.early IS NULL THEN 'deleted' WHEN coalesce(o.size = n.size AND abs(o.mtime - n.mtime) < 1e-4, false) THEN 'same'
            WHEN coalesce(o.content_hash = n.content_hash, false) THEN 'touched' ELSE 'changed' END AS change
        FROM o FULL JOIN n ON o.file_path = n.file_path""",
    "cascade_delete": """WITH f AS (SELECT DISTINCT file_path FROM symbols WHERE contains(file_path, '/tests/')), g AS (SELECT DISTINCT node_id FROM symbols SEMI JOIN f USING (file_path)), c AS (SELECT DISTINCT chunk_id FROM chunks SEMI JOIN f USING (file_path))
        SELECT table_name, row_key, count(*) AS n_rows FROM (
        SELECT 'symbols' AS table_name, concat_ws('|', node_id) AS row_key FROM symbols ANTI JOIN f USING (file_path) UNION ALL SELECT 'chunks', concat_ws('|', chunk_id) FROM chunks ANTI JOIN f USING (file_path)
        UNION ALL SELECT 'file_manifest', concat_ws('|', file_path) FROM file_manifest ANTI JOIN f USING (file_path)
        UNION ALL SELECT 'edges', concat_ws('|', source_id, target_id, edge_type) FROM edges WHERE source_id NOT IN (SELECT node_id FROM g WHERE node_id IS NOT NULL) AND target_id NOT IN (SELECT node_id FROM g WHERE node_id IS NOT NULL)
        UNION ALL SELECT 'chunk_vectors', concat_ws('|', chunk_id) FROM chunk_vectors ANTI JOIN c USING (chunk_id)) GROUP BY ALL""",
    "changed_files": """SELECT file_path FROM file_manifest GROUP BY file_path HAVING count(DISTINCT content_hash) > 1 UNION SELECT file_path FROM symbols ANTI JOIN file_manifest USING (file_path) WHERE file_path IS NOT NULL""",
    "file_churn": """WITH l AS (SELECT unnest(string_split_regex(content, '\\r?\\n')) AS x, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) AS i, h FROM (SELECT DISTINCT content, md5(content) AS h FROM chunks WHERE chunk_type = 'git')),
        n AS (SELECT *, max(CASE WHEN regexp_matches(x, '^commit [0-9a-f]{7,64}') THEN i END) OVER (PARTITION BY h ORDER BY i) AS head FROM l),
        c AS (SELECT h, i, regexp_extract(x, '^commit ([0-9a-f]+)', 1) AS commit_id FROM l),
        p AS (SELECT h, head, CASE WHEN regexp_matches(x, '^(\\d+|-)\\t(\\d+|-)\\t(.+)$') THEN regexp_extract(x, '^(\\d+|-)\\t(\\d+|-)\\t(.+)$', 3) WHEN regexp_matches(x, '^ (\\S.*?) +\\| +(?:\\d+ ?[+-]*|Bin .*)$') THEN regexp_extract(x, '^ (\\S.*?) +\\| +', 1) END AS file_path FROM n WHERE head IS NOT NULL)
        SELECT file_path, count(DISTINCT commit_id) AS n_commits FROM p JOIN c ON p.h = c.h AND p.head = c.i WHERE file_path IS NOT NULL GROUP BY file_path""",
    "index_stats": _STATS,
    "author_churn": """WITH c AS (SELECT unnest(regexp_extract_all(content, '(?m)^commit [0-9a-f]{7,64}\\r?\\nAuthor: [^<\\n]*')) AS h FROM (SELECT DISTINCT chunk_id, content FROM chunks WHERE chunk_type = 'git'))
        SELECT trim(regexp_extract(h, 'Author: ([^<\\n]*)', 1)) AS author, count(DISTINCT regexp_extract(h, '^commit ([0-9a-f]+)', 1)) AS n_commits FROM c GROUP BY 1""",
    "wiki_module_table": """SELECT file_path, count(DISTINCT CASE WHEN kind IN ('class', 'function') THEN name END) AS n_definitions,
        coalesce(split_part(min(CASE WHEN docstring <> '' THEN {'l': start_line, 'n': node_id, 'd': docstring} END).d, chr(10), 1), 'Source module') AS summary FROM symbols WHERE file_path IS NOT NULL GROUP BY file_path""",
    "wiki_architecture": f"SELECT * FROM ({_ROLLUP}) ORDER BY src, tgt LIMIT {K.LINKS}",
    "wiki_workflows": f"""WITH c AS (SELECT DISTINCT source_id, target_id FROM edges WHERE edge_type = 'CALLS'), f AS (SELECT DISTINCT source_id FROM c ORDER BY 1 LIMIT {K.FLOWS})
        SELECT source_id, ((k - 1) // {K.STEPS} + 1)::INT AS part_no, string_agg(target_id, ' ' ORDER BY target_id) AS steps FROM (SELECT c.*, row_number() OVER (PARTITION BY source_id ORDER BY target_id) AS k FROM c SEMI JOIN f USING (source_id)) GROUP BY 1, 2""",
}
_OTHER = "o AS (SELECT DISTINCT file_path, source_code FROM symbols WHERE node_id LIKE 'file:%' AND source_code IS NOT NULL AND file_path IS NOT NULL AND coalesce(language, '') <> 'python')"
_q = lambda pattern: "(?m)" + pattern.pattern.replace("'", "''")
SQL["parse_definitions"] = f"WITH {_OTHER} " + " UNION ".join(
    f"SELECT DISTINCT file_path, '{kind}' AS kind, unnest(regexp_extract_all(source_code, '{_q(pattern)}', 1)) AS name FROM o" for kind, pattern in (("class", P._CLASS), ("function", P._FUNCTION), ("function", P._CONST))
)
SQL["parse_imports"] = f"""WITH {_OTHER}, m AS (SELECT file_path, unnest(regexp_extract_all(source_code, '{_q(P._IMPORT)}')) AS x FROM o)
    SELECT DISTINCT 'file:' || file_path AS source_id, 'module:' || coalesce(nullif(regexp_extract(x, '{_q(P._IMPORT)}', 1), ''), nullif(regexp_extract(x, '{_q(P._IMPORT)}', 2), ''), regexp_extract(x, '{_q(P._IMPORT)}', 3)) AS target_id FROM m"""
SQL["impact_size"] = f"SELECT count(*) AS affected_count, count(*) FILTER (is_direct) AS direct_count FROM ({SQL['impact_closure']})"
SQL["unknown_kinds"] = " UNION ALL ".join(
    f"SELECT '{name}' AS column_name, {name.split('.')[1]} AS value, count(*) AS n_rows FROM {name.split('.')[0]} WHERE {name.split('.')[1]} IS NULL OR {name.split('.')[1]} NOT IN ({', '.join(repr(k) for k in known)}) GROUP BY 2"
    for name, known in T.KINDS.items()
)

SQL["commit_log"] = r"""WITH l AS (SELECT chunk_id, content, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i, len(string_split(content, chr(10))) AS n
        FROM (SELECT DISTINCT chunk_id, content FROM chunks WHERE chunk_type = 'git' AND content IS NOT NULL)),
    h AS (SELECT *, max(CASE WHEN regexp_matches(x, '^commit [0-9a-f]{7,64}') THEN i END) OVER (PARTITION BY chunk_id, content ORDER BY i) AS head FROM l),
    c AS (SELECT chunk_id, content, head, string_agg(x, chr(10) ORDER BY i) || CASE WHEN max(i) < max(n) THEN chr(10) ELSE '' END AS c FROM h WHERE head IS NOT NULL GROUP BY chunk_id, content, head)
    SELECT chunk_id, regexp_extract(c, '^commit ([0-9a-f]+)', 1) AS commit_id, regexp_extract(c, '(?m)^Author:\s*([^<\n]*?)\s*(<|$)', 1) AS author,
        try_strptime(regexp_extract(c, '(?m)^Date:\s*(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)', 1), '%Y-%m-%d %H:%M:%S') AS committed_at,
        trim(regexp_replace(regexp_replace(c, '(?s)^.*?\r?\n\r?\n', ''), '(?m)^ {4}', '', 'g'), ' ') AS message FROM c"""

# The pages of the wiki, put together from lines.
_FILE = "split_part({c}, '/', -1)"
_PAGE = r"regexp_replace(split_part({c}, '/', -1), '\W+', '_', 'g') || '_' || substr(sha256({c}), 1, 12)"
_MODULE_PAGES = f"""known AS (SELECT * FROM symbols WHERE file_path IS NOT NULL),
    defs AS (SELECT file_path, start_line, end_line, name, kind, min(signature) AS signature, min(docstring) AS docstring FROM known WHERE kind IN ('class', 'function', 'method') GROUP BY ALL),
    lines AS (SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY start_line NULLS FIRST, name NULLS FIRST, kind, end_line NULLS FIRST) AS k,
        '### ' || kind || ' `' || coalesce(name, '') || '`' || chr(10) || coalesce('Lines ' || start_line || '-' || end_line || chr(10), '') || coalesce('`' || signature || '`' || chr(10), '') || coalesce(docstring, '') AS t FROM defs),
    d AS (SELECT file_path, (k - 1) // 500 + 1 AS part_no, string_agg(t, chr(10) || chr(10) ORDER BY k) AS d FROM lines GROUP BY ALL),
    file_of AS (SELECT node_id, min(file_path) AS file_path FROM known GROUP BY node_id),
    calls AS (SELECT DISTINCT f.file_path, e.target_id FROM edges e JOIN file_of f ON e.source_id = f.node_id WHERE e.edge_type = 'CALLS' AND e.target_id IS NOT NULL),
    called AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY target_id) AS k FROM calls),
    c AS (SELECT file_path, (k - 1) // 500 + 1 AS part_no, string_agg('- `' || target_id || '`', chr(10) ORDER BY k) AS c FROM called GROUP BY ALL),
    about AS (SELECT file_path, min(CASE WHEN kind = 'module' AND docstring <> '' THEN {{'l': start_line, 'n': node_id, 'd': docstring}} END).d AS about FROM known GROUP BY file_path),
    n AS (SELECT file_path, count(*) AS n FROM defs GROUP BY file_path),
    parts AS (SELECT file_path, part_no FROM d UNION SELECT file_path, part_no FROM c UNION SELECT file_path, 1 FROM known),
    module_pages AS (SELECT {_PAGE.format(c='p.file_path')} AS page, p.part_no::INT AS part_no, p.file_path,
        '# ' || {_FILE.format(c='p.file_path')} || CASE WHEN p.part_no = 1 THEN '' ELSE ', part ' || p.part_no END || chr(10) || chr(10) || '`' || p.file_path || '`' || chr(10) || chr(10)
        || CASE WHEN p.part_no = 1 THEN coalesce(about || chr(10) || chr(10), '') ELSE '' END || coalesce(n, 0) || ' definitions' || chr(10) || chr(10)
        || coalesce(d, '') || chr(10) || chr(10) || '## Calls' || chr(10) || chr(10) || coalesce(c, '') AS content
        FROM parts p LEFT JOIN d ON p.file_path = d.file_path AND p.part_no = d.part_no LEFT JOIN c ON p.file_path = c.file_path AND p.part_no = c.part_no
        LEFT JOIN about a ON p.file_path = a.file_path LEFT JOIN n ON p.file_path = n.file_path)"""
SQL["wiki_pages"] = f"WITH {_MODULE_PAGES} SELECT page, part_no, file_path, content FROM module_pages"
SQL["wiki_chunks"] = f"""WITH {_MODULE_PAGES}, named AS (SELECT *, page || CASE WHEN part_no = 1 THEN '' ELSE '_' || part_no END AS called FROM module_pages)
    SELECT 'wiki:' || called AS chunk_id, NULL::VARCHAR AS symbol_id, '.wiki/' || called || '.md' AS file_path, 'wiki' AS chunk_type, content, 1 AS start_line, len(string_split(content, chr(10)))::INT AS end_line,
        'markdown' AS language, sha256(content) AS content_hash, false AS is_definition, page AS identifiers,
        array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(page, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[_\\W]+'), lambda x: x <> ''), ' ') AS identifier_tokens FROM named"""
_SHORT = "replace(split_part({c}, ':', -1), '.', '_')"
_CELLS = "1 + ('0x' || cell)::INT * 100000 + (k - 1) // 500 + 1"
SQL["wiki_index"] = f"""WITH files AS (SELECT DISTINCT file_path, substr(sha256(file_path), 1, 2) AS cell FROM symbols WHERE file_path IS NOT NULL),
    listed AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY file_path) AS k, '- [' || {_FILE.format(c='file_path')} || '](' || {_PAGE.format(c='file_path')} || '.md)' AS line FROM files),
    summaries AS ({SQL['wiki_module_table']}),
    defined AS (SELECT file_path, name, row_number() OVER (PARTITION BY file_path ORDER BY name) AS k FROM (SELECT DISTINCT file_path, name FROM symbols WHERE file_path IS NOT NULL AND kind IN ('class', 'function') AND name IS NOT NULL)),
    names AS (SELECT file_path, (k - 1) // 500 + 1 AS pos, string_agg('`' || name || '`', ', ' ORDER BY name) AS names FROM defined GROUP BY ALL),
    lines AS (SELECT cell, file_path, coalesce(pos, 1) AS pos, '| [`' || {_FILE.format(c='file_path')} || '`](' || {_PAGE.format(c='file_path')} || '.md) | ' || coalesce(names, 'Module') || ' | ' || summary || ' |' AS line
        FROM files JOIN summaries USING (file_path) LEFT JOIN names USING (file_path)),
    tabled AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY file_path, pos) AS k FROM lines),
    flows AS (SELECT source_id, part_no, row_number() OVER (ORDER BY source_id, part_no) AS no, steps FROM ({SQL['wiki_workflows'].replace("string_agg(target_id, ' ' ORDER BY target_id)", "list(target_id ORDER BY target_id)")}))
    SELECT 'index' AS page, 1 AS part_no, NULL::VARCHAR AS file_path, concat_ws(chr(10), '# Wiki', '', '- [Architecture](architecture.md)', '- [Workflows](workflows.md)', '', '## Modules', '') AS content
    UNION ALL SELECT 'index', {_CELLS}, NULL, string_agg(line, chr(10) ORDER BY file_path) FROM listed GROUP BY 2
    UNION ALL SELECT 'architecture', 1, NULL, concat_ws(chr(10), '# Architecture', '', '```mermaid', 'graph TD', coalesce(string_agg('    ' || src || ' --> ' || tgt, chr(10) ORDER BY '    ' || src || ' --> ' || tgt), ''), '```', '') FROM ({SQL['wiki_architecture']})
    UNION ALL SELECT 'architecture', {_CELLS}, NULL, concat_ws(chr(10), '# Modules', '', '| File | Defines | Summary |', '| :--- | :--- | :--- |', string_agg(line, chr(10) ORDER BY file_path, pos), '') FROM tabled GROUP BY 2
    UNION ALL SELECT 'workflows', no, NULL, '### Flow from `' || split_part(source_id, ':', -1) || '`' || chr(10) || '```mermaid' || chr(10) || 'sequenceDiagram' || chr(10)
        || array_to_string(list_transform(steps, lambda x: '    ' || {_SHORT.format(c='source_id')} || '->>' || {_SHORT.format(c='x')} || ': invoke'), chr(10)) || chr(10) || '```' || chr(10) FROM flows"""
