"""Queries of the general data problems: p3 (hierarchies) and p5 (orphans)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamdex.operators import hierarchy as H, orphans as O
from loamdex.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of depth 3 or more, and those whose parents never end."""
    tree = H.hierarchy(table(spark, sf_dir, "symbols"), paths=False)
    return tree.where("depth >= 3 or depth = -1").select(F.col("id").alias("node_id"), "root_id", "depth")


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = H.hierarchy(table(spark, sf_dir, "symbols"))
    return tree.select(
        F.col("id").alias("node_id"), "root_id", "depth", F.when(F.col("depth") >= 0, F.array_join("path", " > ")).alias("full_path"), "n_descendants"
    )


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.descendants(H.hierarchy(table(spark, sf_dir, "symbols")))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.orphan_references(*(table(spark, sf_dir, t) for t in ("symbols", "edges", "chunks", "chunk_vectors")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "field_name", "owner_id", "missing_id", "edge_type").distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.orphan_report(_orphans(spark, sf_dir), table(spark, sf_dir, "file_manifest"))


QUERIES = {f.__name__: f for f in (p3_found, p3_hierarchy, p3_descendants, p5_found, p5_report)}

_NODES = """
    ids AS (SELECT DISTINCT node_id AS id FROM symbols WHERE node_id IS NOT NULL),
    links AS (SELECT i.id, min(p.id) AS parent FROM ids i LEFT JOIN symbols s ON s.node_id = i.id LEFT JOIN ids p ON s.parent_id = p.id AND trim(s.parent_id) <> '' GROUP BY i.id),
    tree AS (SELECT id AS node_id, id AS root_id, 0 AS depth, id AS full_path, [id] AS path FROM links WHERE parent IS NULL
             UNION ALL
             SELECT l.id, t.root_id, t.depth + 1, t.full_path || ' > ' || l.id, list_append(t.path, l.id)
             FROM links l JOIN tree t ON l.parent = t.node_id),
    lost AS (SELECT id, parent FROM links WHERE id NOT IN (SELECT node_id FROM tree)),
    reach(id, up) AS (SELECT id, parent FROM lost UNION SELECT r.id, l.parent FROM reach r JOIN lost l ON r.up = l.id),
    loops AS (SELECT id FROM reach WHERE id = up),
    lost_root AS (SELECT r.id, min(r.up) AS root_id FROM reach r JOIN loops o ON r.up = o.id GROUP BY r.id),
    fed AS (SELECT l.id AS node_id, [l.id] AS path FROM lost l JOIN loops o ON l.parent = o.id WHERE l.id NOT IN (SELECT id FROM loops)
            UNION ALL SELECT l.id, list_append(f.path, l.id) FROM lost l JOIN fed f ON l.parent = f.node_id),
    paths AS (SELECT node_id, path FROM tree UNION ALL SELECT node_id, path FROM fed)
"""

# Two ids name one path if they agree after this; as in canonical_key, for the spellings SQL regexes can undo.
_CANON = r"""regexp_replace(regexp_replace(regexp_replace(replace(trim({c}), '\', '/'), '/(\./)+', '/', 'g'), '/+', '/', 'g'), '^((chunk:)?(file:)?)(\./)+', '\1')"""
_REFS = f"""
    refs AS (
        SELECT 'edges' AS table_name, 'target_id' AS field_name, source_id AS owner_id, target_id AS missing_id, coalesce(edge_type, '') AS edge_type, source_id AS path_id, 's' AS parent FROM edges
        UNION ALL SELECT 'edges', 'source_id', target_id, source_id, coalesce(edge_type, ''), source_id, 's' FROM edges
        UNION ALL SELECT 'symbols', 'parent_id', node_id, parent_id, '', node_id, 's' FROM symbols
        UNION ALL SELECT 'chunks', 'symbol_id', chunk_id, symbol_id, '', coalesce(file_path, chunk_id), 's' FROM chunks
        UNION ALL SELECT 'chunk_vectors', 'chunk_id', chunk_id, chunk_id, '', chunk_id, 'c' FROM chunk_vectors),
    keys AS (
        SELECT DISTINCT 's' AS parent, {_CANON.format(c="node_id")} AS key FROM symbols WHERE node_id IS NOT NULL
        UNION ALL SELECT DISTINCT 'c', {_CANON.format(c="chunk_id")} FROM chunks WHERE chunk_id IS NOT NULL),
    orphans AS (
        SELECT DISTINCT table_name, field_name, owner_id, missing_id, edge_type,
               CASE WHEN NOT regexp_matches({_CANON.format(c="path_id")}, '^(call|symbol|module):')
                    THEN split_part(regexp_replace({_CANON.format(c="path_id")}, '^(chunk:)?(file:)?', ''), ':', 1) END AS ref_file
        FROM refs r
        WHERE trim(missing_id) <> '' AND NOT regexp_matches(ltrim(missing_id), '^(call|symbol|module):')
          AND NOT EXISTS (SELECT 1 FROM keys k WHERE k.parent = r.parent AND k.key = {_CANON.format(c="r.missing_id")}))
"""

SQL = {
    "p3_found": f"""WITH RECURSIVE {_NODES}
        SELECT node_id, root_id, depth FROM tree WHERE depth >= 3
        UNION ALL SELECT id, root_id, -1 FROM lost_root""",
    "p3_hierarchy": f"""WITH RECURSIVE {_NODES},
        sizes AS (SELECT a AS node_id, count(*) - 1 AS n_descendants FROM (SELECT unnest(path) AS a FROM paths) GROUP BY a)
        SELECT t.node_id, t.root_id, t.depth, t.full_path, s.n_descendants FROM tree t JOIN sizes s USING (node_id)
        UNION ALL SELECT id, root_id, -1, NULL, s.n_descendants FROM lost_root LEFT JOIN sizes s ON s.node_id = id""",
    "p3_descendants": f"""WITH RECURSIVE {_NODES},
        pairs AS (SELECT unnest(path) AS ancestor_id, generate_subscripts(path, 1) AS pos, node_id, len(path) AS n FROM paths)
        SELECT ancestor_id, node_id, n - pos AS distance FROM pairs WHERE pos < n""",
    "p5_found": f"WITH {_REFS} SELECT DISTINCT table_name, field_name, owner_id, missing_id, edge_type FROM orphans",
    "p5_report": f"""WITH {_REFS},
        periods AS (SELECT {_CANON.format(c="file_path")} AS ref_file, strftime(max(indexed_at), '%Y-%m') AS period FROM file_manifest GROUP BY 1)
        SELECT table_name, field_name, edge_type, coalesce(period, '') AS period, count(*) AS n_orphans
        FROM orphans LEFT JOIN periods USING (ref_file) GROUP BY ALL""",
}
