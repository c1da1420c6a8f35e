"""Wiki pages from symbols and edges, one row per page; Spark writes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from loamdex.functions.text import file_name, split_identifier
from loamdex.operators.graph import module_dependencies

#: Lines that a diagram holds at most, flows that are told, and steps in a part of a flow.
NODES, LINKS, FLOWS, STEPS = 20, 30, 15, 20


def module_table(symbols: DataFrame) -> DataFrame:
    """``file_path, n_definitions, summary``: the first line of the first documentation of each file."""
    doc = F.when(F.col("docstring") != "", F.struct("start_line", "node_id", "docstring"))
    return symbols.where("file_path is not null").groupBy("file_path").agg(
        F.countDistinct(F.when(F.col("kind").isin("class", "function"), F.col("name"))).alias("n_definitions"),
        F.coalesce(F.substring_index(F.min(doc)["docstring"], "\n", 1), F.lit("Source module")).alias("summary"),
    )


def architecture_edges(edges: DataFrame) -> DataFrame:
    """The first links between modules, by name."""
    return module_dependencies(edges).orderBy("src", "tgt").limit(LINKS)


def workflows(edges: DataFrame) -> DataFrame:
    """``source_id, part_no, steps``: the callers that come first by name, with all their callees by name, ``STEPS`` in a part."""
    calls = edges.where("edge_type = 'CALLS'").select("source_id", "target_id").distinct()
    few = calls.select("source_id").distinct().orderBy("source_id").limit(FLOWS)
    mine = calls.join(F.broadcast(few), "source_id")  # FLOWS rows
    numbered = _parts(mine, "source_id", [F.col("target_id")], STEPS)
    return numbered.groupBy("source_id", "part_no").agg(F.array_sort(F.collect_list("target_id")).alias("steps"))


def _parts(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """``rows`` with ``k``, their number within the key, and ``part_no`` from 1, ``most`` rows each.

    The window of a hot key is sorted with spilling; only a part is ever gathered.
    """
    numbered = rows.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return numbered.withColumn("part_no", F.floor((F.col("k") - 1) / most).cast("int") + 1)


def page_id(path) -> F.Column:
    """Name of the page of a file: its stem alone would let files of one name overwrite each other."""
    return F.concat(F.regexp_replace(file_name(path), r"\W+", "_"), F.lit("_"), F.substring(F.sha2(path, 256), 1, 12))


def module_pages(symbols: DataFrame, edges: DataFrame, most: int = 500, summarise: Callable | None = None) -> DataFrame:
    """``page, part_no, file_path, content``: Markdown pages of every file: what it says of itself, its
    definitions in line order with their whole documentation, and what it calls.

    Each part holds ``most`` definitions and ``most`` calls at most; a file has as many parts as
    it takes. ``summarise`` may turn the content column into one with a summary.
    """
    key = ["file_path", "part_no"]
    known = symbols.where("file_path is not null")
    defs = known.where("kind in ('class', 'function', 'method')").groupBy("file_path", "start_line", "end_line", "name", "kind").agg(F.min("signature").alias("signature"), F.min("docstring").alias("docstring"))
    text = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat(
        F.lit("### "), F.col("kind"), F.lit(" `"), text(F.col("name")), F.lit("`\n"), text(F.concat(F.lit("Lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n"))),
        text(F.concat(F.lit("`"), F.col("signature"), F.lit("`\n"))), text(F.col("docstring")),
    )
    numbered = _parts(defs.withColumn("t", line), "file_path", [F.col("start_line"), F.col("name"), F.col("kind"), F.col("end_line")], most)
    d = numbered.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("d"))
    file_of = known.groupBy(F.col("node_id").alias("source_id")).agg(F.min("file_path").alias("file_path"))
    calls = edges.where("edge_type = 'CALLS' and target_id is not null").select("source_id", "target_id").join(file_of, "source_id").select("file_path", "target_id").distinct()
    c = _parts(calls, "file_path", [F.col("target_id")], most).groupBy(*key).agg(F.array_sort(F.collect_list("target_id")).alias("c"))
    own = F.when((F.col("kind") == "module") & (F.col("docstring") != ""), F.struct("start_line", "node_id", "docstring"))
    about = known.groupBy("file_path").agg(F.min(own)["docstring"].alias("about"))
    whole = known.select("file_path").distinct().join(defs.groupBy("file_path").agg(F.count("*").alias("n")), "file_path", "left").select("file_path", F.coalesce("n", F.lit(0)).alias("n"), F.lit(1).alias("part_no"))
    none = F.array().cast("array<string>")
    first = F.col("part_no") == 1
    body = F.concat(
        F.lit("# "), file_name(F.col("file_path")), F.when(first, F.lit("")).otherwise(F.concat(F.lit(", part "), F.col("part_no").cast("string"))), F.lit("\n\n`"), F.col("file_path"), F.lit("`\n\n"),
        F.when(first, text(F.concat("about", F.lit("\n\n")))).otherwise(F.lit("")), F.col("n").cast("string"), F.lit(" definitions\n\n"),
        F.array_join(F.coalesce(F.transform("d", lambda x: x["t"]), none), "\n\n"), F.lit("\n\n## Calls\n\n"), F.array_join(F.transform(F.coalesce("c", none), lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n"),
    )
    every = d.join(c, key, "full_outer").join(whole.select(*key), key, "full_outer")  # a file without either has a first part too
    out = every.join(whole.drop("part_no"), "file_path").join(about, "file_path")
    out = out.select(page_id(F.col("file_path")).alias("page"), "part_no", "file_path", body.alias("content"))
    return summarise(out) if summarise else out


#: Files that a part of the index or of the architecture page lists.
FILES = 500


def _numbered_files(rows: DataFrame) -> DataFrame:
    """``rows`` (one per file_path) with ``part_no``, ``FILES`` in a part, by path; ranges of paths are numbered in parallel."""
    cut = rows.withColumn("cell", F.substring(F.sha2("file_path", 256), 1, 2))
    return _parts(cut, "cell", [F.col("file_path")], FILES)


def _part_number():
    """A number above 1 for the part of a cell, so that no one task numbers them all."""
    return 1 + F.conv("cell", 16, 10).cast("int") * 100_000 + F.col("part_no")


def _named(page: str, part, content) -> list:
    return [F.lit(page).alias("page"), part.cast("int").alias("part_no"), F.lit(None).cast("string").alias("file_path"), content.alias("content")]


def architecture_pages(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """The page ``architecture``: a diagram of the first links between modules, then tables of the files with the names they define."""
    link = F.concat(F.lit("    "), F.col("src"), F.lit(" --> "), F.col("tgt"))
    diagram = architecture_edges(edges).agg(F.array_join(F.array_sort(F.collect_list(link)), "\n").alias("d"))  # LINKS rows
    head = diagram.select(*_named("architecture", F.lit(1), F.concat(F.lit("# Architecture\n\n```mermaid\ngraph TD\n"), "d", F.lit("\n```\n"))))
    defined = symbols.where("file_path is not null and kind in ('class', 'function') and name is not null").select("file_path", "name").distinct()
    parts = _parts(defined, "file_path", [F.col("name")], 500).groupBy("file_path", "part_no").agg(F.array_sort(F.collect_list("name")).alias("names"))
    table = module_table(symbols).select("file_path", "summary").join(parts, "file_path", "left").withColumn("at", F.coalesce("part_no", F.lit(1)))
    names = F.when(F.col("names").isNotNull(), F.array_join(F.transform("names", lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")).otherwise("Module")
    row = F.concat(F.lit("| [`"), file_name(F.col("file_path")), F.lit("`]("), page_id(F.col("file_path")), F.lit(".md) | "), names, F.lit(" | "), F.col("summary"), F.lit(" |"))
    cut = table.select(F.substring(F.sha2("file_path", 256), 1, 2).alias("cell"), "file_path", "at", row.alias("row"))
    listed = _parts(cut, "cell", [F.col("file_path"), F.col("at")], FILES).groupBy("cell", "part_no").agg(F.array_sort(F.collect_list(F.struct("file_path", "at", "row"))).alias("r"))
    listed = listed.withColumn("no", _part_number())
    body = F.concat(F.lit("# Modules\n\n| File | Defines | Summary |\n| :--- | :--- | :--- |\n"), F.array_join(F.col("r.row"), "\n"), F.lit("\n"))
    return head.unionByName(listed.select(*_named("architecture", F.col("no"), body)))


def workflow_pages(edges: DataFrame) -> DataFrame:
    """The page ``workflows``: a sequence diagram for each part of ``workflows``."""
    short = lambda c: F.replace(F.regexp_replace(F.substring_index(c, ":", -1), "^call:", ""), F.lit("."), F.lit("_"))
    mine = F.substring_index("source_id", ":", -1)
    steps = F.transform("steps", lambda x: F.concat(F.lit("    "), short(F.col("source_id")), F.lit("->>"), short(x), F.lit(": invoke")))
    flows = workflows(edges).withColumn("no", F.row_number().over(W.orderBy("source_id", "part_no")))  # FLOWS callers
    return flows.select(*_named("workflows", F.col("no"), F.concat(F.lit("### Flow from `"), mine, F.lit("`\n```mermaid\nsequenceDiagram\n"), F.array_join(steps, "\n"), F.lit("\n```\n"))))


def index_pages(symbols: DataFrame) -> DataFrame:
    """The page ``index``: links to the other pages, then to the page of every file."""
    files = symbols.where("file_path is not null").select("file_path").distinct()
    line = F.concat(F.lit("- ["), file_name(F.col("file_path")), F.lit("]("), page_id(F.col("file_path")), F.lit(".md)"))
    listed = _numbered_files(files.withColumn("line", line)).groupBy("cell", "part_no").agg(F.array_sort(F.collect_list(F.struct("file_path", "line"))).alias("r"))
    listed = listed.withColumn("no", _part_number())
    head = symbols.sparkSession.range(1).select(*_named("index", F.lit(1), F.lit("# Wiki\n\n- [Architecture](architecture.md)\n- [Workflows](workflows.md)\n\n## Modules\n")))
    return head.unionByName(listed.select(*_named("index", F.col("no"), F.array_join(F.col("r.line"), "\n"))))


def pages(symbols: DataFrame, edges: DataFrame, summarise: Callable | None = None) -> DataFrame:
    """All pages: index, architecture, workflows and modules."""
    return index_pages(symbols).unionByName(architecture_pages(symbols, edges)).unionByName(workflow_pages(edges)).unionByName(module_pages(symbols, edges, summarise=summarise))


def write_pages(pages: DataFrame, path: str) -> None:
    """Write Markdown, a folder ``page=<name>`` per page, its parts in order."""
    pages.repartition("page").sortWithinPartitions("page", "part_no").select("page", F.col("content").alias("value")).write.mode("overwrite").partitionBy("page").text(path)


def page_chunks(pages: DataFrame) -> DataFrame:
    """Pages as chunks of the type wiki, to be searched like code."""
    none = F.lit(None).cast("string")
    name = F.concat("page", F.when(F.col("part_no") == 1, F.lit("")).otherwise(F.concat(F.lit("_"), F.col("part_no").cast("string"))))
    return pages.select(
        F.concat(F.lit("wiki:"), name).alias("chunk_id"), none.alias("symbol_id"), F.concat(F.lit(".wiki/"), name, F.lit(".md")).alias("file_path"), F.lit("wiki").alias("chunk_type"),
        "content", F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), F.lit("markdown").alias("language"), F.sha2("content", 256).alias("content_hash"),
        F.lit(False).alias("is_definition"), F.array("page").alias("identifiers"), split_identifier(F.col("page")).alias("identifier_tokens"),
    )
