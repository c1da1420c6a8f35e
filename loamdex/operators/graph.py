"""Graph operators over typed edges.

Edges keep their types side by side: two nodes may be linked by several.
Traversals run a frontier per level; a level is a join and an anti join, and
what was visited is kept in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loamdex.session import Stages


def both_ways(edges: DataFrame, edge_types: list[str] | None = None) -> DataFrame:
    """``a, b``: every edge of the wanted types, in both directions, without null ends."""
    e = edges.where(F.col("edge_type").isin(*edge_types)) if edge_types else edges
    e = e.where("source_id is not null and target_id is not null")
    return e.select(F.explode(F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")))).alias("e")).select("e.*")


def impact_steps(edges: DataFrame) -> DataFrame:
    """``a, b``: a change of a reaches its callers and what it defines."""
    calls = edges.where("edge_type = 'CALLS'").select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    return calls.unionByName(edges.where("edge_type = 'DEFINES'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))).where("a is not null and b is not null")


def reach(seeds: DataFrame, steps: DataFrame, depth: int | None = None, keep_seeds: bool = True) -> DataFrame:
    """``node_id, level``: nodes in reach of the seeds (column ``node_id``), each at its least level.

    Seeds have level 0 and are returned even if no edge knows them. With
    ``keep_seeds=False`` a seed is a result only if the steps lead back to it.
    ``depth`` None goes on until nothing is new.
    """
    st = Stages(seeds.sparkSession, "reach")
    steps = st.save(steps.distinct())  # read at every level
    front = st.save(seeds.where("node_id is not null").select("node_id").distinct().withColumn("level", F.lit(0)))
    found, level = [front] if keep_seeds else [], 0
    while depth is None or level < depth:
        level += 1
        new = steps.join(front, F.col("a") == F.col("node_id"), "left_semi").select(F.col("b").alias("node_id")).distinct()
        if found:
            new = new.join(st.together(found), "node_id", "left_anti")
        front = st.save(new.withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        found.append(front)
    return st.together(found) if found else front


def reach_each(seeds: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    """``origin, node_id, level``: ``reach`` of every seed (column ``origin``) by itself."""
    st = Stages(seeds.sparkSession, "reach")
    front = st.save(seeds.where("origin is not null").distinct().select("origin", F.col("origin").alias("node_id"), F.lit(0).alias("level")))
    found = [front]
    for level in range(1, depth + 1):
        new = steps.join(front, F.col("a") == F.col("node_id")).select("origin", F.col("b").alias("node_id")).where("node_id is not null").distinct()
        front = st.save(new.join(st.together(found), ["origin", "node_id"], "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        found.append(front)
    return st.together(found)


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 1, edge_types: list[str] | None = None) -> DataFrame:
    """Nodes within ``depth`` undirected hops, seeds included."""
    return reach(seeds, both_ways(edges, edge_types), depth)


def impact(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node_id, level, is_direct``: everything a change of the seeds reaches. Loops end; a seed appears if it reaches itself."""
    return reach(seeds, impact_steps(edges), keep_seeds=False).withColumn("is_direct", F.col("level") == 1)


def callers_callees(edges: DataFrame) -> DataFrame:
    """``node_id, n_callers, n_callees`` over distinct CALLS edges."""
    calls = edges.where("edge_type = 'CALLS'").select("source_id", "target_id").distinct()
    ends = calls.select(F.explode(F.array(F.struct(F.col("target_id").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    return ends.groupBy("x.node_id").agg(F.sum("x.i").alias("n_callers"), F.sum("x.o").alias("n_callees"))


def callers(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where((F.col("edge_type") == "CALLS") & (F.col("target_id") == node_id)).select(F.col("source_id").alias("node_id")).distinct()


def callees(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where((F.col("edge_type") == "CALLS") & (F.col("source_id") == node_id)).select(F.col("target_id").alias("node_id")).distinct()


def trace_flow(edges: DataFrame, entry: DataFrame, max_depth: int = 10) -> DataFrame:
    """``node_id, depth, path``: the call flow from the entry in the order of ``path``, each node once.

    A node stands at its least depth, below the smallest path that reaches it
    there. (A walk that goes deep first can use a node up at a deeper place; that
    order cannot be had level by level and is given up for one that can.)
    """
    st = Stages(edges.sparkSession, "flow")
    calls = edges.where("edge_type = 'CALLS'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct()
    front = st.save(entry.select("node_id", F.lit(0).alias("depth"), F.col("node_id").alias("path")))
    found = [front]
    for level in range(1, max_depth + 1):
        new = calls.join(front, F.col("a") == F.col("node_id")).select(F.col("b").alias("node_id"), F.concat("path", F.lit(" > "), "b").alias("path"))
        new = new.groupBy("node_id").agg(F.min("path").alias("path")).join(st.together(found), "node_id", "left_anti")
        front = st.save(new.select("node_id", F.lit(level).alias("depth"), "path"))
        if front.isEmpty():
            break
        found.append(front)
    return st.together(found)


def resolve(nodes: DataFrame, part: str, limit: int = 10) -> DataFrame:
    """Nodes whose id holds ``part``: symbols first, then by-name ids, the shortest first."""
    n = F.col("node_id")
    order = [F.startswith(n, F.lit(p)) for p in ("call:", "module:", "symbol:")]
    return nodes.where(F.contains(n, F.lit(part))).select("node_id").distinct().orderBy(*order, F.length(n), n).limit(limit)


def module_of(c: Column) -> Column:
    return F.replace(F.replace(F.substring_index(c, ":", 1), F.lit("/"), F.lit("_")), F.lit("."), F.lit("_"))


def module_dependencies(edges: DataFrame) -> DataFrame:
    """``src, tgt``: which modules import or call which, by what stands before the first colon."""
    e = edges.where("edge_type in ('IMPORTS', 'CALLS')").select(module_of(F.col("source_id")).alias("src"), module_of(F.col("target_id")).alias("tgt"))
    return e.where((F.length("src").between(1, 39)) & (F.length("tgt").between(1, 39)) & (F.col("src") != F.col("tgt"))).distinct()


def node_card(c: Column) -> Column:
    """``name, kind, file_path`` of a node as its id tells them."""
    bare = F.regexp_replace(c, r"^(call|module|symbol|file):", "")
    kind = F.when(F.startswith(c, F.lit("call:")), "call").when(F.startswith(c, F.lit("module:")), "module").when(F.startswith(c, F.lit("symbol:")), "symbol").when(F.startswith(c, F.lit("file:")), "file").otherwise("definition")
    return F.struct(F.substring_index(bare, ":", -1).alias("name"), kind.alias("kind"), F.when(kind.isin("file", "definition"), F.substring_index(bare, ":", 1)).alias("file_path"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """``line``: the edges in DOT notation; quotes are escaped. Frame them with ``digraph G {`` and ``}``."""
    q = lambda c: F.replace(c, F.lit('"'), F.lit('\\"'))
    return edges.select("source_id", "target_id", "edge_type").distinct().select(
        F.format_string('  "%s" -> "%s" [label="%s"];', q(F.col("source_id")), q(F.col("target_id")), q(F.coalesce("edge_type", F.lit("")))).alias("line")
    )


def graphml_lines(edges: DataFrame) -> DataFrame:
    """``line``: the edges as GraphML elements."""
    x = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return edges.select("source_id", "target_id", "edge_type").distinct().select(
        F.format_string('<edge source="%s" target="%s"><data key="type">%s</data></edge>', x(F.col("source_id")), x(F.col("target_id")), x(F.coalesce("edge_type", F.lit("")))).alias("line")
    )


def _ends(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node: the symbols and what edges name beyond them."""
    named = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id"))
    return symbols.select("node_id").unionByName(named).where("node_id is not null").distinct()


def dot_document(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, line``: a whole DOT file, in the order of the parts."""
    q = F.replace("node_id", F.lit('"'), F.lit('\\"'))
    part = lambda n, df: df.select(F.lit(n).alias("part"), "line")
    one = lambda line: symbols.sparkSession.range(1).select(F.lit(line).alias("line"))
    nodes = _ends(symbols, edges).select(F.format_string('  "%s";', q).alias("line"))
    whole = part(0, one("digraph G {")).unionByName(part(1, one("  rankdir=LR;")))
    return whole.unionByName(part(2, nodes)).unionByName(part(3, dot_lines(edges).where("line is not null"))).unionByName(part(4, one("}")))


def graphml_document(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, line``: a whole GraphML file, in the order of the parts."""
    x = F.replace(F.replace(F.replace(F.replace("node_id", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    part = lambda n, df: df.select(F.lit(n).alias("part"), "line")
    one = lambda line: symbols.sparkSession.range(1).select(F.lit(line).alias("line"))
    head = [
        '<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="type" for="edge" attr.name="type" attr.type="string"/>', '<graph edgedefault="directed">',
    ]
    out = part(0, one(head[0]))
    for i, line in enumerate(head[1:], 1):
        out = out.unionByName(part(i, one(line)))
    nodes = _ends(symbols, edges).select(F.format_string('<node id="%s"/>', x).alias("line"))
    links = graphml_lines(edges.where("source_id is not null and target_id is not null"))
    return out.unionByName(part(4, nodes)).unionByName(part(5, links)).unionByName(part(6, one("</graph>"))).unionByName(part(7, one("</graphml>")))


def export_graph(symbols: DataFrame, edges: DataFrame, path: str, form: str = "json") -> None:
    """Write the graph below ``path``: JSON lines of nodes and links, or DOT or GraphML text whose files, one after the other by name, are the document."""
    form = {"xml": "graphml", "gv": "dot"}.get(form.lower().strip(), form.lower().strip())
    if form == "json":
        symbols.select("node_id", "kind", "name", "file_path").distinct().write.mode("overwrite").json(f"{path}/nodes")
        edges.select("source_id", "target_id", "edge_type").distinct().write.mode("overwrite").json(f"{path}/links")
    elif form in ("dot", "graphml"):
        whole = (dot_document if form == "dot" else graphml_document)(symbols, edges)
        whole.repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format: {form}")


def symbol_order() -> list[Column]:
    """Order in which equally named symbols are tried."""
    return [F.col("file_path"), F.col("start_line"), F.col("node_id")]


def link(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``source_id, original, edge_type, target_id, rule``: by-name CALLS and INHERITS targets that resolve to a symbol.

    Rules, the first that hits counts: 2 a symbol of that name in the caller's
    file (the last one); 3 a name or alias that the file imports, preferring a
    file of the imported module; 4 the last part of a dotted name, if one symbol
    has it; 5 the whole name, if one symbol has it. Bases know rules 2 and 5
    only. A caller that is no symbol has no file and knows rules 4 and 5. A hit
    on the caller itself resolves nothing.
    """
    sym = symbols.where("node_id is not null and name is not null").groupBy("node_id").agg(F.min(F.struct("file_path", "start_line", "name")).alias("s")).select("node_id", "s.*")
    st = Stages(symbols.sparkSession, "link")
    sym = st.save(sym)
    raw = edges.where("source_id is not null and ((edge_type = 'CALLS' and target_id like 'call:%') or (edge_type = 'INHERITS' and target_id like 'symbol:%'))")
    raw = raw.select("source_id", F.col("target_id").alias("original"), "edge_type").distinct()
    raw = raw.withColumn("want", F.regexp_replace("original", r"^(call|symbol):", ""))
    file_of = sym.select(F.col("node_id").alias("source_id"), F.col("file_path").alias("file"))
    raw = st.save(raw.join(file_of, "source_id", "left"))
    # The name is asked for once per file and not once per edge: hot names shrink before the joins.
    ask = st.save(raw.select("file", "want", (F.col("edge_type") == "CALLS").alias("is_call")).distinct())
    in_file = sym.groupBy(F.col("file_path").alias("file"), F.col("name").alias("want")).agg(F.max(F.struct("start_line", "node_id")).alias("m"))
    r2 = ask.join(in_file, ["file", "want"]).select("file", "want", "is_call", F.lit(2).alias("rule"), F.col("m.node_id").alias("hit"))
    unique = sym.groupBy("name").agg(F.count("*").alias("n"), F.min("node_id").alias("hit")).where("n = 1").drop("n")
    dotted = ask.where(F.col("is_call") & F.col("want").contains(".")).withColumn("name", F.substring_index("want", ".", -1))
    r4 = dotted.join(unique, "name").select("file", "want", "is_call", F.lit(4).alias("rule"), "hit")
    r5 = ask.join(unique, F.col("want") == F.col("name")).select("file", "want", "is_call", F.lit(5).alias("rule"), "hit")
    imports = edges.where("edge_type = 'IMPORTS' and source_id like 'file:%'").select(
        F.regexp_replace("source_id", "^file:", "").alias("file"), F.col("metadata")["module"].alias("module"), F.col("metadata")["name"].alias("import_name"),
        F.col("metadata")["alias"].alias("import_alias"), F.coalesce(F.try_to_number(F.col("metadata")["line"], F.lit("9999999")), F.lit(0)).cast("int").alias("seq"),
    ).distinct()
    plain = ask.where("is_call").join(imports.where("import_name is not null"), "file").where("want = import_name or want = import_alias")
    named = sym.select(F.col("name").alias("import_name"), "node_id", "file_path", "start_line")
    dotted_path = F.replace(F.col("file_path"), F.lit("/"), F.lit("."))
    # The best symbol is looked for once per name and module and not once per file that imports it.
    inside = F.contains(dotted_path, F.coalesce("module", F.lit("")))
    best = plain.select("import_name", "module").distinct().join(named, "import_name").groupBy("import_name", "module").agg(F.min(F.struct((~inside).alias("out"), "file_path", "start_line", "node_id")).alias("b"))
    asked = plain.select("file", "want", "is_call", "seq", F.col("module").alias("m"), F.col("import_name").alias("i"))
    r3 = asked.join(best, (F.col("i") == F.col("import_name")) & F.col("m").eqNullSafe(F.col("module")))
    r3 = r3.groupBy("file", "want", "is_call").agg(F.min(F.struct("seq", "m", "i", "b")).alias("x"))
    r3 = r3.select("file", "want", "is_call", F.lit(3).alias("rule"), F.col("x.b.node_id").alias("hit"))
    far = dotted.withColumn("mod", F.expr("substring(want, 1, length(want) - length(name) - 1)")).join(imports, "file")
    far = far.where("import_alias = mod or import_name = mod or endswith(module, mod)").select("file", "want", "is_call", F.col("name").alias("i"), F.col("mod").alias("m")).distinct()
    best = far.select(F.col("i").alias("import_name"), F.col("m").alias("mod")).distinct().join(named, "import_name").where(F.contains(dotted_path, F.col("mod")))
    best = best.groupBy("import_name", "mod").agg(F.min(F.struct("file_path", "start_line", "node_id")).alias("b"))
    r3b = far.join(best, (F.col("i") == F.col("import_name")) & (F.col("m") == F.col("mod")))
    r3b = r3b.select("file", "want", "is_call", F.lit(3).alias("rule"), F.col("b.node_id").alias("hit"))
    hits = r2.unionByName(r3).unionByName(r3b).unionByName(r4).unionByName(r5).groupBy("file", "want", "is_call").agg(F.min(F.struct("rule", "hit")).alias("h"))
    got = raw.withColumn("is_call", F.col("edge_type") == "CALLS").join(
        hits.select(F.col("file").alias("f2"), F.col("want").alias("w2"), F.col("is_call").alias("c2"), "h.*"),
        F.col("file").eqNullSafe(F.col("f2")) & (F.col("want") == F.col("w2")) & (F.col("is_call") == F.col("c2")),
    )
    return got.where("hit <> source_id").select("source_id", "original", "edge_type", F.col("hit").alias("target_id"), "rule")


def linked_edges(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Edges with the resolved targets in place; metadata keeps the original target."""
    l = links.select("source_id", F.col("original").alias("target_id"), "edge_type", F.col("target_id").alias("hit"))
    e = edges.join(l, ["source_id", "target_id", "edge_type"], "left")
    note = F.map_from_arrays(F.array(F.lit("original_target"), F.lit("resolved")), F.array(F.col("target_id"), F.lit("true")))
    kept = F.map_filter(F.coalesce("metadata", F.expr("cast(map() as map<string,string>)")), lambda k, v: ~k.isin("original_target", "resolved"))
    return e.select("source_id", F.coalesce("hit", "target_id").alias("target_id"), "edge_type", F.when(F.col("hit").isNotNull(), F.map_concat(kept, note)).otherwise(F.col("metadata")).alias("metadata"))
