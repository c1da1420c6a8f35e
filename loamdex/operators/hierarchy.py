"""Parent-child rows to full hierarchies, by tree contraction.

Each round rakes all leaves into their parents and splices an independent set
out of every unary chain, so a chain of any depth shrinks geometrically and a
bushy tree disappears in a few rounds. What a round removed is written down;
walking the rounds backwards gives every removed node its root, depth, path
and number of descendants from the one node it was folded into. A loop never
loses its last node: it shrinks to a node that is its own parent, which is how
loops are found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from loamdex.session import Stages

_ARR = "array<string>"


def parent_links(rows: DataFrame, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """One row ``(id, parent)`` per node; parent is null for roots.

    Null node ids are no nodes. A parent that is null, blank or the id of no
    node makes a root. If repeated rows of a node disagree, the smallest parent
    that is a node counts.
    """
    p = F.col(parent)
    pairs = rows.where(F.col(node).isNotNull()).select(F.col(node).alias("id"), F.when(F.trim(p) != "", p).alias("want")).distinct()
    ids = pairs.select("id").distinct()
    usable = pairs.join(ids.withColumnRenamed("id", "want"), "want", "left_semi").groupBy("id").agg(F.min("want").alias("parent"))
    return ids.join(usable, "id", "left").select("id", "parent")


def hierarchy(rows: DataFrame, node: str = "node_id", parent: str = "parent_id", paths: bool = True) -> DataFrame:
    """``id, parent, root_id, depth, path, n_descendants`` of every node.

    * Roots have depth 0 and the path ``[id]``; a path runs from the root to the node.
    * A node whose parents never end has depth -1 and, as root, the smallest id (by bytes) of the
      loop it runs into. In the loop it has an empty path and null n_descendants, as everything
      below the loop is below each of its members without end. Below the loop its path begins with
      the first node that is not in the loop, and its descendants are counted as usual.
    * ``paths=False`` leaves the path null and saves carrying it.
    * Repeated rows count once, an empty table gives no rows, other columns are ignored.
    """
    st = Stages(rows.sparkSession, "hierarchy")
    links = st.save(parent_links(rows, node, parent))
    kids = links.where("parent is not null and parent <> id").groupBy(F.col("parent").alias("pid")).agg(F.count("*").alias("kids"))
    alive = links.join(kids, F.col("id") == F.col("pid"), "left").select(
        "id", "parent", F.lit(1).alias("w"), F.lit(1).cast("long").alias("acc"), F.lit(0).cast("long").alias("em"),
        F.lit(None).cast("string").alias("lm"), F.array().cast(_ARR).alias("el"), F.coalesce("kids", F.lit(0)).alias("kids"),
    )
    rounds: list[DataFrame] = []
    while True:
        left = Observation()  # counted while the round is written
        t = st.save(_contract(alive, len(rounds), paths).observe(left, F.count(F.when(F.col("state") == "A", 1)).alias("n")))
        rounds.append(t)
        alive = t.where("state = 'A'").select("id", "parent", "w", "acc", "em", "lm", "el", "kids")
        if not left.get["n"]:
            break
    parts = _expand(rounds, st, paths)
    done = st.together(parts)
    below = ~F.col("bad") | (F.col("depth") > 0)
    out = links.join(done, "id").select(
        "id", "parent", "root_id", F.when(F.col("bad"), -1).otherwise(F.col("depth")).alias("depth"), "path", F.when(below, F.col("size") - 1).alias("n_descendants")
    )
    out = st.save(out)
    for t in [links, *rounds, *parts]:
        st.drop(t)
    return out


def _contract(a: DataFrame, no: int, paths: bool) -> DataFrame:
    """One round. state: R raked, F final (a root or a loop of one), A alive.

    Columns of an edge (node to its present parent): w its length, em the mass
    and el the ids of the nodes spliced out of it, lm the smallest of those ids.
    acc is the mass of the node with all that was raked into it, kids the number
    of its present children other than itself. An alive row whose parent was
    spliced in this round carries that parent in ``v``. A node that a leaf was
    just raked into is not spliced in the same round, so every removed row
    refers to one that outlives the round. What is left of the children of a
    node is not raked, and a spliced child gives way to its own, so kids needs
    no count of its own after the first.
    """
    up = (F.col("parent").isNotNull()) & (F.col("parent") != F.col("id"))
    f = a.withColumn("state", F.when(F.col("kids") > 0, "A").when(up, "R").otherwise("F"))
    leaf = F.col("state") == "R"
    sums = (
        f.where(up)
        .groupBy(F.col("parent").alias("pid"))
        .agg(
            F.sum(F.when(leaf, F.col("acc") + F.col("em"))).alias("add"),
            F.count(F.when(leaf, 1)).alias("raked"),
            F.max(F.when(~leaf, F.col("id"))).alias("only"),
        )
    )
    g = f.where("state = 'A'").join(sums, F.col("id") == F.col("pid"), "left").withColumn(
        "acc", F.col("acc") + F.coalesce("add", F.lit(0))
    )
    h = lambda c: F.xxhash64(F.col(c), F.lit(no))
    unary = (F.col("kids") == 1) & (F.col("raked") == 0)
    g = g.withColumn("cut", F.coalesce(up & unary & (h("id") < h("parent")) & (h("id") < h("only")), F.lit(False))).withColumn("kids", F.col("kids") - F.coalesce("raked", F.lit(0)))
    v = g.where("cut").select(
        F.struct("id", "parent", F.col("w"), "acc", "em", "lm", "el").alias("v"), F.col("id").alias("vid")
    )
    kept = g.where("not cut").join(v, F.col("parent") == F.col("vid"), "left")
    hit = F.col("vid").isNotNull()
    mid = F.concat(F.col("v.el"), F.array("vid"), F.col("el")) if paths else F.col("el")
    kept = kept.select(
        "id",
        F.when(hit, F.col("v.parent")).otherwise(F.col("parent")).alias("parent"),
        F.when(hit, F.col("w") + F.col("v.w")).otherwise(F.col("w")).alias("w"),
        "acc",
        F.when(hit, F.col("em") + F.col("v.em") + F.col("v.acc")).otherwise(F.col("em")).alias("em"),
        F.least("lm", "v.lm", "vid").alias("lm"),
        F.when(hit, mid).otherwise(F.col("el")).alias("el"),
        # A loop that has shrunk to one node is that node's only child.
        F.when(hit & (F.col("v.parent") == F.col("id")), F.col("kids") - 1).otherwise(F.col("kids")).alias("kids"),
        "state",
        F.when(hit, F.struct(
            F.col("vid").alias("id"), F.col("w").alias("below"), (F.col("v.acc") + F.col("em")).alias("mass"),
        )).alias("v"),
    )
    out = f.where("state <> 'A'").select("id", "parent", "w", "acc", "em", "lm", "el", "kids", "state", F.lit(None).cast(kept.schema["v"].dataType).alias("v"))
    return kept.unionByName(out)


def _expand(rounds: list[DataFrame], st: Stages, paths: bool) -> list[DataFrame]:
    """Undo the contractions, last round first: saved tables ``id, root_id, depth, bad, path, size``.

    A raked row hangs below the row it refers to, a spliced one sits above it. What runs into a
    loop is ``bad``; its depth is that below the loop, 0 for the loop's members, and its path
    leaves the loop out.
    """
    null_path = F.lit(None).cast(_ARR)
    loop, bad = F.col("parent").isNotNull(), F.col("bad")
    final = st.together(rounds).where("state = 'F'").select(
        "id",
        F.when(loop, F.least("id", "lm")).otherwise(F.col("id")).alias("root_id"),
        F.lit(0).alias("depth"),
        loop.alias("bad"),
        (F.when(loop, F.array().cast(_ARR)).otherwise(F.array("id")) if paths else null_path).alias("path"),
        F.when(~loop, F.col("acc")).alias("size"),
    )
    parts = [st.save(final)]
    for no in reversed(range(len(rounds))):
        t, done = rounds[no], st.together(parts)
        raked = F.col("state") == "R"
        gone = t.where(raked | F.col("v").isNotNull()).select(
            F.when(raked, F.col("id")).otherwise(F.col("v.id")).alias("rid"),
            F.when(raked, F.col("parent")).otherwise(F.col("id")).alias("ref"),
            raked.alias("raked"),
            F.when(raked, F.col("w")).otherwise(-F.col("v.below")).alias("step"),
            F.when(raked, F.col("acc")).otherwise(F.col("v.mass")).alias("mass"),
            F.col("el").alias("rel"),
        )
        depth = F.greatest(F.col("depth") + F.col("step"), F.lit(0))  # above a node below a loop come the loop's members
        long = depth + F.when(bad, 0).otherwise(1)
        path = F.when(F.col("raked"), F.concat("path", "rel", F.array("rid"))).otherwise(F.slice("path", F.lit(1), long))
        size = F.when(F.col("raked"), F.col("mass")).when(~bad | (depth > 0), F.col("mass") + F.col("size"))
        back = gone.join(done, gone["ref"] == done["id"]).select(
            F.col("rid").alias("id"), "root_id", depth.alias("depth"), "bad", (path if paths else null_path).alias("path"), size.alias("size")
        )
        parts.append(st.save(back))
    return parts


def descendants(tree: DataFrame) -> DataFrame:
    """``ancestor_id, node_id, distance`` for every node and each node above it.

    One row per link of the closure and no list per ancestor, so a root that
    holds a third of all rows is never gathered. The members of a loop are below
    each other without end and give no rows; nodes below a loop have those above
    them that are not in it.
    """
    own = F.size("path") - 1
    return (
        tree.where(own > 0)
        .select(F.col("id").alias("node_id"), own.alias("own"), F.posexplode("path").alias("pos", "ancestor_id"))
        .where("pos < own")
        .select("ancestor_id", "node_id", (F.col("own") - F.col("pos")).alias("distance"))
    )
