import random

from loamdex.operators.hierarchy import descendants, hierarchy

SCHEMA = "node_id string, parent_id string, root_id string, depth int"


def brute(parent):
    out = {}
    for n in parent:
        seen, x = [], n
        while True:
            seen.append(x)
            p = parent[x]
            if p is None or not p.strip() or p not in parent:
                out[n] = (x, len(seen) - 1, seen[::-1])
                break
            if p in seen:
                out[n] = (min(seen[seen.index(p) :]), -1, seen[: seen.index(p)][::-1])
                break
            x = p
    return out


def made(n, seed):
    r = random.Random(seed)
    parent = {}
    for i in range(n):
        kind = r.random()
        parent[f"n{i}"] = None if kind < 0.05 else " " if kind < 0.07 else "gone" if kind < 0.09 else f"n{i - 1}" if kind < 0.6 and i else f"n{r.randrange(n)}" if kind < 0.63 else f"n{r.randrange(i)}" if i else None
    return parent


def test_against_walking_up(spark):
    parent = made(300, 7)
    rows = [(a, b, "clash", 5) for a, b in parent.items()]
    df = spark.createDataFrame(rows + rows[:20] + [(None, "n1", "x", 1)], SCHEMA)
    got = {r["id"]: r for r in hierarchy(df).collect()}
    want = brute(parent)
    assert set(got) == set(want)
    for n, (root, depth, path) in want.items():
        assert (got[n]["root_id"], got[n]["depth"], got[n]["path"]) == (root, depth, path)
    below = {n: 0 for n in want}
    for _, d, path in want.values():
        for a in path[:-1]:
            below[a] += 1
    assert all(got[n]["n_descendants"] == (below[n] if want[n][2] else None) for n in want)
    links = {(r["ancestor_id"], r["node_id"], r["distance"]) for r in descendants(hierarchy(df)).collect()}
    assert links == {(a, n, len(path) - 1 - i) for n, (_, _, path) in want.items() for i, a in enumerate(path[:-1])}


def test_deep_chain_loops_and_descendants(spark):
    parent = {f"c{i:03}": f"c{i - 1:03}" if i else None for i in range(60)} | {"a": "b", "b": "a", "s": "s", "t": "s"}
    tree = hierarchy(spark.createDataFrame(list(parent.items()), "node_id string, parent_id string"))
    got = {r["id"]: (r["root_id"], r["depth"]) for r in tree.collect()}
    assert got["c059"] == ("c000", 59) and got["a"] == got["b"] == ("a", -1) and got["s"] == got["t"] == ("s", -1)
    pairs = descendants(tree).where("node_id = 'c059'").collect()
    assert len(pairs) == 59 and {(r["ancestor_id"], r["distance"]) for r in pairs} >= {("c000", 59), ("c058", 1)}


def test_below_a_loop_and_rows_that_disagree(spark):
    rows = [("a", "b"), ("b", "a"), ("c", "a"), ("d", "c"), ("e", "d"), ("x", "gone"), ("x", "root"), ("x", "zoo"), ("root", None), ("zoo", " "), ("y", None), ("y", "x")]
    tree = hierarchy(spark.createDataFrame(rows, "node_id string, parent_id string"))
    got = {r["id"]: (r["root_id"], r["depth"], r["path"], r["n_descendants"]) for r in tree.collect()}
    assert got["c"] == ("a", -1, ["c"], 2) and got["e"] == ("a", -1, ["c", "d", "e"], 0) and got["a"] == ("a", -1, [], None)
    assert got["x"] == ("root", 1, ["root", "x"], 1) and got["y"] == ("root", 2, ["root", "x", "y"], 0)
    assert {(r["ancestor_id"], r["node_id"]) for r in descendants(tree).collect()} == {("c", "d"), ("c", "e"), ("d", "e"), ("root", "x"), ("root", "y"), ("x", "y")}


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], "node_id string, parent_id string")).count() == 0
