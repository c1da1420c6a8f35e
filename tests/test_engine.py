import os

from pyspark.sql import functions as F

from loamdex.plans.engine import Engine
from loamdex.sources import history as H, parse as P
from loamdex.sources.coderepo import CodeRepo, ignored, path_ignored

AUTH = '''import os
from app.util import helper as h


@guard
class Auth(Base):
    """Checks tokens."""

    @staticmethod
    def check(token):
        """Say whether the token holds."""
        return h(token)


def main():
    Auth.check("x")
    return main
'''
UTIL = "def helper(x):\n    return x\n"


def repo(tmp_path):
    root = tmp_path / "shop"
    for path, text in {"app/auth.py": AUTH, "app/util.py": UTIL, "app/__init__.py": "", "web/view.ts": "import { A } from './a';\nexport class View {\n}\nexport const run = async (x) => {\n};\n", ".venv/x.py": "x", "app/notes.txt": "no"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    outside = tmp_path / "secret.py"
    outside.write_text("x = 1")
    os.symlink(outside, root / "app/leak.py")
    os.symlink(root / "app/util.py", root / "app/again.py")
    return root


def test_scan(spark, tmp_path):
    spark.dataSource.register(CodeRepo)
    root = repo(tmp_path)
    got = spark.read.format("coderepo").option("path", str(root)).load().collect()
    assert sorted(r["file_path"].replace(str(root) + "/", "") for r in got) == ["app/__init__.py", "app/again.py", "app/auth.py", "app/util.py", "web/view.ts"]
    assert ignored(".git") and ignored("dist") and ignored("a.pyc") and not ignored("__tests__")


def test_parse_python():
    rows = P.parse_python("app/auth.py", AUTH)
    sym = {r["node_id"]: r for r in rows if r["tag"] == "symbol"}
    assert {k: (r["kind"], r["parent_id"], r["start_line"]) for k, r in sym.items()} == {
        "file:app/auth.py": ("module", None, 1), "app/auth.py:Auth": ("class", "file:app/auth.py", 5), "app/auth.py:Auth.check": ("method", "app/auth.py:Auth", 9), "app/auth.py:main": ("function", "file:app/auth.py", 15),
    }
    edges = {(r["source_id"], r["target_id"], r["edge_type"]) for r in rows if r["tag"] == "edge"}
    assert {("app/auth.py:Auth", "symbol:Base", "INHERITS"), ("app/auth.py:Auth.check", "call:h", "CALLS"), ("file:app/auth.py", "module:os", "IMPORTS"), ("file:app/auth.py", "symbol:app.util.helper", "IMPORTS")} <= edges
    assert sum(r["tag"] == "chunk" for r in rows) == len(sym)
    broken = P.parse_python("b.py", "def f(:\n  pass\nclass C\n")
    assert [r["node_id"] for r in broken] == ["b.py:f", "b.py:C", None]
    assert (broken[-1]["name"], broken[-1]["chunk_type"], broken[-1]["identifiers"]) == ("b.py:1-3", "code", ["f", "C"])


def test_parse_calls_tests_and_identifiers():
    code = 'class T:\n    def test_join(self):\n        a.b(c(1))[0](2)\n        x.y.z()\n        a.b()\n'
    rows = P.parse_python("pkg/Test_a.py", code)
    edges = {(r["target_id"], r["edge_type"]) for r in rows if r["tag"] == "edge"}
    assert {("symbol:join", "TESTED_BY"), ("call:a.b", "CALLS"), ("call:c", "CALLS"), ("call:x.y.z", "CALLS"), ("call:a.b(c(1))[0]", "CALLS")} <= edges
    chunks = {r["node_id"]: r for r in rows if r["tag"] == "chunk"}
    assert chunks["pkg/Test_a.py:T.test_join"]["identifiers"] == ["test_join", "T"] and {c["chunk_type"] for c in chunks.values()} == {"test"}
    assert [r["identifiers"] for r in P.parse_generic("src/a.go", "package a\n", "go") if r["tag"] == "chunk"] == [["a"]]


def test_only_changed_files_are_opened(spark, tmp_path, monkeypatch):
    root, engine = tmp_path / "two", Engine(spark, str(tmp_path / "index"))
    root.mkdir()
    (root / "a.py").write_text("def a():\n    return 1\n")
    (root / "b.py").write_text("def b():\n    return 1\n")
    opened = []
    for edit, want in ((None, 2), (None, 0), ("def a():\n    return 22\n", 1)):
        if edit:
            (root / "a.py").write_text(edit)
        opened.append(engine.changes(str(root))[1].count())
        assert engine.index(str(root)) == want
    assert opened == [2, 0, 1]


def test_ignored_paths(spark):
    rows = spark.createDataFrame([("a/b.py",), ("a/.git/x",), ("node_modules/x.js",), ("a/b.pyc",), ("/dist/x",), ("builds/x",)], "p string")
    assert [r[0] for r in rows.select(path_ignored(F.col("p"))).collect()] == [False, True, True, True, True, False]


def test_file_changes(spark):
    log = "commit abcdef0123\nAuthor: ann\n\n    first\n\n3\t1\tsrc/a.py\n-\t-\timg.png\n\ncommit 0123abcdef\n\n    second\n\n src/a.py | 4 ++--\n 1 file changed\n"
    got = H.file_changes(spark.createDataFrame([(log,), (None,)], "content string"))
    assert sorted(tuple(r) for r in got.where("added is not null").collect()) == [("abcdef0123", "src/a.py", 3, 1)]
    assert {r["file_path"]: r["n_commits"] for r in H.churn(got, "file_path", "commit_id").collect()} == {"src/a.py": 2, "img.png": 1}
    one = spark.createDataFrame([("a",), (None,)], "file_path string")
    assert [r[0] for r in H.changed_files(one, one, spark.createDataFrame([("u",)], "file_path string")).orderBy("file_path").collect()] == ["a", "u"]


def test_parse_generic():
    ts = P.parse_generic("a.ts", "import { X } from 'express';\nimport './side';\n\nexport class A {\n}\nexport function f() {\n}\nexport const g = async (x) => {};\n", "typescript")
    assert [r["name"] for r in ts if r["tag"] == "symbol"] == ["a", "A", "f", "g"]
    assert [r["target_id"] for r in ts if r.get("edge_type") == "IMPORTS"] == ["module:express", "module:./side"]


def test_index_search_incremental_wiki(spark, tmp_path):
    root, engine = repo(tmp_path), Engine(spark, str(tmp_path / "index"))
    assert engine.index(str(root)) == 5
    assert engine.index(str(root)) == 0
    top = engine.search("check token", limit=1, expand=True).first()
    assert top["symbol_id"].endswith("auth.py:Auth.check")
    links = {(r["source_id"].rsplit(":", 1)[1], r["target_id"].rsplit(":", 1)[1]) for r in engine.edges().where("edge_type = 'CALLS'").collect()}
    assert ("main", "Auth.check") in links
    assert any("main" in r["node_id"] for r in engine.impact("Auth.check").collect())
    assert engine.graph("Auth.check").count() >= 2
    pages = engine.wiki()
    assert pages.where("content like '%Checks tokens%' and file_path is not null").count() == 1
    assert {r["page"] for r in pages.where("file_path is null").collect()} == {"index", "architecture", "workflows"}
    assert pages.where("file_path like '%__init__.py'").count() == 1  # a file without definitions has a page too
    plan = engine.search("check token", expand=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "IMPORTS" not in plan  # links were made with the snapshot
    assert engine.metadata() == {"embedding_model": "hashed-trigrams", "embedding_dim": "64", "stemmed": "true"}
    assert engine.search("checking tokenés", limit=1, mode="lexical").first()["symbol_id"].endswith("auth.py:Auth.check")
    shown = engine.answer("check token", 2).first()
    assert shown["score"] == round(shown["score"], 4) and len(shown["neighbours"]) <= 3
    assert engine.affected("Auth.check") == engine.impact("Auth.check").count() > 0
    (root / "app/util.py").write_text(UTIL + "\n\ndef fresh():\n    return 2\n")
    os.remove(root / "web/view.ts")
    assert engine.index(str(root)) == 2  # util.py and the link to it
    assert engine.table("symbols").where("name in ('View', 'fresh')").select("name").distinct().collect()[0][0] == "fresh"
    engine.write_wiki(str(tmp_path / "wiki"))
    assert engine.table("chunks").where("chunk_type = 'wiki'").count() > 3 and (tmp_path / "wiki/page=index").exists()
    assert engine.search("Workflows Modules", limit=1, mode="lexical").first()["chunk_type"] == "wiki"
    q = engine.watch(str(root), once=True)
    q.awaitTermination(60)
    assert q.exception() is None
    assert {r["table_name"] for r in engine.stats().collect()} == {"symbols", "edges", "chunks", "chunk_vectors", "file_manifest"}


def test_commits(spark):
    log = "commit abcdef0123\nAuthor: ann <a@b>\nDate:   2024-01-02 03:04:05\n\n    first\n    commit 99 is quoted\n\ncommit 0123abcdef\nAuthor: bob <a@b>\nDate: never\n\n    second\n"
    got = H.commits(spark.createDataFrame([(log,), (None,), ("",)], "content string")).orderBy("author").collect()
    assert [(r["commit_id"], r["author"], str(r["committed_at"]), r["message"].split("\n")[0]) for r in got] == [("abcdef0123", "ann", "2024-01-02 03:04:05", "first"), ("0123abcdef", "bob", "None", "second")]


def test_tasks(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text('[{"query": "a b c", "relevant": ["x.py", {"path": "y.py", "start_line": 3, "end_line": 9}]}, {"query": "f", "category": "symbol", "relevant": []}]')
    got = sorted((r["query"], r["category"], r["path"], r["start_line"]) for r in H.tasks(spark, str(p)).where("path is not null").collect())
    assert got == [("a b c", "semantic", "x.py", None), ("a b c", "semantic", "y.py", 3)]
