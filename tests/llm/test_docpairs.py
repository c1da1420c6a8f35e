import pytest

from loamdex.llm import docpairs as D

SCHEMA = "node_id string, file_path string, kind string, name string, signature string, docstring string, source_code string, start_line int, language string, comment string"

GO = """package a

// Keeps the oldest rows and drops what came late.
func Keep(x int) error {
}

// Detached words say a lot about nothing.

func Loose() error {
}
func Tight() error {
}

// Restated: restated.
func Restated() error {
}
/* Counts what is left
   over after the last pass. */
#[inline]
func Count() {
}
x := "// not a comment about rows"
func After() {
}
"""


def fn(path, name, line, code="x {\n}", lang="go", doc=None, sig=None, kind="function"):
    return (f"{path}:{name}", path, kind, name, sig, doc, code, line, lang, "clash")


def run(spark, rows):
    got = D.documented(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r["node_id"], r["start_line"]): r["documentation"] for r in got}


def test_comment_right_above(spark):
    at = {n: next(i for i, x in enumerate(GO.split("\n"), 1) if f"func {n}(" in x) for n in ("Keep", "Loose", "Tight", "Restated", "Count", "After")}
    rows = [("file:a.go", "a.go", "module", "a", None, None, GO, 1, "go", "x")] + [fn("a.go", n, line, f"func {n}() {{\n}}") for n, line in at.items()]
    got = run(spark, rows + rows)
    assert set(got) == {("a.go:Keep", at["Keep"]), ("a.go:Count", at["Count"])}
    assert got[("a.go:Count", at["Count"])] == "Counts what is left\n   over after the last pass."


def test_blocks_of_long_files(spark):
    body = "".join(f"// Explains reason number {i} at length.\nfunc F{i}() {{\n}}\n\n" for i in range(2500))
    rows = [("file:l.go", "l.go", "module", "l", None, None, body.replace("\n", "\r\n"), 1, "go", "x")] + [fn("l.go", f"F{i}", 4 * i + 2) for i in range(0, 2500, 7)]
    assert len(run(spark, rows)) == len(range(0, 2500, 7))


def test_python_docs(spark):
    code = 'def f(a):\n    """Drops rows that came late."""\n    return a\n'
    rows = [
        fn("a.py", "f", 1, code, "python", None, "def f(a):"), fn("a.py", "g", 5, code, "python", "nan", "def g(a):"), fn("a.py", "h", 9, "def h(a):\n    return a\n", "python", "TODO", "def h(a):"),
        fn("a.py", "i", 12, None, "python", "Says a good deal."), fn("a.py", "j", 13, "  ", "python", "Says a good deal."), fn("b.py", "k", 2, "def k(a):", None, None, None), fn("a.py", "f", 30, code, "python", None, None),
        ("file:b.py", "b.py", "module", "b", None, None, 'x = (\ndef k(a):\n    """Reads whatever is left."""\n', 1, "python", "x"), (None, "a.py", "function", "z", None, "Good words.", code, 1, "python", "x"),
    ]
    assert set(run(spark, rows)) == {("a.py:f", 1), ("a.py:g", 5), ("b.py:k", 2), ("a.py:f", 30)}
    assert D.documented(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("doc", [
    "TODO", "TODO: document", "FIXME: write documentation", "todo add docs", "_summary_", "[summary]", "Documentation pending", "Undocumented.", "TBD.", "-none-", "***", "n/a", "Auto-generated stub.", "Generated method stub",
    "See above.", "See base class.", "@see super", "{@inheritDoc}", "pragma: no cover", "noqa: D103", "type: ignore", "pylint: disable=too-many-locals", "eslint-disable-next-line", "nolint", "drain queue", "Drains the queue.",
    "This is the drain queue method.", "Docstring for drain_queue.", "Description of drain_queue", "drain_queue()", "@param item\n@return", ":param item:\n:type item: int\n:return:", "Args:\n    item:\n\nReturns:", "Drains the queue of the item.", "",
])
def test_says_nothing(doc):
    assert not D.says_something(doc, "drain_queue", "def drain_queue(item: int) -> bool:")


@pytest.mark.parametrize("doc", [
    "Drain queue, oldest rows first.", "TODO-free zone: the index is final.", "See the index first: it decides whether rows are stale.", "None of the rows survive.", ":param item: upper bound per poll", "@param item where rows get stored",
    "Args:\n    item: seconds to wait", "Возвращает пустой список.", "Counts bytes, not characters.", "Null rows are skipped.",
])
def test_says_something(doc):
    assert D.says_something(doc, "drain_queue", "def drain_queue(item: int) -> bool:")


@pytest.mark.parametrize("arguments,lines", [(0, 250), (230, 20), (0, 5000)])
def test_long_python_docs_of_files_that_do_not_parse(spark, arguments, lines):
    head = "def k(" + "".join(f"\n    a{i}," for i in range(arguments)) + "):"
    doc = "\n".join(f"    Reads whatever is left, part {i}." for i in range(lines))
    text = f'x = (\n{head}\n    """\n{doc}\n    """\n' + "y = 1\n" * 300
    rows = [("file:b.py", "b.py", "module", "b", None, None, text, 1, "python", "x"), fn("b.py", "k", 2, head.split("\n")[0], "python"), fn("b.py", "none", 400 + lines, "y = 1", "python")]
    got = run(spark, rows)
    assert set(got) == {("b.py:k", 2)} and got[("b.py:k", 2)].endswith(f"part {lines - 1}.")


PY = '''
@dec(1)
def f(a: dict[str, int] = {"x": 1},
      b=2) -> "int":
    # note
    r"""Doc
      of f."""
    return {"a": [1,
        2]}
class C:
    """doc c"""
    def m(self):
        def inner():
            'one' 'two'
        x = f"""not"""
def n(): "on the line"
def o():
    f"no {a}"
async def p(
    a,  # about a
):

    # a comment
    "last"
y = "def q():"
"""
def r():
    'no'
"""
'''


def test_strings_below_heads_as_the_parser_reads_them():
    import ast

    got = sorted((n, d) for _, d, n in D.python_spans(PY.replace("\n", "\r\n")) if d is not None and n)
    nodes = (x for x in ast.walk(ast.parse(PY)) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)))
    assert got == sorted((x.name, ast.get_docstring(x)) for x in nodes if ast.get_docstring(x))
    assert [p for p, *_ in D.python_spans(PY)] == sorted(p for p, *_ in D.python_spans(PY))
    assert list(D.python_spans("")) == [] and list(D.python_spans('def f():\n    """open')) [-1][1] is None


def test_a_statement_between_head_and_string_rejects(spark):
    text = 'def a():\n    x = 1\n    """Reads whatever is left."""\ndef b():\n    def c():\n        """Reads whatever is left."""\n'
    rows = [("file:b.py", "b.py", "module", "b", None, None, text, 1, "python", "x"), *(fn("b.py", n, line, f"def {n}():", "python") for n, line in (("a", 1), ("b", 4), ("c", 5)))]
    assert set(run(spark, rows)) == {("b.py:c", 5)}
    old = ("file:b.py", "b.py", "module", "b", None, None, "# other version\n" * 6, 1, "python", "x")
    assert set(run(spark, [*rows, old])) == {("b.py:c", 5)}
