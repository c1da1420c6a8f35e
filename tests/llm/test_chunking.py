import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from loamdex.llm import chunking as C

PY = '''import os

HELP = """
def inner(x): example
class Fake: no
"""

# about one
# and more
@cached
@route("/x")
def one():
    def nested():
        pass
    return 1


class Two(Base):
    def method(self):
        pass
x = call(
    3,
)
async def three(): pass
'''
TS = "import { A } from './a';\n\n/**\n * Doc.\n */\nexport class A {\n  f() {\n    function inner() {}\n  }\n}\nconst help = `\nexport function no() {\n`;\nconst limit = 3;\nexport const go = async (x: number) => {\n};\n// note\nfunction last() {\n}\n"
MD = "intro\n\n# One\ntext\n\nTwo\n===\n\n```\n# not\ndef x():\n```\n- a\n- b\n\nThree\n-----\n#no\n"
YAML = "---\n# c\na: 1\nb:\n  c: 2\n  # d\n\"q\":\n- x: 1\ntext: |\n  k: no\n\n  j: no\nlast: [1,\n  2]\n"
TOML = "top = 1\n[a]\nx = [\n  [1, 2],\n]\ny = \"\"\"\n[no]\n\"\"\"\n# c\n[[b.c]]\nz = 1\n"
GIT = "commit abcdef1\nAuthor: a\n\n    commit 123abcd broke this\n\ncommit 1234567abc\n\n    x\n"


@pytest.mark.parametrize("kind,path,text,want", [
    ("code", "a.py", PY, [8, 18, 24]), ("code", "a.ts", TS, [3, 15, 17]), ("wiki", "a.md", MD, [3, 6, 16]), ("config", "a.yaml", YAML, [2, 4, 7, 9, 13]), ("config", "a.toml", TOML, [1, 2, 9]), ("git", ".log", GIT, [1, 6]),
    ("code", "a.go", "package a\n\n// Doc\nfunc A() {\n}\ntype B struct {\n\tx int\n}\nvar s = `\nfunc no() {\n`\n", [3, 6]),
    ("code", "a.rs", "use x;\n#[inline]\npub fn a() {\n}\n/// d\npub struct B {\n}\nimpl B {\n  fn c() {}\n}\n", [2, 5, 8]),
    ("code", "a.java", "package x;\n\n@Deprecated\npublic class A {\n  int f() {\n  }\n}\n", [3]), ("code", "a.c", "#include <a.h>\nstatic int x = 3;\nint f(int a) {\n  if (a) {\n  }\n}\n/* d */\nstruct S {\n  int a;\n};\nint g(void);\n", [3, 7]),
])
def test_where_items_begin(kind, path, text, want):
    lines = [text[s:e] for s, e in C.lines_of(text)]
    assert [i + 1 for i in C.item_lines(lines, kind, path, None)] == want
    natural = [i + 1 for i in C.analyse(text, kind, path, None)[3]]
    assert set(natural) <= set(want) - {1} and len(natural) >= len(set(want) - {1}) - 1
    assert C.analyse(text.replace("\n", "\r\n"), kind, path, None)[3].tolist() == C.analyse(text, kind, path, None)[3].tolist()


@pytest.mark.parametrize("block", C.BLOCKS)
def test_cohesion_against_brute_force(block):
    lines = ["alpha betaGamma", "  alpha", "beta gamma", "delta", "delta alpha;", "x y"] * 3
    paragraph = np.arange(18) // 4
    got = C.cohesion(*C.line_terms(lines, paragraph), len(lines), block)
    words = lambda x: [w for w in re.findall(r"[^\W\d_]{2,}", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower())]

    def cos(a, b):
        dot = sum(a[k] * b[k] for k in a)
        n = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
        return dot / n if n else 0

    for i in range(1, len(lines)):
        above, below = (Counter(t for j in part for t in [*words(lines[j]), *((t,) for t in C._shape(lines[j])), *[int(paragraph[j])] * C.PARAGRAPH]) for part in (range(max(0, i - block), i), range(i, min(18, i + block))))
        assert got[i] == pytest.approx(cos(above, below), abs=1e-4)


def test_words_decide_where_boundaries_are():
    """All lines look alike and the grammar knows the same beginnings; boundaries follow the words."""
    topics = ["apple pear plum fig", "axle wheel brake gear", "verse rhyme chorus ode", "salt mint thyme sage"] * 3
    lines, hashes = [], []
    for n, t in enumerate(topics):
        w = t.split()
        hashes.append(len(lines))
        lines += [f"commit 123{n:04d} {w[0]} {w[1]} {w[2]}", *(f"commit {w[i % 4]} {w[(i + 1) % 4]} {w[(i + 2) % 4]}" for i in range(9))]
    natural = C.analyse("\n".join(lines), "git", ".log", None)[3].tolist()
    assert natural == hashes[1:] == C.item_lines(lines, "git", ".log", None)[1:]
    words = [w for x in lines for w in x.split()[-3:]]
    seen = set()
    for seed in range(5):
        np.random.default_rng(seed).shuffle(words)
        other = [" ".join([*x.split()[:-3], *words[3 * k : 3 * k + 3]]) for k, x in enumerate(lines)]
        assert C.item_lines(other, "git", ".log", None) == hashes
        seen.add(tuple(C.analyse("\n".join(other), "git", ".log", None)[3].tolist()))
    assert any(list(x) != natural for x in seen) and len(seen) > 1
    same = ["commit abcdef1", "commit abcdef1"] * 20  # no valley, no boundary, whatever the grammar says
    assert not len(C.analyse("\n".join(same), "git", ".log", None)[3])


def test_a_valley_without_a_beginning_is_no_boundary():
    text = "x = 1\nHELP = '''\nred green\n\nblue one\n\ndef no():\n    pass\n'''\ny = 2\n"
    _, low, _, natural = C.analyse(text, "code", "a.py", None)
    assert len(low) and not len(natural)


def test_long_items_take_linear_time():
    text = "// c\nfunction a() {\n}\n" * 30000
    start = time.time()
    C.analyse(text, "code", "a.js", None)
    assert time.time() - start < 30


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\r#=:;é𝔁", max_size=900), st.integers(20, 90), st.integers(0, 19), st.sampled_from(["wiki", "config", "code", "git"]))
def test_pieces_cover_and_overlap(text, size, overlap, kind):
    if len(text) <= size:
        return
    spans, low, depth, natural = C.analyse(text, kind, "a.md" if kind == "wiki" else "a.yaml" if kind == "config" else "a.py", None)
    p = C.pieces(text, spans, low, depth, natural, size, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text) and all(0 < e - s <= size for s, e in p)
    assert all(b[0] == a[1] - overlap for a, b in zip(p, p[1:]))


def test_split_items(spark):
    limits = spark.createDataFrame([("chunk:code", "characters", 60, 10), ("document", "tokens", 9, 0)], "item_kind string, unit string, max_size int, overlap int")
    long = "def a():\n    return 'aaaaaaaaaaaaaaaaaaa'\ndef b():\n    return 'bbbbbbbbbbbbbbb'\n"
    rows = [("c1", "a.py", "code", long, 5, 8, "python", 1), ("c1", "a.py", "code", long, 5, 8, "python", 2), ("c2", "a.py", "code", "short", 1, 1, None, 3), ("c3", None, "code", "z" * 150, None, None, None, 4), ("c4", "a", "code", None, 1, 1, None, 5), ("c5", "a", "odd", "y" * 500, 1, 1, None, 6), ("c6", "a", "code", "", 1, 1, None, 7)]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_path string, chunk_type string, content string, start_line int, end_line int, language string, max_size_clash int")
    got = {}
    for r in C.split_items(chunks, limits).orderBy("chunk_id", "piece_no").collect():
        got.setdefault(r["chunk_id"], []).append((r["content"], r["start_line"], r["end_line"]))
    assert set(got) == {"c1", "c3"} and got["c1"][0] == (long[:42], 5, 6) and got["c1"][1][0] == long[32:] and got["c1"][1][1:] == (6, 8)
    assert [len(x[0]) for x in got["c3"]] == [60, 60, 50]
    assert [tuple(r)[:2] for r in C.natural_boundaries(chunks, limits).collect()] == [("c1", 3)]
    assert C.split_items(chunks.limit(0), limits).count() == 0
