"""Functions paired with their documentation.

Comment spans, documentation strings and statement spans are read from texts on
their own, function spans from the function rows on their own. A text is that of
a file, or of a row itself, or its docstring column. An as-of join by text and
line gives every function the nearest span: above its declaration, or, in
Python, below it. A comment or string is its documentation; a statement or a
blank line in between, or another function's head, rejects it.
"""

from __future__ import annotations

import ast
import inspect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loamdex.session import Stages

#: Lines of a text that are joined in one group. The span next to a block is repeated
#: in it, so a text of any length is cut without losing a neighbour.
BLOCK = 4096

#: What counts as a doc-string column that was lost.
_LOST = {"nan", "none", "null", "n/a", "<na>"}

# ---------------------------------------------------------------- spans of a file

_STRINGS = {
    "js": (r"`(?:\\.|[^`\\])*`", r"'(?:\\.|[^'\\\n])*'", r'"(?:\\.|[^"\\\n])*"'),
    "go": (r"`[^`]*`", r"'(?:\\.|[^'\\\n])*'", r'"(?:\\.|[^"\\\n])*"'),
    "rust": (r'r(#*)".*?"\1', r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\\n])'"),
    "java": (r'"""(?:\\.|.)*?"""', r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"),
    "c": (r'R"(\w*)\(.*?\)\1"', r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"),
}
_FAMILY = {"ts": "js", "tsx": "js", "js": "js", "jsx": "js", "mjs": "js", "go": "go", "rs": "rust", "java": "java"}


_ANNOTATION = re.compile(r"@[\w.]+(\(.*\))?|#!?\[.*\]|\[\[.*\]\]|template\s*<.*>")


def _lexer(path: str) -> re.Pattern:
    strings = "|".join(_STRINGS[_FAMILY.get(path.rsplit(".", 1)[-1].lower(), "c")])
    return re.compile(rf"(?P<block>/\*.*?(?:\*/|\Z))|(?P<line>//[^\n]*)|(?P<string>{strings})", re.S)


def spans(path: str, text: str) -> Iterator[tuple[int, str | None]]:
    """``(line, comment or None)``: the last line of each comment and the first line
    of each run of statements and blank lines, in order and counted from 1.

    Annotation lines give no span: a comment above them still touches the
    declaration below.
    """
    text = re.sub(r"\r\n?", "\n", text)
    kind: dict[int, str] = {}
    pieces: list[tuple[int, int, str]] = []  # first line, last line, text
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    line = 0

    def line_of(pos: int) -> int:
        nonlocal line
        while line + 1 < len(starts) and starts[line + 1] <= pos:
            line += 1
        return line

    for m in _lexer(path).finditer(text):
        first = line_of(m.start())
        last = line_of(max(m.end() - 1, m.start()))
        if m["string"] is not None:
            for n in range(first, last + 1):
                kind[n] = "code"
            continue
        begin = starts[first]
        end = starts[last + 1] - 1 if last + 1 < len(starts) else len(text)
        if text[begin : m.start()].strip() or text[m.end() : end].strip() or kind.get(first) == "code":
            for n in range(first, last + 1):
                kind[n] = "code"
        else:
            for n in range(first, last + 1):
                kind[n] = "comment"
            if pieces and m["line"] is not None and pieces[-1][1] == first - 1 and pieces[-1][2].startswith("//"):
                pieces[-1] = (pieces[-1][0], last, pieces[-1][2] + "\n" + m[0])
            else:
                pieces.append((first, last, m[0]))
    comment_at = {last: body for _, last, body in pieces}
    apart = False
    for n, s in enumerate(starts):
        k = kind.get(n)
        if k == "comment":
            apart = False
            if n in comment_at:
                yield n + 1, comment_at[n]
            continue
        end = starts[n + 1] - 1 if n + 1 < len(starts) else len(text)
        if k is None and _ANNOTATION.fullmatch(text[s:end].strip()):
            apart = False
        elif not apart:
            apart = True
            yield n + 1, None


#: Text without a meaning of its own, and what follows it in Python source: a comment, a string, a bracket, a continued
#: line, a colon or a line end.
_PY_TOKEN = re.compile(
    r"([^#\"'()\[\]{}\\:\n]*+)(#[^\n]*|\"\"\"[^\"\\]*+(?:(?:\\.|\"(?!\"\"))[^\"\\]*+)*+(?:\"\"\"|\Z)|'''[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+(?:'''|\Z)"
    r"|\"(?:\\.|[^\"\\\n])*+\"?|'(?:\\.|[^'\\\n])*+'?|[()\[\]{}]|\\\n?|[:\n]|\Z)",
    re.S,
)
#: Lines of one statement each, without strings, comments and open brackets, that are no heads; and blank lines.
_PY_PLAIN = re.compile(
    r"(?:[ \t]*+(?!(?:async|def|class)\b)[^\s#\"'\\()\[\]{}][^#\"'\\()\[\]{}\n]*+(?:[(\[{][^#\"'\\()\[\]{}\n]*+[)\]}][^#\"'\\()\[\]{}\n]*+)*+\n|[ \t]*+\n)++"
)
_PY_HEAD = re.compile(r"\s*(?:async\s+def|def|class)\s+(\w+)")
_PY_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]", re.M)


def _string_value(token: str) -> str | None:
    """What a statement of string literals says; None if it is no plain text or has no end."""
    try:
        value = ast.literal_eval(f"({token})")
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        m = re.fullmatch(r"(?s)[rRuU]?(\"\"\"|'''|\"|')(.*)\1", token.strip())
        value = m[2] if m else None
    return inspect.cleandoc(value) if isinstance(value, str) else None


def python_spans(text: str) -> Iterator[tuple[int, str | None, str | None]]:
    """``(position, string or None, name)`` of the statements of a Python text, in order.

    The position is twice the line, counted from 1, and one more where a statement follows
    a head on its line. A statement that is only a string has its text and the name in the
    head right before it, if a head is. Heads of definitions and runs of other statements
    have neither; blank lines and comments give nothing. A definition that begins a line
    ends any bracket left open, so texts that don't parse are read as well.
    """
    text = re.sub(r"\r\n?", "\n", text)
    n, at, line, fresh, run = len(text), 0, 1, True, False
    pending: str | None = None
    while at < n:
        skipped = _PY_PLAIN.match(text, at) if fresh else None
        if skipped:
            bare = skipped[0].lstrip()
            if bare:
                if not run:
                    yield 2 * (line + skipped[0].count("\n") - bare.count("\n") ), None, None
                pending, run = None, True
            line += skipped[0].count("\n")
            at = skipped.end()
            continue
        # One statement, or a head up to its colon.
        start, begin, depth, plain, head, first, last = at, line, 0, True, None, -1, -1
        while at < n:
            m = _PY_TOKEN.match(text, at)
            gap, t = m[1], m[2]
            c, at = t[:1], m.end()
            if c == '"' or c == "'":
                bare = gap.strip()
                if bare and bare.lower() not in ("r", "u", "b", "f", "t", "rb", "br", "rf", "fr"):
                    plain = False
                if first < 0:
                    first = m.start(2) - len(gap.lstrip())
                last = at
                line += t.count("\n")
                continue
            if plain and gap and not gap.isspace():
                plain = False
            if c == "\n":
                line += 1
                if depth == 0 or _PY_HEAD.match(text[at : at + 200].split("\n", 1)[0]):
                    break
                if plain and first < 0:
                    begin = line
            elif c == ":":
                plain = False
                head = _PY_HEAD.match(text, start) if depth == 0 else None
                if head:
                    break
            elif c == "\\":
                line += len(t) - 1
            elif c and c in "([{":
                depth, plain = depth + 1, False
            elif c and c in ")]}":
                depth, plain = max(0, depth - 1), False
        if head:
            yield 2 * begin, None, None
            pending, run = head[1], False
        elif plain and first >= 0 and (said := _string_value(text[first:last])) is not None:
            yield 2 * begin + (not fresh), said, pending
            pending, run = None, False
        elif first >= 0 or not plain:
            if not run:
                yield 2 * begin + (not fresh), None, None
            pending, run = None, True
        fresh = not head


def _in_blocks(spans: list[tuple]) -> Iterator[tuple[int, tuple]]:
    """``(block, span)``; spans are ordered by their first field, the order, which is twice the line or its negative."""
    block, before = None, None
    for s in spans:
        mine = s[0] // (2 * BLOCK)
        while block is not None and block < mine:
            block += 1
            yield block, before
        block, before = mine, s
        yield mine, s
    if before is not None:
        yield block + 1, before


# ---------------------------------------------------------------- what documentation says

_TOOL = re.compile(
    r"^(pragma\b|type:\s*ignore|noqa\b|nolint\b|pylint\b|eslint\b|tslint\b|mypy\b|flake8\b|prettier-ignore|istanbul\b|c8 ignore|ts-(ignore|expect-error|nocheck)"
    r"|@ts-|fmt:|yapf:|isort:|clang-format|clang-tidy|nosec\b|nosonar\b|coverage:|jshint\b|jslint\b|go:\w|\+build\b|checkstyle|cppcheck|rustfmt|region\b|endregion\b)",
    re.I,
)
_HOLLOW = re.compile(
    r"^\W*(todo|fixme|xxx|tbd|tba|hack|wip)\b(?!-\w)|^\W*(none|null|nil|nan|n/a|na|undocumented|summary|_summary_|description|_description_|placeholder|documentation|docstring|comment)\W*$"
    r"|^\W*(not|no) (yet )?(documented|documentation|docs?|docstring|description)( yet)?\W*$|^\W*(auto-?|automatically )?generated( \w+)*( stub)?\W*$|^\W*(method|function|constructor) stub\W*$"
    r"|^\W*(documentation|docs?|docstring|description)( \w+){0,2} (pending|missing|needed|to follow|to come|goes here|here|later)\W*$"
    r"|^\W*(add|write|insert|needs?|missing) (a |the |some )?(documentation|docs?|docstring|description)( here)?\W*$|^\W*lorem ipsum\b",
    re.I,
)
_POINTER = re.compile(
    r"^\W*(\{@inheritdoc\}|@inheritdoc|inherit(ed|s)?( \w+){0,3}|@see\b.*|see( also)?:?( the)?( \w+)?( \w+)? ?(above|below|class|method|super|superclass|parent|base|interface|docs?|documentation|implementation|elsewhere|there|readme)"
    r"|see( also)?:? [\w.:#/()`]*[._:#/(`][\w.:#/()`]*|as above|ditto|same as above|refer to [\w.:#/()` ]{1,40}|overrides?( \w+){0,2})\W*$",
    re.I,
)
#: Words that say nothing about a function beyond that it is one.
_FILLER = set(
    "a an and the this that these it its is are be was of for to in on at by with from as or docstring doc documentation description function method "
    "procedure routine constructor helper implementation implements implement does do which used use param params parameter parameters arg args argument "
    "arguments return returns returned value values result results raise raises throws type self cls none null void def fn func class given".split()
)
_TAG = re.compile(r"^\s*[@:\\](param|parameter|arg|argument|type|returns?|rtype|raises?|throws?|exception|var|ivar|tparam|template|yields?)\b", re.I)
_SECTION = re.compile(r"^\s*(args|arguments|parameters|params|returns?|yields?|raises?|throws|attributes|keyword args|other parameters|examples?|notes?)\s*:?\s*$", re.I)


def words(text: str) -> list[str]:
    """Lower-case words; identifiers fall into their parts."""
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)
    return [w.lower() for w in re.findall(r"[^\W\d_]+", text)]


def _stem(w: str) -> str:
    for end, new in (("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""), ("e", "")):
        if w.endswith(end) and len(w) - len(end) >= 2:
            w = w[: -len(end)] + new
            break
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w[:-1] if w.endswith("e") or w.endswith("y") or w.endswith("i") else w


def strip_markup(comment: str) -> str:
    """Text of a comment without its marks."""
    if comment.startswith("/*"):
        lines = [re.sub(r"^\s*\*(?!/)\s?", "", x) for x in re.sub(r"\*+/\s*$", "", re.sub(r"^/\*[*!]*", "", comment)).split("\n")]
    else:
        lines = [re.sub(r"^\s*//[/!]*\s?", "", x) for x in comment.split("\n")]
    return "\n".join(x.rstrip() for x in lines).strip()


def says_something(doc: str, name: str, signature: str) -> bool:
    """Whether documentation says more than name and signature: False for
    placeholders, restated names, bare tags, mere pointers and notes to tools."""
    known = {_stem(w) for w in words(name) + words(signature)}
    left = []
    for line in doc.split("\n"):
        line = line.strip().strip("*").strip()
        if not line or _TOOL.match(line) or _SECTION.match(line) or _POINTER.match(line) or _HOLLOW.match(line):
            continue
        tag = _TAG.match(line)
        if tag:
            line = line[tag.end() :]
            if tag[1].lower() in ("type", "rtype"):
                continue
        left += words(re.sub(r"\{@\w+[^}]*\}|</?\w+[^>]*>", " ", line))
    return any(w not in _FILLER and _stem(w) not in known for w in left)


def _first_code_line(source: str) -> int:
    """Lines above the declaration: blank lines at the top of the window are not it."""
    return next((i for i, x in enumerate(re.sub(r"\r\n?", "\n", source).split("\n")) if x.strip()), 0)


def _def_line(source: str) -> int:
    """Lines above the first ``def``, such as decorators."""
    text = re.sub(r"\r\n?", "\n", source)
    m = _PY_DEF.search(text)
    return text.count("\n", 0, m.start()) if m else _first_code_line(text)


def _declaration(code: str) -> str:
    return next((x for x in code.split("\n") if x.strip() and not x.strip().startswith(("@", "#"))), "")


def _good(doc: str | None, name: str, signature: str) -> bool:
    return bool(doc) and doc.strip().lower() not in _LOST and says_something(doc, name, signature)


# ---------------------------------------------------------------- the operator

_SPAN = "file_path string, version long, block int, at int, is_fn int, text string, name string, node_id string, start_line int, signature string, of_file boolean"
_COLUMNS = [c.split(" ")[0] for c in _SPAN.split(", ")]


def _path() -> Column:
    return F.coalesce("file_path", F.regexp_replace(F.substring_index("node_id", ":", 1), "^file:", ""))


def _functions(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin("function", "method") & F.col("node_id").isNotNull() & F.col("start_line").isNotNull() & (F.trim("source_code") != ""))


def _spans_and_points(symbols: DataFrame) -> DataFrame:
    """One pass over the table: the spans of every text, and the functions as points in the texts that may hold their documentation.

    ``at`` orders a text such that what belongs to a function comes before it: twice the line, or
    in Python its negative. Points in the text of a file have no version yet.
    """
    python = F.coalesce(F.col("language"), F.lit("")).isin("python") | F.col("path").rlike(r"\.pyi?$")
    is_file = F.col("node_id").startswith("file:") & F.col("source_code").isNotNull() & ~F.col("kind").isin("function", "method") & ~F.col("path").rlike(r"\.(ya?ml|toml|md|log|json)$")
    functions = _functions(symbols).select(_path().alias("path"), "node_id", "start_line", "name", "language", "signature", "docstring", "source_code", F.lit(True).alias("fn"))
    files = symbols.withColumn("path", _path()).where(is_file).select("path", "node_id", "start_line", "name", "language", "signature", "docstring", "source_code", F.lit(False).alias("fn"))
    rows = functions.unionByName(files).withColumn("python", python).withColumn("version", F.xxhash64("fn", "source_code", "docstring", F.when(F.col("fn"), F.struct("node_id", "start_line"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for r in b.itertuples(index=False):
                sign = -1 if r.python else 1
                # spans: (at, text, name)
                found: list[tuple[int, str | None, str | None]] = []
                points: list[tuple] = []
                if r.fn:
                    start = int(r.start_line)
                    line = start + (_def_line(r.source_code) if r.python else _first_code_line(r.source_code))
                    name, signature = r.name or "", r.signature or _declaration(r.source_code)
                    points = [(sign * 2 * line, None, name, r.node_id, start, signature)]
                    block = points[0][0] // (2 * BLOCK)
                    out.append((r.path, None, block, points[0][0], 1, *points[0][1:], True))
                    if not r.python:
                        continue
                    if _good(r.docstring, name, signature):
                        found = [(-2 * line - 1, r.docstring, name)]
                    else:
                        found = []
                        for p, text, n in python_spans(r.source_code):
                            p += 2 * start - 2
                            found.insert(0, (-p, text, n))
                            if p > 2 * line:
                                break  # what follows cannot be nearer
                    out.append((r.path, r.version, block, points[0][0], 1, *points[0][1:], False))
                elif r.python:
                    found = [(-p, text, n) for p, text, n in python_spans(r.source_code)][::-1]
                else:
                    found = [(2 * line, comment, None) for line, comment in spans(r.path, r.source_code)]
                out += [(r.path, r.version, block, at, 0, text, n, None, None, None, not r.fn) for block, (at, text, n) in _in_blocks(found)]
            got = pd.DataFrame(out, columns=_COLUMNS, dtype=object)
            for c in ("version", "start_line"):
                got[c] = got[c].astype("Int64")
            yield got

    return rows.select("path", "node_id", "start_line", "name", "signature", "docstring", "source_code", "fn", "python", "version").mapInPandas(run, _SPAN)


def documentation(symbols: DataFrame) -> DataFrame:
    """``node_id, start_line, documentation`` of every function and method that has documentation worth the name.

    Rows without code or start_line are left out; a node_id with two definitions gives a row for
    each. A null file_path or language is read from the node_id. Of several texts that document a
    function (its docstring, its own code, any stored version of its file) the longest is given.
    """
    read = Stages(symbols.sparkSession, "spans").save(_spans_and_points(symbols).distinct())
    versions = read.where("is_fn = 0 and of_file").select("file_path", "version").distinct()
    in_file = read.where("is_fn = 1 and of_file").drop("version").join(versions, "file_path").select(*_COLUMNS)
    every = read.where("is_fn = 0 or not of_file").unionByName(in_file)
    # As of the function: what stands at its own place is not before it.
    order = W.partitionBy("file_path", "version", "block").orderBy("at", F.desc("is_fn")).rowsBetween(W.unboundedPreceding, -1)
    near = F.last(F.when(F.col("is_fn") == 0, F.struct(F.col("text"), F.col("name").alias("head"))), ignorenulls=True).over(order)
    met = every.withColumn("near", near).where("is_fn = 1 and near.text is not null")
    met = met.where(F.col("near.head").isNull() | ~F.col("of_file") | F.col("name").isin("") | (F.col("near.head") == F.col("name")))
    met = met.where((F.col("at") > 0) | F.col("near.head").isNotNull())  # a string in Python follows a head

    @F.pandas_udf("string")
    def said(text: pd.Series, at: pd.Series, name: pd.Series, signature: pd.Series) -> pd.Series:
        docs = [t if a < 0 else strip_markup(t) for t, a in zip(text, at)]
        return pd.Series([d if _good(d, n, s) else None for d, n, s in zip(docs, name, signature)], dtype=object)

    docs = met.select("node_id", "start_line", said("near.text", "at", "name", "signature").alias("documentation")).where("documentation is not null")
    best = F.max(F.struct(F.length("documentation").alias("n"), "documentation"))
    return docs.groupBy("node_id", "start_line").agg(best.alias("b")).select("node_id", "start_line", "b.documentation")


def documented(symbols: DataFrame) -> DataFrame:
    """``node_id, start_line, file_path, language, signature, code, documentation``: the code of ``documentation``.

    Repeated rows give one; of rows that share node_id and start_line but differ, the smallest counts.
    """
    code = F.struct(F.coalesce("signature", F.lit("")).alias("s"), "source_code", _path().alias("file_path"), "language", "signature")
    one = _functions(symbols).groupBy("node_id", "start_line").agg(F.min(code).alias("c"))
    both = documentation(symbols).join(one, ["node_id", "start_line"])
    return both.select("node_id", "start_line", "c.file_path", "c.language", "c.signature", F.col("c.source_code").alias("code"), "documentation")
