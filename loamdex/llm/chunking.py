"""Splitting oversized items at natural boundaries.

Two blocks of lines slide over the lines of an item that are not blank; the
cohesion at a gap is the cosine of the terms of the block above and the block
below. Terms are the words of a line (identifiers fall into their parts), its
shape (how far it is indented, how it begins and ends) and its paragraph. A gap
where the cohesion falls, by more than is usual in this item, is a valley.
Valleys alone tell where a boundary may be, to within one line; the grammar of
the item moves a valley to the beginning of an item that lies that near and
drops a valley without one, such as one inside a string or a listing. A
beginning without a valley near is no boundary. A piece ends at the deepest
valley that its size allows, and the next piece starts ``overlap`` characters
before that.

Each item is cut where it lies: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Lines in a block: valleys are looked for with each size, and moved by no more than the smallest.
BLOCKS = (1, 2)
#: How many words of a line its paragraph counts for.
PARAGRAPH = 3
#: A valley may be shallower than the mean of its item by so many standard deviations.
LENIENT = 1.0
#: Lines that are counted at a time.
STRETCH = 512
#: Part of the largest size that a piece fills if a natural boundary allows; the higher, the fewer
#: pieces, the lower, the deeper the valleys to choose from. It changes no boundary.
FILL = 0.4

_EOL = re.compile(r"\r\n|\r|\n")


def lines_of(content: str) -> list[tuple[int, int]]:
    """``(start, end without line end)`` of every line."""
    out, at = [], 0
    for m in _EOL.finditer(content):
        out.append((at, m.start()))
        at = m.end()
    if at < len(content) or not out:
        out.append((at, len(content)))
    return out


# ---------------------------------------------------------------- where items begin

_PY_STRING = re.compile(r"(?i)(?<!\w)[rbuft]{0,2}('''|\"\"\")")
_PY_TOKEN = re.compile(r"#|'''|\"\"\"|'(?:\\.|[^'\\])*'?|\"(?:\\.|[^\"\\])*\"?|[()\[\]{}]")
_PY_BEGIN = re.compile(r"(async\s+def|def|class)\s+\w")
_C_STRINGS = {
    "js": r"`(?:\\.|[^`\\])*(?:`|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"",
    "go": r"`[^`]*(?:`|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"",
    "rust": r"\br(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'",
    "c": r"R\"(\w*)\(.*?\)\1\"|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
}
_C_FAMILY = {"ts": "js", "tsx": "js", "js": "js", "jsx": "js", "mjs": "js", "go": "go", "rs": "rust"}
_C_ANNOTATION = re.compile(r"@[\w.]+(\(.*\))?|#!?\[.*\]|\[\[.*\]\]|template\s*<.*>")
_JS_BEGIN = re.compile(
    r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\b|class\b|interface\s+\w|enum\s+\w|namespace\s+\w|type\s+\w+[^=;]*=)"
    r"|(?:export\s+)?(?:const|let|var)\s+\w+\s*(?::[^=]*)?=\s*(?:async\s*)?(?:function\b|class\b|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|\w+)\s*(?::[^=>{]*)?=>)"
)
_GO_BEGIN = re.compile(r"func\b|type\s+\w+(?:\[.*?\])?\s+(?:struct|interface|func|map|chan|\[|\*?\w)|type\s*\(")
_RUST_BEGIN = re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*(?:fn|struct|enum|trait|union|impl|mod|type|macro_rules!)\b")
_C_BEGIN = re.compile(
    r"(?:(?:typedef|static|inline|extern|public|private|protected|abstract|final|sealed|partial|strictfp|constexpr|friend|internal)\s+)*(?:(?:enum\s+)?class|struct|union|enum|interface|record|@interface)\b(?![^{;=]*\)\s*;)[^;=()]*(?:\([^)]*\)[^;=]*)?(?:\{|$)"
    r"|(?!(?:return|else|if|for|while|switch|do|case|goto|throw|new|using|import|package|#|typedef)\b)(?:[\w:<>,*&\[\]~.?]+\s+)*[*&]*[\w:~]+(?:\s*operator\s*\S+)?\s*\((?:[^()]|\([^()]*\))*\)?[^;=]*(?:\{|$)"
)


def _family(path: str, language: str | None) -> str:
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    by_name = {"python": "py", "typescript": "ts", "javascript": "js", "go": "go", "rust": "rs", "java": "java", "c": "c", "cpp": "cpp", "markdown": "md", "yaml": "yaml", "toml": "toml"}
    known = {*by_name.values(), "pyi", "tsx", "jsx", "mjs", "h", "hpp", "cc", "cxx", "yml", "json", "ini", "cfg", "rst"}
    return ext if ext in known else by_name.get((language or "").lower(), ext)


def _python_begins(lines: list[str]) -> list[int]:
    """Lines on which an outermost def or class begins, with its decorators and comments."""
    begins, open_string, depth, outer, lead = [], None, 0, None, None
    for i, x in enumerate(lines):
        body = x.strip()
        indent = len(x) - len(x.lstrip())
        if open_string is None and depth and (_PY_BEGIN.match(body) or body[:1] == "@" and (outer is None or indent <= outer)):
            depth = 0  # no bracket holds a definition: one above was never closed
        if open_string is None and depth == 0:
            if not body:
                lead = lead if lead is not None and lines[lead].lstrip().startswith("@") else None
            elif body.startswith("#") or body.startswith("@"):
                if outer is None or indent <= outer:
                    if lead is None:
                        lead = i
                    if body.startswith("@"):
                        outer = None if outer is not None and indent <= outer else outer
            else:
                if outer is not None and indent <= outer:
                    outer = None
                if outer is None and _PY_BEGIN.match(body):
                    begins.append(i if lead is None else lead)
                    outer = indent
                lead = None
        # strings and brackets that stay open at the end of the line
        at = 0
        while at < len(x):
            if open_string:
                end = x.find(open_string, at)
                if end < 0:
                    break
                at, open_string = end + 3, None
            m = _PY_TOKEN.search(x, at)
            if not m or m[0] == "#":
                break
            at, t = m.end(), m[0]
            if t in ("'''", '"""'):
                open_string = t
            elif t[0] not in "'\"":
                depth = max(0, depth + (1 if t in "([{" else -1))
    return begins


def _brace_begins(lines: list[str], ext: str) -> list[int]:
    """The same for languages with braces: definitions at depth 0 outside strings and comments."""
    text = "\n".join(lines)
    family = _C_FAMILY.get(ext, "c")
    token = re.compile(rf"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>{_C_STRINGS[family]})", re.S)

    def blank(m: re.Match) -> str:
        inside = re.sub(r"[^\n]", " ", m[0])
        return inside if m["comment"] else f'"{inside[1:-1]}"'  # strings have two quotes at least, or end with the text

    bare = token.sub(blank, text).split("\n")
    comments: set[int] = set()
    first = counted = 0
    for m in token.finditer(text):
        if m["comment"]:
            first, counted = first + text.count("\n", counted, m.start()), m.start()
            if not bare[first].strip():
                comments.update(range(first, first + m[0].count("\n") + 1))
    pattern = {"js": _JS_BEGIN, "go": _GO_BEGIN, "rust": _RUST_BEGIN}.get(family, _C_BEGIN)
    begins, depth, lead, ended = [], 0, None, True
    code = re.sub(r"'[^']*'|\"[^\"]*\"", "", "".join(bare))
    broken = any(code.count(a) != code.count(b) for a, b in ("{}", "()", "[]"))
    for i, x in enumerate(bare):
        body = x.strip()
        if broken and depth and body and not x[0].isspace() and pattern.match(body):
            depth, ended = 0, True  # a bracket above was never closed
        if depth == 0:
            if i in comments and not body:
                lead = i if lead is None else lead
            elif not body:
                lead = None
            elif _C_ANNOTATION.fullmatch(body):
                lead = i if lead is None else lead
            else:
                if ended and pattern.match(body):
                    begins.append(i if lead is None else lead)
                lead = None
        inner = re.sub(r"'[^']*'|\"[^\"]*\"", "", x)
        depth = max(0, depth + inner.count("{") + inner.count("(") + inner.count("[") - inner.count("}") - inner.count(")") - inner.count("]"))
        if body:
            ended = depth == 0
    return begins


def _prose_begins(lines: list[str]) -> list[int]:
    """Headings with # or with a rule below, outside fenced listings."""
    begins, fence = [], None
    for i, x in enumerate(lines):
        m = re.match(r" {0,3}(`{3,}|~{3,})", x)
        if m:
            if fence is None:
                fence = m[1]
            elif m[1].startswith(fence) and not x.strip().strip(fence[0]):
                fence = None
            continue
        if fence is not None:
            continue
        if re.match(r" {0,3}#{1,6}(\s+\S|$)", x):
            begins.append(i)
        elif re.match(r"\s*=+\s*[^=\s].*[^=\s]\s*=+\s*$", x):
            begins.append(i)
        elif i + 1 < len(lines) and x.strip() and re.fullmatch(r" {0,3}(=+|-+)\s*", lines[i + 1]) and not re.match(r" {4}|\t|\s*([-*+>|]|\d+[.)])\s", x):
            if not (i and lines[i - 1].strip() and not lines[i - 1].lstrip().startswith("#")):
                begins.append(i)
    return begins


def _config_begins(lines: list[str], ext: str) -> list[int]:
    """Top-level keys or table headers, with the comment directly above."""
    begins, lead, text, depth, in_block, header = [], None, None, 0, None, False
    toml = ext in ("toml", "ini", "cfg")
    for i, x in enumerate(lines):
        body = x.strip()
        if text is not None:  # a string over several lines
            end = x.find(text)
            if end >= 0:
                text = None
            continue
        if in_block is not None:  # a block scalar goes on while lines are indented
            if not body or len(x) - len(x.lstrip()) > in_block:
                continue
            in_block = None
        if not body:
            lead = None
            continue
        if depth == 0 and not x[0].isspace():
            if body[0] in "#;":
                lead = i if lead is None else lead
                continue
            if toml:
                item = re.match(r"\[\[?[^\[\]]+\]\]?\s*([#;].*)?$", body)
                header = header or bool(item)
                item = item or not header and re.match(r"[\w.\"'-]+\s*=", body)  # keys above the first table
            elif ext == "json":
                item = None
            else:
                item = re.match(r"(\"[^\"]*\"|'[^']*'|[^\s#&*!|>'\"%@`\-\[\]{},?:][^#]*?|[^\s#\[\]{},&*!|>'\"%@`-][^:]*?)\s*:(\s|$)", body)
            if item:
                begins.append(i if lead is None else lead)
        elif ext == "json" and depth == 1 and re.match(r"\s*\"[^\"]*\"\s*:", x):
            begins.append(i)
        lead = None
        bare = re.sub(r"\"\"\".*?\"\"\"|'''.*?'''", "", x)
        m = re.search(r"\"\"\"|'''", bare) if toml else None
        if m:
            text = m[0]
            continue
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'[^']*'", "", bare)
        bare = re.sub(r"(^|\s)#.*", "", bare)
        if not toml and re.search(r"(:|-|^)\s*[|>][+\-\d]*\s*$", bare):
            in_block = len(x) - len(x.lstrip())
        elif not re.match(r"\[\[?[^\[\]]+\]\]?\s*$", bare.strip()) or not toml:
            depth = max(0, depth + bare.count("[") + bare.count("{") - bare.count("]") - bare.count("}"))
    return begins


def _git_begins(lines: list[str]) -> list[int]:
    return [i for i, x in enumerate(lines) if re.match(r"commit [0-9a-f]{7,64}\b", x)]


def item_lines(lines: list[str], chunk_type: str, path: str, language: str | None) -> list[int]:
    """Lines (from 0) on which an item of the content begins, by the grammar of its kind."""
    ext = _family(path, language)
    if chunk_type == "git":
        return _git_begins(lines)
    if chunk_type in ("wiki", "docs") or ext in ("md", "rst"):
        return _prose_begins(lines)
    if chunk_type == "config" or ext in ("yaml", "yml", "toml", "json", "ini", "cfg"):
        return _config_begins(lines, ext)
    return _python_begins(lines) if ext in ("py", "pyi", "") else _brace_begins(lines, ext)


# ---------------------------------------------------------------- cohesion


_WORD = re.compile(r"[^\W\d_]{2,}|\n")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _shape(line: str) -> tuple[str, ...]:
    """Terms for how a line looks that is not blank: its indent, and the kinds of its first and last character."""
    s = line.strip()
    kind = lambda c: "w" if c.isalnum() else c
    return f"indent {min(len(line) - len(line.lstrip()), 8)}", f"first {kind(s[0])}", f"last {kind(s[-1])}"


def line_terms(lines: list[str], paragraph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the line and of the term, for every word, shape and paragraph of lines that are not blank."""
    ids: dict = {}
    found = _WORD.findall(_HUMP.sub(" ", "\n".join(lines)).lower())
    word = np.fromiter((-1 if w == "\n" else ids.setdefault(w, len(ids)) for w in found), np.int64, len(found))
    rows = np.cumsum(word < 0)
    more = np.array([(i, ids.setdefault((t,), len(ids))) for i, x in enumerate(lines) for t in _shape(x)], np.int64).reshape(-1, 2)
    place = np.repeat(np.arange(len(lines)), PARAGRAPH)
    rows, cols = np.concatenate([rows[word >= 0], more[:, 0], place]), np.concatenate([word[word >= 0], more[:, 1], len(ids) + paragraph[place]])
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order]


def cohesion(rows: np.ndarray, cols: np.ndarray, n: int, block: int) -> np.ndarray:
    """Cosine of the term counts of the ``block`` lines above and from line i on, for each of n lines (1 for the first).

    Term ``cols[i]`` stands on line ``rows[i]``; rows ascend.
    """
    out = np.zeros(n)
    for lo in range(0, n, STRETCH):
        hi = min(n, lo + STRETCH)
        first, last = max(0, lo - block), min(n, hi + block)
        a, b = np.searchsorted(rows, (first, last))
        if a == b:
            continue
        terms, local = np.unique(cols[a:b], return_inverse=True)
        count = np.zeros((last - first + 1, len(terms)), np.float32)
        np.add.at(count, (rows[a:b] - first + 1, local), 1)
        count = np.cumsum(count, axis=0)
        i = np.arange(lo, hi) - first
        above = count[i] - count[np.maximum(i - block, 0)]
        below = count[np.minimum(i + block, last - first)] - count[i]
        norm = np.sqrt((above * above).sum(1) * (below * below).sum(1))
        out[lo:hi] = (above * below).sum(1) / np.maximum(norm, 1e-9)
    out[0] = 1
    return out


def depths(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the cohesion falls at each gap below the nearest peaks on both sides, and below the lower of them.

    Both ends of the item count as peaks.
    """
    n = len(c)
    left, right = c.tolist(), c.tolist()
    for i in range(1, n):
        if c[i] <= c[i - 1]:
            left[i] = left[i - 1]
    following = 1.0
    for i in range(n - 1, -1, -1):
        if c[i] <= (c[i + 1] if i + 1 < n else 1.0):
            right[i] = following
        following = right[i]
    rise = np.array(left) - c, np.array(right) - c
    out, least = rise[0] + rise[1], np.minimum(*rise)
    out[0] = least[0] = 0
    return out, least


def valleys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the lines (not the first, none blank) begin below a valley, and how deep each gap lies.

    Nothing but the terms of the lines decides. A valley is a lowest point of the cohesion under
    one of ``BLOCKS`` that falls on both sides, or to nothing, and by no less than the item's mean depth
    without ``LENIENT`` standard deviations.
    """
    full = np.array([i for i, x in enumerate(lines) if x.strip()], np.int64)
    found, deepest = np.zeros(len(lines), bool), np.zeros(len(lines))
    if not len(full):
        return np.flatnonzero(found), deepest
    rows, cols = line_terms([lines[i] for i in full], np.cumsum(np.diff(full, prepend=-1) > 1))
    for block in BLOCKS:
        c = cohesion(rows, cols, len(full), block)
        d, lower = depths(c)
        least = d[1:].mean() - LENIENT * d[1:].std() if len(d) > 1 else 0
        around = np.concatenate([[np.inf], c, [np.inf]])
        low = (c <= around[:-2] + 1e-6) & (c <= around[2:] + 1e-6) & ((lower > 1e-6) | (c < 1e-6))
        found[full] |= low & (d >= least)
        deepest[full] = np.maximum(deepest[full], d)
    found[full[0]] = found[0] = False
    return np.flatnonzero(found), deepest


def analyse(content: str, chunk_type: str, path: str, language: str | None) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """Lines, valleys, depth of every gap, and natural boundaries (line numbers from 0) of a content.

    A natural boundary is the beginning of an item at a valley or one line from it, blank ones
    not counted, and as deep as the deepest valley there.
    """
    spans = lines_of(content)
    lines = [content[s:e] for s, e in spans]
    low, depth = valleys(lines)
    begins = np.array(item_lines(lines, chunk_type, path, language), dtype=np.int64)
    begins = begins[begins > 0]
    full = np.array([i for i, x in enumerate(lines) if x.strip()], np.int64)
    at_valley = np.full(len(full) + 2, -1.0)
    at_valley[np.searchsorted(full, low) + 1] = depth[low]
    k = np.searchsorted(full, begins)
    best = np.maximum(np.maximum(at_valley[k], at_valley[k + 1]), at_valley[np.minimum(k + 2, len(full) + 1)])
    natural = begins[best >= 0]
    depth[natural] = best[best >= 0]
    return spans, low, depth, natural


def pieces(content: str, spans: list[tuple[int, int]], low: np.ndarray, depth: np.ndarray, natural: np.ndarray, max_size: int, overlap: int, fill: float = FILL) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces, in characters: none longer than ``max_size``,
    each but the first starting exactly ``overlap`` before the end of the one above.

    A piece ends at the deepest natural boundary it can reach, else at the deepest valley,
    else at the deepest other line, else at the last blank, else at the limit; it must be
    longer than the overlap. Of equally deep ones the last is taken.
    """
    overlap = max(0, min(overlap, max_size - 1))
    starts = np.array([s for s, _ in spans])
    out, at, n = [], 0, len(content)
    while n - at > max_size:
        limit = at + max_size
        cut = 0
        for least in (int(max_size * fill), overlap + 1):
            lo, hi = np.searchsorted(starts, at + max(least, overlap + 1)), np.searchsorted(starts, limit, "right")
            for gaps in (natural[(natural >= lo) & (natural < hi)], low[(low >= lo) & (low < hi)], np.arange(max(lo, 1), hi)):
                if len(gaps):
                    best = depth[gaps]
                    cut = int(starts[gaps[np.flatnonzero(best == best.max())[-1]]])
                    break
            if cut:
                break
        if not cut:
            space = max((m.end() for m in re.finditer(r"\s+|[;,]", content[at + overlap + 1 : limit])), default=0)
            cut = at + overlap + 1 + space if space else limit
            if content[cut - 1 : cut + 1] == "\r\n":
                cut += 1 if cut < limit else -1
        out.append((at, cut))
        at = cut - overlap
    out.append((at, n))
    return out


# ---------------------------------------------------------------- the operators


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Chunks whose content has more characters than their chunk_type allows. Types without a limit have none."""
    kind = limits.where("item_kind like 'chunk:%'").select(F.substring("item_kind", 7, 1000).alias("chunk_type"), "max_size", "overlap")
    wanted = chunks.select("chunk_id", "file_path", "chunk_type", "content", "start_line", "end_line", "language")
    return wanted.join(F.broadcast(kind), "chunk_type").where(F.length("content") > F.col("max_size"))  # a row per chunk_type


def split_items(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``chunk_id, piece_no, content, start_line, end_line, chunk_type`` of the pieces of oversized chunks.

    Lines count on from the chunk's start_line, or from 1 where that is null.
    Null contents are never oversized. Repeated rows give the same pieces once;
    rows that share a chunk_id but differ are each cut.
    """
    big = oversized(chunks, limits).dropDuplicates(["chunk_id", "content", "start_line", "chunk_type"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                spans, low, depth, natural = analyse(r.content, r.chunk_type, r.file_path or "", r.language)
                starts = np.array([s for s, _ in spans])
                first = 1 if r.start_line is None or r.start_line != r.start_line else int(r.start_line)
                for no, (s, e) in enumerate(pieces(r.content, spans, low, depth, natural, int(r.max_size), int(r.overlap))):
                    line = lambda at: first + int(np.searchsorted(starts, at, "right")) - 1
                    rows.append((r.chunk_id, no, r.content[s:e], line(s), line(e - 1), r.chunk_type))
            yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "content", "start_line", "end_line", "chunk_type"])

    return big.mapInPandas(run, "chunk_id string, piece_no int, content string, start_line int, end_line int, chunk_type string")


def natural_boundaries(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``chunk_id, line_no, depth``: the natural boundaries of oversized chunks; line 1 is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                _, _, depth, natural = analyse(r.content, r.chunk_type, r.file_path or "", r.language)
                rows += [(r.chunk_id, int(i) + 1, float(depth[i])) for i in natural]
            yield pd.DataFrame(rows, columns=["chunk_id", "line_no", "depth"])

    found = oversized(chunks, limits).mapInPandas(run, "chunk_id string, line_no int, depth double")
    return found.groupBy("chunk_id", "line_no").agg(F.max("depth").alias("depth"))
