"""Data source ``coderepo``: the source files of a directory tree.

Spark's file sources leave out names that start with ``_``, which holds
``__init__.py``. This source lists directories itself: a partition is a
directory or a subtree, hidden and ignored directories are pruned, and links that lead out
of the tree are left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pyspark.sql.types import StringType, StructField, StructType

from loamdex.functions.text import LANGUAGES

#: Partitions that a tree is cut into before whole subtrees are left together.
SPLIT = 64

# Directories that are never scanned.
IGNORED = ["node_modules", ".git", ".venv", "venv", "__pycache__", ".tox", "dist", "build", "*.pyc"]


def ignored(name: str, patterns: list[str] | None = None) -> bool:
    """Hidden, equal to a pattern, or ending as a pattern with a star says."""
    return name.startswith(".") or any(name == p or p.startswith("*") and name.endswith(p[1:]) for p in patterns or IGNORED)


def source_files(top: str, root: str, deep: bool = True) -> Iterator[tuple[str, str]]:
    """``(path, language)`` of the files below ``top``, by path."""
    real_root = os.path.realpath(root)
    for folder, dirs, names in os.walk(top):
        dirs[:] = sorted(d for d in dirs if not ignored(d)) if deep else []
        for n in sorted(names):
            language = LANGUAGES.get(os.path.splitext(n)[1].lower())
            path = os.path.join(folder, n)
            real = os.path.realpath(path)
            if language and not n.startswith(".") and os.path.isfile(real) and os.path.commonpath([real, real_root]) == real_root:
                yield path, language


def _subfolders(folder: str) -> list[str]:
    return sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and not ignored(e.name))


def path_ignored(path: Column, patterns: list[str] | None = None) -> Column:
    """Whether any part of a path is ignored, as ``ignored`` tells of a name."""
    one = lambda x: F.startswith(x, F.lit(".")) | x.isin(*[p for p in patterns or IGNORED if p[0] != "*"]) | reduce(lambda a, b: a | b, (F.endswith(x, F.lit(p[1:])) for p in patterns or IGNORED if p[0] == "*"), F.lit(False))
    return F.exists(F.filter(F.split(path, "/"), lambda x: x != ""), one)


def read_files(listed: DataFrame) -> DataFrame:
    """``listed`` (with ``file_path``) and the ``content`` of just these files; unreadable ones are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [text_of(p) for p in b["file_path"]]
            yield b.assign(content=pd.Series(text, dtype=object, index=b.index))[[x is not None for x in text]]

    schema = StructType([*listed.schema.fields, StructField("content", StringType())])
    return listed.mapInPandas(run, schema)


def text_of(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()
    except (OSError, UnicodeDecodeError):
        return None


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, with_content: bool):
        self.root, self.with_content = root, with_content

    def partitions(self) -> list[_Folder]:
        """Folders are taken apart level by level until there are ``SPLIT`` of them or none is left."""
        flat, deep = [], [self.root]
        while deep and len(flat) + len(deep) < SPLIT:
            flat, deep = flat + deep, [p for d in deep for p in _subfolders(d)]
        return [*(_Folder(p, False) for p in flat), *(_Folder(p, True) for p in deep)]

    def read(self, part: _Folder) -> Iterator[tuple]:
        for path, language in source_files(part.path, self.root, part.deep):
            s = os.stat(path)
            content = text_of(path) if self.with_content else None
            if self.with_content and content is None:
                continue  # unreadable files are no source files
            yield path, int(s.st_size), float(s.st_mtime), content, language


class CodeRepo(DataSource):
    """Options: ``path``, and ``content`` (true or false; without it only names, sizes and times are read)."""

    @classmethod
    def name(cls) -> str:
        return "coderepo"

    def schema(self) -> str:
        return "file_path string, size bigint, mtime double, content string, language string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("content", "true").lower() == "true")
