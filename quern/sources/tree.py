"""A data source that reads trees of Python files: `spark.read.format("pytree").load(root)`.

Spark's own file sources leave out names that begin with `_` or `.` and empty files; this one reads every
regular file with the suffix .py in any case. Paths are canonical (symbolic links resolved). A filter
`path = '...'` is pushed into the listing if spark.sql.python.filterPushdown.enabled is true.

The paths must be visible to the executors (a mounted file system).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

#: Files and bytes that one task reads at most (a larger file is a task of its own).
FILES_PER_TASK, BYTES_PER_TASK = 512, 32 << 20


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def python_files(root: str) -> Iterator[str]:
    """Canonical paths of the Python files at or below a path."""
    top = Path(root.strip()).expanduser()
    if top.is_file():
        found = [str(top)]
    else:
        found = (os.path.join(folder, name) for folder, _, names in os.walk(top) for name in names)
    for path in found:
        if path.lower().endswith(".py") and os.path.isfile(path):
            yield os.path.realpath(path)


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots, self.only = roots, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",) and self.only is None:
                self.only = f.value
            else:
                yield f

    def partitions(self):
        if self.only is not None:
            inside = any(self.only == r or self.only.startswith(r.rstrip("/") + "/") for r in map(os.path.realpath, self.roots))
            paths = [*python_files(self.only)] if inside else []
        else:
            paths = sorted({p for root in self.roots for p in python_files(root)})
        out, size = [[]], 0
        for path in paths:
            n = os.path.getsize(path)
            if out[-1] and (size + n > BYTES_PER_TASK or len(out[-1]) >= FILES_PER_TASK):
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [_Files(p) for p in out]

    def read(self, partition):
        for path in partition.paths:
            try:
                yield path, Path(path).read_bytes(), None
            except OSError as e:
                yield path, None, str(e)


class PythonTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pytree"

    def schema(self) -> str:
        return "path string, content binary, error string"

    def reader(self, schema):
        return _Reader([p for p in self.options["path"].split(os.pathsep) if p])


def sources(spark: SparkSession, *roots: str) -> DataFrame:
    """file_path, raw (the text as it is, null if not UTF-8), text (line ends normal) and error of each file."""
    spark.dataSource.register(PythonTree)
    files = spark.read.format("pytree").load(os.pathsep.join(roots))
    # The cast keeps bytes that aren't UTF-8, so they are tested first.
    raw = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    text = F.regexp_replace(raw, "\r\n?", "\n")
    error = F.coalesce("error", F.when(F.col("content").isNotNull() & raw.isNull(), F.lit("not valid UTF-8")))
    return files.select(F.col("path").alias("file_path"), raw.alias("raw"), text.alias("text"), error.alias("error"))
