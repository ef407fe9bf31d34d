"""The index: six Parquet tables by bucket of the file's path, refreshed by content hash.

A refresh reads the hashes, drops unchanged files before the parser, parses the rest once, and
rewrites only the buckets that hold a changed file, into a folder of its own. The manifest that
names each bucket's folder is then replaced in one step, so a reader sees the old tables or the new ones. Folders that a refresh
replaces are removed by the next one that changes anything, so readers of the tables before it can finish; what a failed
refresh leaves goes with `vacuum`. A file that can't be parsed keeps its rows. A manifest of another layout means that the index is
built again; another Python version, whose parser may see other things, has an index of its own beside it.
"""

from __future__ import annotations

import json
import sys
import uuid
import zlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.parsing import content_hash, parsed
from ..schemas import CHILD_TABLES, SCHEMA_VERSION, TABLES, schema_of
from .staging import durable

BUCKETS = 64
#: Files of a bucket that one task writes.
FILES_A_TASK = 20_000


def bucket_of(path: str, buckets: int) -> int:
    return zlib.crc32(path.encode()) % buckets


def _bucket(path: Column, buckets: int) -> Column:
    return (F.crc32(path.cast("binary")) % buckets).cast("int")


def tables_from(sources: DataFrame, staged: bool = False) -> dict[str, DataFrame]:
    """The six tables straight from sources (file_path, text), without an index on disk.

    Unstaged, each table that is used parses for itself, which is best for one table. Staged, files are parsed once, by
    file, and what the tables share is kept; joins and groups by file then need no further shuffle of them.
    """
    rows = sources.select("file_path", "text", parsed(F.col("text")).alias("p"))
    rows = rows.select("file_path", content_hash(F.col("text")).alias("content_hash"), "p")
    return fan_out(durable(rows.repartition("file_path")) if staged else rows)


def fan_out(rows: DataFrame) -> dict[str, DataFrame]:
    """Rows of file_path, content_hash and the parser's result, as tables."""
    good = rows.where("p.ok")
    out = {"files": good.select("file_path", "content_hash")}
    for table in CHILD_TABLES:
        # inline_outer lets filters on file_path through and evaluates the parser once; see the plan tests.
        wide = rows.select("file_path", F.inline_outer(f"p.{table}")).where("ord is not null")
        out[table] = wide.select(*schema_of(table).fieldNames())
    return out


class Index:
    """An index in a folder that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        hadoop = spark._jvm.org.apache.hadoop
        self._path = lambda p: hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        manifest = self._manifest()
        if manifest is not None and manifest["python"] != self._python():
            # Others may read that one: it stays.
            self.root += f"/python-{self._python()}"
            manifest = self._manifest()
        if manifest is None or manifest["schema_version"] != SCHEMA_VERSION:
            self.reset()

    @staticmethod
    def _python() -> str:
        return f"{sys.version_info.major}.{sys.version_info.minor}"

    def _manifest(self) -> dict | None:
        path = self._path(f"{self.root}/manifest.json")
        if not self._fs.exists(path):
            return None
        rows = self.spark.read.text(f"{self.root}/manifest.json", wholetext=True).collect()
        return json.loads(rows[0][0]) if rows else None

    def _publish(self, manifest: dict) -> None:
        temporary = self._path(f"{self.root}/.manifest-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop
        context = hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark._jsc.hadoopConfiguration()) if temporary.toUri().getScheme() else hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(hadoop.fs.Options.Rename, 1)
        options[0] = hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, self._path(f"{self.root}/manifest.json"), options)

    def reset(self) -> None:
        """Drops all tables and starts an empty index."""
        self._fs.delete(self._path(self.root), True)
        self._fs.mkdirs(self._path(self.root))
        self._publish({"schema_version": SCHEMA_VERSION, "python": self._python(), "buckets": self.buckets, "parts": {t: {} for t in TABLES}, "retired": []})

    def tables(self, paths: list[str] | None = None) -> dict[str, DataFrame]:
        """The six tables; of the given files only, reading just their buckets."""
        manifest = self._manifest()
        wanted = None if paths is None else {str(bucket_of(p, manifest["buckets"])) for p in paths}
        out = {}
        for table in TABLES:
            parts = [p for b, p in manifest["parts"][table].items() if wanted is None or b in wanted]
            schema = schema_of(table)
            df = self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], schema)
            out[table] = df if paths is None else df.where(F.col("file_path").isin(paths))
        return out

    def content_hash(self, path: str) -> str | None:
        row = self.tables([path])["files"].first()
        return row and row["content_hash"]

    def _bucketed(self, manifest: dict, table: str, buckets: list[int]) -> DataFrame:
        """A table's rows in some buckets, reading those only."""
        parts = [f"{self.root}/{manifest['parts'][table][str(b)]}" for b in buckets if str(b) in manifest["parts"][table]]
        schema = schema_of(table)
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _remove(self, parts: list[str]) -> None:
        """Removes folders of buckets, and refreshes' folders that then have none."""
        for part in parts:
            self._fs.delete(self._path(f"{self.root}/{part}"), True)
        for top in {p.split("/")[0] for p in parts}:
            path = self._path(f"{self.root}/{top}")
            if self._fs.exists(path) and not any(b.isDirectory() for t in self._fs.listStatus(path) if t.isDirectory() for b in self._fs.listStatus(t.getPath())):
                self._fs.delete(path, True)

    def vacuum(self) -> None:
        """Removes all that neither the tables nor their last readers use. Not to be run beside a refresh."""
        manifest = self._manifest()
        used = {p for parts in manifest["parts"].values() for p in parts.values()} | set(manifest["retired"])
        for top in self._fs.listStatus(self._path(self.root)):
            name = top.getPath().getName()
            if name.startswith("staged-"):
                self._fs.delete(top.getPath(), True)
            elif name.startswith("part-"):
                for table in (x for x in self._fs.listStatus(top.getPath()) if x.isDirectory()):
                    found = [f"{name}/{table.getPath().getName()}/{x.getPath().getName()}" for x in self._fs.listStatus(table.getPath()) if x.isDirectory()]
                    self._remove([p for p in found if p not in used])

    def refresh(self, sources: DataFrame) -> DataFrame:
        """Brings the files of sources (file_path, text) up to date: file_path, changed, error (null, or type, line, msg).

        Only the buckets of these files are read. A path that comes with several texts keeps its rows and has an error; one
        that comes several times with the same text counts once.
        """
        manifest, name = self._manifest(), uuid.uuid4().hex
        buckets = manifest["buckets"]
        now = sources.select("file_path", "text", content_hash(F.col("text")).alias("content_hash"))
        paths = durable(now.groupBy("file_path").agg(F.count("*").alias("times"), F.min(F.coalesce("content_hash", F.lit(""))).alias("low"), F.max(F.coalesce("content_hash", F.lit(""))).alias("high")))
        asked = [r[0] for r in paths.select(_bucket(F.col("file_path"), buckets)).distinct().collect()]  # at most `buckets`
        same = F.col("file_path").eqNullSafe(F.col("__p")) & F.col("content_hash").eqNullSafe(F.col("__h"))
        stored = self._bucketed(manifest, "files", asked).select(F.col("file_path").alias("__p"), F.col("content_hash").alias("__h"))
        fresh = now.join(stored, same, "left_anti")
        several = paths.where("low <> high").select("file_path")
        if not (clear := several.isEmpty()):
            fresh = fresh.join(several, "file_path", "left_anti")
        staged = f"{self.root}/staged-{name}"
        fresh.select("file_path", "content_hash", parsed(F.col("text")).alias("p")).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        if not paths.where("times > 1").isEmpty():
            rows = rows.dropDuplicates(["file_path"])
        good = rows.where("p.ok").select("file_path")
        sizes = {r[0]: r[1] for r in good.groupBy(_bucket(F.col("file_path"), buckets)).count().collect()}  # at most `buckets`
        touched = [*sizes]
        if touched:
            new, retired = fan_out(rows), []
            # A large bucket is written by several tasks, a file's rows by one.
            part = F.pmod(F.xxhash64("file_path"), F.lit(-(-max(sizes.values()) // FILES_A_TASK)))
            for table in TABLES:
                parts = manifest["parts"][table]
                kept = self._bucketed(manifest, table, touched).join(good, "file_path", "left_anti")
                whole = kept.unionByName(new[table]).withColumn("bucket", _bucket(F.col("file_path"), buckets))
                folder = f"part-{name}/{table}"
                order = ["bucket", "file_path"] + (["start_line", "ord"] if table != "files" else [])
                whole.repartition("bucket", part).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
                for b in touched:
                    if old := parts.pop(str(b), None):
                        retired.append(old)
                    if self._fs.exists(self._path(f"{self.root}/{folder}/bucket={b}")):
                        parts[str(b)] = f"{folder}/bucket={b}"
            before, manifest["retired"] = manifest.get("retired", []), retired
            self._publish(manifest)
            self._remove(before)
        result = rows.select("file_path", F.col("p.ok").alias("changed"), F.col("p.error").alias("error"))
        every = paths.select("file_path").join(result, "file_path", "left").select("file_path", F.coalesce("changed", F.lit(False)).alias("changed"), "error")
        if not clear:
            told = F.struct(F.lit("ValueError").alias("type"), F.lit(None).cast("int").alias("line"), F.lit("several texts for one path").alias("msg"))
            every = every.join(several.withColumn("__several", F.lit(True)), "file_path", "left").withColumn("error", F.when(F.col("__several"), told).otherwise(F.col("error"))).drop("__several")
        every = durable(every)
        self._fs.delete(self._path(staged), True)
        return every
