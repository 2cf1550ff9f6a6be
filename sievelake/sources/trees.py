"""File trees and their contents."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.text import content_hash, decoded, line_count, relative


def manifest(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """Whole-corpus targets: each path of either list once; all lines are in scope."""
    paths = tracked.select("path").union(untracked.select("path")).where(F.col("path").isNotNull()).distinct()
    return paths.select("path", F.lit("scanned").alias("status"), F.lit("").alias("diff_text"), F.lit(None).cast("array<int>").alias("changed_lines"), F.lit(None).cast("string").alias("old_path"))


def contents(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path (below root), content, n_lines, sha256 of the files under root."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    top = root if "://" in root else f"file:{root}"
    return with_facts(reader.load(root).select(relative(F.regexp_replace("path", "^file:/+", "file:/"), top).alias("path"), decoded(F.col("content")).alias("content")))


def with_facts(files: DataFrame) -> DataFrame:
    return files.select("path", "content", line_count(F.col("content")).alias("n_lines"), content_hash(F.col("content")).alias("sha256"))


def inside(path: Column) -> Column:
    """Whether a relative path stays below its root."""
    return ~path.rlike(r"^/|(^|/)\.\.(/|$)")


def read_targets(targets: DataFrame, files: DataFrame) -> DataFrame:
    """targets with content; null for deleted files, paths outside the root and files that aren't there."""
    joined = targets.join(files.select("path", "content"), "path", "left")
    return joined.withColumn("content", F.when((F.col("status") != "deleted") & inside(F.col("path")), F.col("content")))


#: Files read before rows are handed on.
CHUNK = 64


def read_files(targets: DataFrame, root: str) -> DataFrame:
    """targets with content, read from a work tree that all executors can see: only the files asked for are opened.

    Null for deleted files, paths (or links) that lead out of the root, and what is no regular file.
    """
    top = os.path.realpath(root)

    def load(path: str | None, wanted: bool) -> bytes | None:
        if not wanted or path is None:
            return None
        real = os.path.realpath(os.path.join(top, path))
        try:
            if real.startswith(top + os.sep) and os.path.isfile(real):
                with open(real, "rb") as f:
                    return f.read()
        except OSError:
            pass
        return None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, CHUNK):
                part = b.slice(k, CHUNK)
                data = [load(p, bool(w)) for p, w in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], ["__t", "__c"])

    rows = targets.select(F.struct(*[F.col(f"`{c}`") for c in targets.columns]).alias("__t"), F.col("path").alias("__p"), ((F.col("status") != "deleted") & inside(F.col("path"))).alias("__w"))
    read = rows.mapInArrow(run, f"__t {rows.schema['__t'].dataType.simpleString()}, __c binary")
    return read.select("__t.*", decoded(F.col("__c")).alias("content"))
