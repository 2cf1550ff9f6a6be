"""A stream of files is reviewed once for each content.

The state is a key for each (path, hash) seen within the watermark; findings are
appended, so a restart from the checkpoint repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievelake.functions.text import content_hash
from sievelake.operators import js_rules, py_rules

FILE = "path string, content string, seen timestamp"


def arrivals(spark: SparkSession, folder: str, schema: str = FILE) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def fresh(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each (path, hash) once; late copies of up to `delay` are recognised."""
    return files.withColumn("hash", content_hash(F.col("content"))).withWatermark("seen", delay).dropDuplicatesWithinWatermark(["path", "hash"])


def findings(files: DataFrame) -> DataFrame:
    """Findings of the house rules in the files of a batch or stream; all lines are in scope."""
    rows = files.withColumn("changed_lines", F.lit(None).cast("array<int>"))
    keep = ("path", "hash", "changed_lines")
    a = py_rules.rules(py_rules.nodes(rows.where(F.col("path").endswith(".py")), keep=keep), keep).drop("node_id")
    script = rows.where(F.col("path").endswith(".js"))
    return a.unionByName(js_rules.line_rules(script, keep=keep)).unionByName(js_rules.call_rule(script, keep=keep))


def review(files: DataFrame, sink: str, checkpoint: str, progress: Callable[[int, int], None] | None = None, delay: str = "1 day") -> StreamingQuery:
    """Appends the findings of all available files to Parquet; progress(batch, rows) is told of each batch."""

    def write(batch: DataFrame, n: int) -> None:
        rows = findings(batch).withColumn("batch", F.lit(n))
        rows.write.mode("overwrite").parquet(f"{sink}/batch={n}")
        if progress:
            progress(n, batch.sparkSession.read.parquet(f"{sink}/batch={n}").count())

    return fresh(files, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
