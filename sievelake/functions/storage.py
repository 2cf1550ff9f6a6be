"""Where intermediate results are kept, so that they outlive lost executors, and how big inputs are."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows of a few numbers up to which a side is broadcast; a larger one is joined by a shuffle.
SMALL = 200_000
#: Bytes of input for each partition of a range sort, and the most partitions asked for (the sampled bounds go through the driver).
PART_BYTES, PARTS = 256 << 20, 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where all are one machine, a folder is made if none is named."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir isn't set: it has to name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="sievelake-")
        spark.sparkContext.setCheckpointDir(where)
        where = f"file://{where}"
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df computed once and stored in the shared folder: later steps don't depend on executors that may go."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder in whatever store it lies; one that isn't there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df is made of, as the optimizer knows them (joins don't multiply them); what doesn't come from files counts for nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [x for x in (leaves.apply(k) for k in range(leaves.size())) if x.nodeName() != "LogicalRDD"]
    return sum(n for n in (int(str(x.stats().sizeInBytes())) for x in files) if n < 1 << 60)


def range_parts(df: DataFrame) -> int:
    """How many partitions a range sort of df's rows needs: the session's number of shuffle partitions, and more for inputs of over PART_BYTES times it.

    An explicit number isn't adapted at run time, so it has to come from the size of the input.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(PARTS, -(-input_bytes(df) // PART_BYTES)))
