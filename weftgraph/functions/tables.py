"""Opening the input tables of a dataset folder, and tables written on the way."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a batch of texts on its way to Python.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table `name` of the dataset folder, opened by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, removed when the driver's JVM ends.

    The folder is spark.checkpoint.dir; only a local session may do without and gets a folder of the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/weftgraph-files-{os.getuid()}"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it again: computed once however often it is used, and safe from lost executors."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Hold fewer texts in memory at once on their way to Python than Spark's batch of 10,000 rows, in a session that has not set a number itself."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores where its scan has fewer tasks than those, as with one small file; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
