"""Shared plumbing of the training-data operators: staged tables, gapless ranks, components."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Second seed of the 128-bit text identity.
SECOND_SEED = 7919
#: Rows of a batch of texts on its way to Python, where a session leaves that at Spark's default.
BATCH_ROWS = 1_000
#: Keys that may be broadcast since each has more than one row in so many.
HOT_KEYS = 2_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without; it gets a folder of the machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/weftgraph-shared-{os.getuid()}"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage ends there and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Hold fewer texts in memory at once than Spark's default batch of 10,000 rows, in a session that has not set a number itself."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_ROWS))


def text_key(text: Column) -> list[Column]:
    """128-bit identity of a text as two longs."""
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(text, F.lit(SECOND_SEED)).alias("_h2")]


def without(df: DataFrame, produced: list[str]) -> list[str]:
    """Columns of `df` that an operator can carry beside those it makes; its own win a clash of names."""
    taken = {x.lower() for x in produced}
    return [x for x in df.columns if x.lower() not in taken]


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], out: str, n_rows: int, rows_per_cell: int = 20_000) -> DataFrame:
    """Number the rows of each key from 0 without gaps, whatever share of the rows one key holds.

    A key's rows are dealt into cells by a hash of `order`; cells get running offsets from
    their counts, and only a cell is ranked in one task. `df` must give the same rows each time.
    """
    cells = max(1, min(65_536, math.ceil(n_rows / rows_per_cell)))
    mine = [x for x in df.columns if x != out]
    cell, start, count = (f"_{x}_{uuid.uuid4().hex}" for x in ("cell", "start", "n"))  # clash with no column of `df`
    dealt = df.select(*mine, F.pmod(F.xxhash64(*order), F.lit(cells)).alias(cell))
    running = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias(count))
    starts = counts.withColumn(start, F.coalesce(F.sum(count).over(running), F.lit(0))).drop(count)
    inside = Window.partitionBy(*keys, cell).orderBy(*order)
    ranked = dealt.join(starts, [*keys, cell]).withColumn(out, F.col(start) + F.row_number().over(inside) - 1)
    return ranked.select(*mine, out)


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], count: str, name: str, how: str = "inner") -> DataFrame:
    """Join `rows` with `counted`, which has each key once and says how many of the rows have it, whatever share one key holds.

    Fewer than HOT_KEYS keys can have more than a HOT_KEYS-th of the rows; these are broadcast, only
    the others are dealt by key. how: inner or left_semi. Both sides must give the same rows each time.
    """
    known = stage(counted, name)
    total = known.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(known.where(F.col(count) * HOT_KEYS > total).drop(count))
    rest = known.where(F.col(count) * HOT_KEYS <= total).drop(count)
    return rows.join(hot, keys, how).unionByName(rows.join(hot, keys, "left_anti").join(rest, keys, how))


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Connected components of the links (a, b): rows (id, component), component the smallest id reachable.

    Labels spread to the smallest neighbour and then jump to their label's label, so that the
    rounds grow with the logarithm of a component's width. Each round is a staged table. Ids
    without a link are not in the result.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = stage(pairs.union(pairs.select("y", "x")).distinct(), f"{name}-links")
    labels = stage(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")), f"{name}-labels")
    while True:
        heard = both.join(labels.withColumnsRenamed({"x": "y"}), "y").groupBy("x").agg(F.min("l").alias("m"))
        spread = labels.join(heard, "x").select("x", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        hop = labels.select(F.col("x").alias("l"), F.col("l").alias("further"))
        jumped = spread.join(hop, "l", "left").select("x", "old", F.least("l", F.coalesce("further", "l")).alias("l"))
        after = stage(jumped, f"{name}-labels")
        moved = after.where("l <> old").limit(1).count()
        labels = after.select("x", "l")
        if not moved:
            return labels.select(F.col("x").alias("id"), F.col("l").alias("component"))
