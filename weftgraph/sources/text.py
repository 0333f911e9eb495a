"""Text files as corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_TEXT_BYTES = 32 * 1024 * 1024


def _texts(files: DataFrame, max_bytes: int) -> DataFrame:
    """(path, label, text) of files as bytes: too large or not UTF-8 is an error where the text is read."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    text = F.when(F.col("length") <= max_bytes, F.validate_utf8(F.col("content").cast("string"))).otherwise(F.raise_error(F.concat(F.lit("file too large: "), F.col("path"))))
    return files.select("path", F.when(stem == "", "slice").otherwise(stem).alias("label"), text.alias("text"))


def text_sources(spark: SparkSession, path: str, max_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """(path, label, text) of the .txt files of a folder, not of its subfolders, or of one file; label: the name without its ending, or "slice".

    A file above `max_bytes`, or one that is not UTF-8, fails the query where its text is read.
    """
    return _texts(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "false").load(path), max_bytes)


def mixed_sources(spark: SparkSession, paths: list[str], max_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """(source_ord, path, label, text) of files and folders in the order given: of a folder its .txt files by name, empty ones left out; files as they are."""
    context = spark.sparkContext
    parts = []
    for k, path in enumerate(paths):
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        folder = target.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
        own = text_sources(spark, path, max_bytes).where(F.btrim("text") != "") if folder else _texts(spark.read.format("binaryFile").load(path), max_bytes)
        parts.append(own.withColumn("_input", F.lit(k)))
    every = reduce(DataFrame.union, parts)
    order = every.select("_input", "path").withColumn("source_ord", F.row_number().over(Window.orderBy("_input", "path")) - 1)  # files are few
    return every.join(order, ["_input", "path"]).select("source_ord", "path", "label", "text")


def one_corpus(sources: DataFrame) -> DataFrame:
    """`sources` as a single slice whose positions run on from file to file, as of one text with blank lines between."""
    return sources.withColumn("label", F.lit("all"))


def in_memory(spark: SparkSession, text: str, label: str = "all") -> DataFrame:
    """(source_ord, label, text) of a text at hand."""
    return spark.createDataFrame([(0, label, text)], "source_ord int, label string, text string")


def numbered(sources: DataFrame) -> DataFrame:
    """`sources` with source_ord by path; files are few, so one sort of their names is enough."""
    order = sources.select("path").withColumn("source_ord", F.row_number().over(Window.orderBy("path")) - 1)
    return sources.join(order, "path")


def adjacency_csv(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, w) from a table with a header of labels and a label before each row; cells that are no number are 0."""
    wide = spark.read.option("header", "true").csv(path)
    label, *others = wide.columns
    long = wide.unpivot(label, others, "dst", "v")
    return long.select(F.col(label).alias("src"), "dst", F.coalesce(F.expr("try_cast(trim(v) AS DOUBLE)"), F.lit(0.0)).alias("w"))
