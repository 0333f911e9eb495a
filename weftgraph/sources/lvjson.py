"""Datasets as one JSON document: sheets with rows and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators.dataset import EDGES, NODES, canonical_labels, validate_dataset
from weftgraph.sources.results import read_bounded
from weftgraph.sources.xlsx import read_xlsx

MAX_JSON_BYTES = 64 * 1024 * 1024

ROW = T.StructType([f for f in NODES if f.name not in ("sheet_index", "row_ord")])
EDGE = T.StructType([f for f in EDGES if f.name not in ("sheet_index", "edge_ord")])
DOCUMENT = T.StructType([T.StructField("sheets", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("rows", T.ArrayType(ROW)), T.StructField("edges", T.ArrayType(EDGE))]))), T.StructField("all_labels", T.ArrayType(T.StringType()))])


def to_json(nodes: DataFrame, edges: DataFrame, sheets: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, `value`: the dataset as a document. sheets: (sheet_index, name); labels: (label_ord, label)."""
    packed = lambda df, order, fields, out: df.groupBy("sheet_index").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("r")))).alias("_l")).select("sheet_index", F.transform("_l", lambda x: x["r"]).alias(out))
    rows, links = packed(nodes, "row_ord", ROW.names, "rows"), packed(edges, "edge_ord", EDGE.names, "edges")
    joined = sheets.join(rows, "sheet_index", "left").join(links, "sheet_index", "left")
    one = joined.agg(F.array_sort(F.collect_list(F.struct("sheet_index", "name", "rows", F.coalesce("edges", F.array().cast(T.ArrayType(EDGE))).alias("edges")))).alias("_s"))
    names = labels.agg(F.transform(F.array_sort(F.collect_list(F.struct("label_ord", "label"))), lambda x: x["label"]).alias("all_labels"))
    return one.crossJoin(names).select(F.to_json(F.struct(F.transform("_s", lambda s: F.struct(s["name"].alias("name"), s["rows"].alias("rows"), s["edges"].alias("edges"))).alias("sheets"), "all_labels")).alias("value"))


def write_json(nodes: DataFrame, edges: DataFrame, sheets: DataFrame, labels: DataFrame, path: str) -> None:
    to_json(nodes, edges, sheets, labels).write.mode("overwrite").text(path)


def from_json(document: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and sheets of rows of `value`."""
    sheets = document.select(F.from_json("value", DOCUMENT).alias("d")).select(F.posexplode("d.sheets").alias("sheet_index", "s"))
    nodes = sheets.select("sheet_index", F.posexplode("s.rows").alias("row_ord", "r")).select("sheet_index", "row_ord", "r.*")
    edges = sheets.select("sheet_index", F.posexplode("s.edges").alias("edge_ord", "r")).select("sheet_index", "edge_ord", "r.*")
    return nodes, edges, sheets.select("sheet_index", "s.name")


def read_json(spark: SparkSession, path: str, max_bytes: int = MAX_JSON_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and sheets of a file of at most `max_bytes`; rows that break a rule fail. Labels are not read but made anew by `canonical_labels`."""
    nodes, edges, sheets = from_json(read_bounded(spark, path, max_bytes))
    broken = validate_dataset(nodes, edges, canonical_labels(nodes)).limit(5).collect()
    if broken:
        raise ValueError("; ".join(f"sheet {x.sheet_index}, row {x.row}: {x.message}" for x in broken))
    return nodes, edges, sheets


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a .json file, or of a workbook by any other name."""
    if path.lower().endswith(".json"):
        return read_json(spark, path)[:2]
    nodes, edges = read_xlsx(spark, path)
    return nodes.drop("path"), edges.drop("path")


def headless_json(coords: DataFrame, names: DataFrame) -> DataFrame:
    """(step, value): for each step its stress and every node's place as JSON."""
    dim = lambda k: F.coalesce(F.get("coord", F.lit(k)), F.lit(0.0))
    rows = coords.join(names, "i").select("step", "stress", "i", F.struct("label", dim(0).alias("x"), dim(1).alias("y"), dim(2).alias("z")).alias("c"))
    grouped = rows.groupBy("step", "stress").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("coordinates"))
    return grouped.select("step", F.to_json(F.struct("step", "stress", "coordinates")).alias("value"))
