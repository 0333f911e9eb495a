"""Datasets of labelled objects over time: sheets are time points, with rows of objects and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHAPES = ("sphere", "torus", "cube", "cylinder", "pyramid", "point")
# Columns, their types and defaults, shapes, and the limits that validation knows.
NODES = T.StructType([
    T.StructField("sheet_index", T.IntegerType()), T.StructField("row_ord", T.IntegerType()), T.StructField("label", T.StringType()),
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("z", T.DoubleType()), T.StructField("size", T.DoubleType()), T.StructField("size_alpha", T.DoubleType()),
    T.StructField("spin_x", T.DoubleType()), T.StructField("spin_y", T.DoubleType()), T.StructField("spin_z", T.DoubleType()), T.StructField("shape", T.StringType()),
    T.StructField("color_r", T.FloatType()), T.StructField("color_g", T.FloatType()), T.StructField("color_b", T.FloatType()),
    T.StructField("note", T.IntegerType()), T.StructField("instrument", T.IntegerType()), T.StructField("channel", T.IntegerType()), T.StructField("velocity", T.IntegerType()),
    T.StructField("cluster_value", T.DoubleType()), T.StructField("beats", T.LongType()),
])
EDGES = T.StructType([T.StructField("sheet_index", T.IntegerType()), T.StructField("edge_ord", T.IntegerType()), T.StructField("from", T.StringType()), T.StructField("to", T.StringType()), T.StructField("strength", T.DoubleType())])
DEFAULTS = {"x": 0.0, "y": 0.0, "z": 0.0, "size": 1.0, "size_alpha": 0.0, "spin_x": 0.0, "spin_y": 0.0, "spin_z": 0.0, "shape": "sphere", "color_r": 1.0, "color_g": 1.0, "color_b": 1.0, "note": 60, "instrument": 0, "channel": 0, "velocity": 64, "cluster_value": 0.0, "beats": 0}


def with_defaults(rows: DataFrame) -> DataFrame:
    """`rows` with all columns of NODES, defaults where they have none."""
    have = set(rows.columns)
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(DEFAULTS[f.name])).cast(f.dataType).alias(f.name) for f in NODES))


def shape_id(shape: Column) -> Column:
    """0 to 5 for the known shapes, spaces and case aside; null for others."""
    place = F.array_position(F.array(*map(F.lit, SHAPES)), F.lower(F.trim(shape)))
    return F.when(place > 0, (place - 1).cast("int"))


def canonical_labels(nodes: DataFrame) -> DataFrame:
    """(label_ord, label): all labels in the order in which they first stand."""
    first = nodes.groupBy("label").agg(F.min(F.struct("sheet_index", "row_ord")).alias("at")).select("label", "at.*")
    sheets = first.groupBy("sheet_index").agg(F.count(F.lit(1)).alias("n"))  # sheets are few, labels are not
    before = F.sum("n").over(Window.orderBy("sheet_index").rowsBetween(Window.unboundedPreceding, -1))
    starts = sheets.select("sheet_index", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("sheet_index").orderBy("row_ord", "label"))
    return first.join(starts, "sheet_index").select((F.col("start") + inside - 1).cast("int").alias("label_ord"), "label")


def sorted_labels(nodes: DataFrame) -> DataFrame:
    """(label_ord, label): all labels in alphabetical order, as a dataset without a window on it is numbered."""
    labels = nodes.select("label").distinct().withColumn("head", F.substring("label", 1, 2))
    heads = labels.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1))
    starts = heads.select("head", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("head").orderBy("label"))
    return labels.join(starts, "head").select((F.col("start") + inside - 1).cast("int").alias("label_ord"), "label")


def last_rows(nodes: DataFrame) -> DataFrame:
    """One row for each label of a sheet: of several the last stands."""
    return nodes.withColumn("_r", F.row_number().over(Window.partitionBy("sheet_index", "label").orderBy(F.desc("row_ord")))).where("_r = 1").drop("_r")


def _strange(name: str) -> Column:
    return F.isnan(name) | (F.abs(F.col(name)) == float("inf"))


def validate_rows(nodes: DataFrame) -> DataFrame:
    """(sheet_index, row, message): every rule that every row breaks; rows count from 1."""
    checks = [
        (F.octet_length("label") == 0, "label is empty"), (F.octet_length("label") > 255, "label is longer than 255 bytes"),
        *((_strange(c), f"{c} is not finite") for c in ("x", "y", "z", "spin_x", "spin_y", "spin_z")),
        (_strange("size") | (F.col("size") <= 0), "size is not above 0"), (_strange("size_alpha") | (F.col("size_alpha") < 0), "size_alpha is below 0"),
        *((F.isnan(c) | ~F.col(c).between(0, 1), f"{c} is outside 0 to 1") for c in ("color_r", "color_g", "color_b")),
        (F.col("note") > 127, "note is above 127"), (F.col("instrument") > 365, "instrument is above 365"), (F.col("channel") > 15, "channel is above 15"),
        (~F.col("velocity").between(1, 127), "velocity is outside 1 to 127"), (_strange("cluster_value") | (F.col("cluster_value") < 0), "cluster_value is below 0"),
    ]
    found = F.array_compact(F.array(*(F.when(bad, F.lit(message)) for bad, message in checks)))
    return nodes.select("sheet_index", (F.col("row_ord") + 1).alias("row"), F.explode(found).alias("message"))


def validate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sheet_index, edge, message): ends that the sheet doesn't have, and strengths that are not finite."""
    known = lambda key, flag: nodes.select("sheet_index", F.col("label").alias(key)).distinct().withColumn(flag, F.lit(True))
    joined = edges.join(known("from", "_f"), ["sheet_index", "from"], "left").join(known("to", "_t"), ["sheet_index", "to"], "left")
    found = F.array_compact(F.array(F.when(F.col("_f").isNull(), "from is not in the sheet"), F.when(F.col("_t").isNull(), "to is not in the sheet"), F.when(_strange("strength"), "strength is not finite")))
    return joined.select("sheet_index", (F.col("edge_ord") + 1).alias("edge"), F.explode(found).alias("message"))


def validate_dataset(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(sheet_index, row, message) of all sheets, a sheet's edges numbered on from its rows, and of labels that are not the canonical ones: sheet -1, row 0."""
    sizes = nodes.groupBy("sheet_index").agg(F.count(F.lit(1)).alias("n"))
    linked = validate_edges(edges, nodes).join(sizes, "sheet_index", "left").select("sheet_index", (F.coalesce("n", F.lit(0)) + F.col("edge")).cast("int").alias("row"), "message")
    canonical = canonical_labels(nodes).withColumnRenamed("label_ord", "_c")
    differing = canonical.join(labels.select("label", "label_ord"), "label", "full_outer").where(~F.col("_c").eqNullSafe(F.col("label_ord")))
    odd = differing.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(-1).alias("sheet_index"), F.lit(0).alias("row"), F.lit("labels are not in the order in which they first stand").alias("message"))
    return validate_rows(nodes).union(linked).union(odd)


def validate_sheet(nodes: DataFrame, edges: DataFrame, sheet: int) -> DataFrame:
    """(sheet_index, row, message) of one sheet."""
    own = nodes.where(F.col("sheet_index") == sheet)
    return validate_dataset(own, edges.where(F.col("sheet_index") == sheet), canonical_labels(own))


def cluster_filter(nodes: DataFrame, least: float, most: float) -> DataFrame:
    return nodes.where(F.col("cluster_value").between(least, most))


def cluster_range(nodes: DataFrame) -> DataFrame:
    """(low, high): the span of cluster values, which takes in 0 and 1."""
    return nodes.agg(F.least(F.min("cluster_value"), F.lit(0.0)).alias("low"), F.greatest(F.max("cluster_value"), F.lit(1.0)).alias("high"))


def object_override(nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace shape, size and colours where `overrides` (label, shape, size, color_r, color_g, color_b) gives them."""
    changed = ("shape", "size", "color_r", "color_g", "color_b")
    given = overrides.select("label", *(F.col(c).alias(f"_{c}") for c in changed))
    joined = nodes.join(given, "label", "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in changed else F.col(c) for c in nodes.columns))


def adjacency(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(step, i, j, w) over the labels' numbers; of edges between the same ends the last stands."""
    last = edges.groupBy("sheet_index", "from", "to").agg(F.max_by("strength", "edge_ord").alias("w"))
    end = lambda key, out: labels.select(F.col("label").alias(key), F.col("label_ord").alias(out))
    return last.join(end("from", "i"), "from").join(end("to", "j"), "to").select(F.col("sheet_index").alias("step"), "i", "j", "w")


def dropped_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(sheet_index, from, to) of edges with an end that is no label."""
    end = lambda key: labels.select(F.col("label").alias(key))
    lost = edges.join(end("from"), "from", "left_anti").unionByName(edges.join(end("to"), "to", "left_anti"))
    return lost.select("sheet_index", "from", "to").distinct()


def preserve_metadata(moved: DataFrame, source: DataFrame) -> DataFrame:
    """New places (sheet_index, label, x, y, z) with all else of the source's row, or defaults."""
    own = last_rows(source).drop("x", "y", "z", "row_ord")
    joined = moved.join(own, ["sheet_index", "label"], "left")
    return joined.select(*(F.coalesce(F.col(c), F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in joined.columns))


def lv_dataset(coords: DataFrame, names: DataFrame) -> DataFrame:
    """NODES from coordinates (step, i, coord) and names (i, label): the first three dimensions, missing ones 0."""
    dim = lambda k: F.coalesce(F.get("coord", F.lit(k)), F.lit(0.0))
    sheet = F.dense_rank().over(Window.orderBy("step")) - 1
    steps = coords.select("step").distinct().withColumn("sheet_index", sheet)
    rows = coords.join(F.broadcast(steps), "step").join(names, "i").select("sheet_index", F.col("i").alias("row_ord"), "label", dim(0).alias("x"), dim(1).alias("y"), dim(2).alias("z"))
    return with_defaults(rows)
