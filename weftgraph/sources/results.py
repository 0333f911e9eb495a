"""Results of the pipelines as documents and workbooks, for vocabularies and networks of a size for people, and their validation."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.xlsx import dataset_workbook, write_workbook

MAX_NETWORK_BYTES = 128 * 1024 * 1024
#: Square matrices of a text network's document and the columns of its pairs.
MATRICES = {"similarity_matrix": "similarity", "nppmi_matrix": "nppmi", "ppmi_matrix": "ppmi", "raw_counts": "cnt"}
CENTRALITIES = ("degree", "distance", "closeness", "betweenness")
TOLERANCE = 1e-12


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file, whole or not at all: written beside its place and moved there."""
    jvm = spark.sparkContext._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    files.delete(target, False)
    if not files.rename(part, target):
        raise OSError(f"could not move the new file to {path}")


def read_bounded(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(path, value) of whole text files; one of more than `most` bytes fails the query."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), "value")
    return rows.select("path", F.when(F.col("size") <= most, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("file too large: "), F.col("path")))).alias("value"))


# -- text networks -------------------------------------------------------------------------------

def network_documents(nodes: DataFrame, pairs: DataFrame, sim_to_dist: str = "linear") -> DataFrame:
    """(slice_id, value): a document for each slice, dense and row by row.

    nodes: (slice_id, idx, token, degree, distance, closeness, betweenness); pairs: (slice_id, i, j, similarity, nppmi, ppmi, cnt), missing ones 0.
    """

    def run(own: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"slice_id": [], "value": []})
        own = own.sort_values("idx")
        n = len(own)
        made: dict[str, object] = {"labels": own["token"].tolist(), "sim_to_dist": sim_to_dist, "n": n}
        for name, column in MATRICES.items():
            dense = np.zeros((n, n), np.int64 if name == "raw_counts" else float)
            dense[cells["i"], cells["j"]] = cells[column]
            made[name] = dense.ravel().tolist()
        plain = lambda column: [None if math.isnan(v) else v for v in own[column]]
        made["centrality"] = {"labels": made["labels"], **{c: plain(c) for c in CENTRALITIES}}
        return pd.DataFrame({"slice_id": [own["slice_id"].iloc[0]], "value": [json.dumps(made, ensure_ascii=False)]})

    return nodes.groupBy("slice_id").cogroup(pairs.groupBy("slice_id")).applyInPandas(run, "slice_id string, value string")


NODE_COLUMNS = "slice_id string, idx int, token string, degree double, distance double, closeness double, betweenness double"
PAIR_COLUMNS = "slice_id string, i int, j int, similarity double, nppmi double, ppmi double, cnt long"


def network_failure(document: dict) -> str | None:
    """The first rule that a text network's document breaks."""
    n, labels = document["n"], document["labels"]
    if len(labels) != n:
        return f"{len(labels)} labels for a size of {n}"
    for name in MATRICES:
        if len(document[name]) != n * n:
            return f"{name} has {len(document[name])} values for {n} labels"
    central = document["centrality"]
    if any(len(central[c]) != n for c in ("labels", *CENTRALITIES)):
        return f"centralities do not match a size of {n}"
    for name in ("similarity_matrix", "nppmi_matrix", "ppmi_matrix"):
        m = np.array([math.nan if v is None else v for v in document[name]], float).reshape(n, n)
        if not np.isfinite(m).all():
            return f"{name} is not finite"
        if name != "ppmi_matrix" and ((m < 0) | (m > 1)).any():
            return f"{name} is outside 0 to 1"
        if name != "ppmi_matrix" and (np.abs(m - m.T) > TOLERANCE).any():
            return f"{name} is not symmetric"
    for name in CENTRALITIES:
        values = np.array([math.nan if v is None else v for v in central[name]], float)
        if np.isinf(values).any() or (name != "distance" and np.isnan(values).any()):
            return f"{name} is not finite"
    return None


def read_networks(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and pairs of the documents (slice_id, value); one that breaks a rule fails the query."""

    def parsed(part: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for slice_id, value in zip(batch["slice_id"], batch["value"], strict=True):
                    doc = json.loads(value)
                    if failure := network_failure(doc):
                        raise ValueError(f"slice {slice_id}: {failure}")
                    n = doc["n"]
                    if part == 0:
                        numbers = {c: [math.nan if v is None else float(v) for v in doc["centrality"][c]] for c in CENTRALITIES}
                        yield pd.DataFrame({"slice_id": [slice_id] * n, "idx": range(n), "token": doc["labels"], **numbers})
                    else:
                        i, j = np.indices((n, n)).reshape(2, -1)
                        table = pd.DataFrame({"slice_id": slice_id, "i": i, "j": j, **{c: doc[name] for name, c in MATRICES.items()}})
                        yield table[(table[list(MATRICES.values())] != 0).any(axis=1)]

        return run

    own = documents.mapInPandas(parsed(0), NODE_COLUMNS).withColumn("distance", F.coalesce("distance", F.lit(math.nan)))  # null on the way from pandas
    return own, documents.mapInPandas(parsed(1), PAIR_COLUMNS)


def series_failures(documents: DataFrame) -> DataFrame:
    """(slice_id, message) of slices that can't be a series with the first one: other labels, or another way from similarity to distance."""
    read = documents.select("slice_id", F.from_json("value", "labels array<string>, n int, sim_to_dist string").alias("d")).select("slice_id", "d.*")
    first = read.agg(F.min_by(F.struct("labels", "n", "sim_to_dist"), "slice_id").alias("f"))
    joined = read.crossJoin(F.broadcast(first))  # one row
    message = F.when(F.col("labels") != F.col("f.labels"), "labels differ").when(F.col("n") != F.col("f.n"), "size differs").when(F.col("sim_to_dist") != F.col("f.sim_to_dist"), "sim_to_dist differs")
    return joined.select("slice_id", message.alias("message")).where("message IS NOT NULL")


def write_networks(documents: DataFrame, path: str) -> None:
    """A JSON file in a folder of its own for each slice."""
    documents.write.mode("overwrite").partitionBy("slice_id").text(path)


def read_network_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    found = read_bounded(spark, path, MAX_NETWORK_BYTES)
    return read_networks(found.select(F.regexp_extract("path", r"slice_id=([^/]+)/", 1).alias("slice_id"), "value"))


def network_workbook(document: dict) -> bytes:
    """Vocabulary with centralities, and the four matrices, a sheet each."""
    labels, n, central = document["labels"], document["n"], document["centrality"]
    shown = lambda v: "N/A" if v is None or math.isnan(v) else v
    sheets: list[tuple[str, list[list[object]]]] = [("Vocabulary", [["Token", *(c.capitalize() for c in CENTRALITIES)], *([x, *(shown(central[c][k]) for c in CENTRALITIES)] for k, x in enumerate(labels))])]
    for title, name in (("NPPMI Matrix", "nppmi_matrix"), ("PPMI Matrix", "ppmi_matrix"), ("Similarity Matrix", "similarity_matrix"), ("Raw Counts", "raw_counts")):
        sheets.append((title, [["", *labels], *([x, *document[name][k * n : (k + 1) * n]] for k, x in enumerate(labels))]))
    return write_workbook(sheets)


# -- aligned spaces ------------------------------------------------------------------------------

def write_space(coords: DataFrame, centralities: DataFrame, names: DataFrame, distances: DataFrame, nodes: DataFrame, edges: DataFrame, sheets: DataFrame, folder: str) -> None:
    """LV.xlsx, Coordinates.xlsx, Centralities.xlsx and as_result.json in `folder`; results are of a size for people and pass the driver.

    coords: (step, i, coord, residual); centralities: (step, i, degree, distance, closeness, betweenness); names: (i, label); distances: (step, i, j, d).
    """
    spark = coords.sparkSession
    label = {x.i: x.label for x in names.select("i", "label").collect()}
    placed = sorted(coords.select("step", "i", "coord", "residual").collect(), key=lambda x: (x.step, x.i))
    central = sorted(centralities.select("step", "i", *CENTRALITIES).collect(), key=lambda x: (x.step, x.i))
    steps = sorted({x.step for x in placed})
    of = lambda rows, s: [x for x in rows if x.step == s]
    shown = lambda v: "N/A" if math.isnan(v) else v
    places = [(f"Step_{k}", [["Label", *(f"Dim{d}" for d in range(1, len(of(placed, s)[0].coord) + 1))], *([label[x.i], *x.coord] for x in of(placed, s))]) for k, s in enumerate(steps, 1)]
    tables = [(f"Step_{k}", [["Label", *(c.capitalize() for c in CENTRALITIES)], *([label[x.i], *(shown(x[c]) for c in CENTRALITIES)] for x in of(central, s))]) for k, s in enumerate(steps, 1)]
    cells = sorted(distances.select("step", "i", "j", "d").collect())
    document = {
        "coordinates": [{"labels": [label[x.i] for x in of(placed, s)], "dims": len(of(placed, s)[0].coord), "data": [v for x in of(placed, s) for v in x.coord]} for s in steps],
        "procrustes": [{"residual": of(placed, s)[0].residual} for s in steps],
        "centralities": [{"labels": [label[x.i] for x in of(central, s)], **{c: [None if math.isnan(x[c]) else x[c] for x in of(central, s)] for c in CENTRALITIES}} for s in steps],
        "distance_matrices": [{"n": len(of(placed, s)), "data": [x.d for x in cells if x.step == s]} for s in steps],
    }
    for name, data in (("LV.xlsx", dataset_workbook(nodes, edges, sheets)), ("Coordinates.xlsx", write_workbook(places)), ("Centralities.xlsx", write_workbook(tables)), ("as_result.json", json.dumps(document, ensure_ascii=False).encode())):
        write_bytes(spark, f"{folder.rstrip('/')}/{name}", data)


def write_warnings(spark: SparkSession, warnings: list[str], path: str) -> None:
    write_bytes(spark, path, "".join(f"{x}\n" for x in warnings).encode())
