"""Streams: word counts that grow with the text that comes in, sheets of events, points placed as they arrive."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import tokens
from weftgraph.operators.embedding import project_points


def stream_unigrams(texts: DataFrame, text: str = "text") -> DataFrame:
    """Counts of tokens over a stream, for the update or complete mode."""
    return texts.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))


def stream_pairs(texts: DataFrame, window: int = 5, text: str = "text") -> DataFrame:
    """Counts of ordered pairs of tokens within `window` places of a text; each text is whole in its row, so no state but the counts is kept."""
    words = texts.select(tokens(F.col(text)).alias("w"))
    at = words.select("w", F.posexplode("w").alias("pos", "a"))
    near = at.select("a", F.explode(F.slice("w", F.col("pos") + 2, window)).alias("b"))
    return near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("cnt"))


def event_sheets(events: DataFrame, span: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of each kind and their mean value in time windows, closed once events can be no more than `late` late."""
    timely = events.withWatermark("ts", late) if events.isStreaming else events
    return timely.groupBy(F.window("ts", span).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def stream_projection(points: DataFrame, own: np.ndarray, mean: np.ndarray) -> DataFrame:
    """Coordinates of points from their distances to landmarks; needs no state."""
    return project_points(points, own, mean)
