"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the output; the mean number of copies of its documents is the
share it should have over the share it has. A document's own count is drawn by inverting the
Poisson distribution at a number hashed from the seed and its id, so that every run and every
retried task draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import without

MAX_RATE = 10_000


def hashed_unit(*parts: Column) -> Column:
    """Number in (0, 1) from the first 48 bits of the MD5 of the parts, joined by a vertical bar."""
    text = F.concat_ws("|", *(F.coalesce(x.cast("string"), F.lit("null")) for x in parts))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float, temperature: float, text: str, source: str) -> DataFrame:
    """(_source, _rate): mean copies a document. Without weights a source's share is its size to the power `temperature`."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(size).cast("double").alias("_size"))
    if weights is None:
        weighted = sizes.withColumn("_weight", F.pow("_size", F.lit(float(temperature))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_source string, _weight double")
        weighted = sizes.join(given, sizes["_source"].eqNullSafe(given["_source"]), "left").select(sizes["_source"], "_size", F.coalesce("_weight", F.lit(0.0)).alias("_weight"))
    totals = weighted.agg(F.sum("_size").alias("_all"), F.sum("_weight").alias("_weights"))
    rate = F.lit(float(epochs)) * F.col("_weight") / F.col("_weights") * F.col("_all") / F.col("_size")
    return weighted.crossJoin(F.broadcast(totals)).select("_source", F.when(F.col("_weights") > 0, rate).otherwise(0.0).alias("_rate"))


def cumulative_poisson(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as far as a draw of 48 bits can reach."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    begin = F.struct(F.lit(0.0).alias("log_factorial"), F.lit(0.0).alias("below"), F.array().cast("array<double>").alias("all"))

    def add(state: Column, k: Column) -> Column:
        logs = state["log_factorial"] + F.when(k > 0, F.ln(k.cast("double"))).otherwise(0.0)
        upto = state["below"] + F.exp(k * F.ln(rate) - rate - logs)
        return F.struct(logs.alias("log_factorial"), upto.alias("below"), F.concat(state["all"], F.array(upto)).alias("all"))

    built = F.aggregate(F.sequence(F.lit(0), last), begin, add, lambda s: s["all"])
    return F.when(rate > 0, built).otherwise(F.array(F.lit(2.0)))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = 0.5, seed: int = 17, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Replicate each document by its Poisson count and shuffle the copies over all partitions.

    weights: target share by source (sources without one get none); epochs: bytes of the result
    over those of the input, in the mean. Adds rate, n_copies, copy_no (from 1) and shuffle_key, by
    which the rows are dealt to partitions and stand in them. A null source is a source of its own,
    a null text counts as empty, repeated rows draw alike, no rows give no rows. Input columns named
    as an added one are replaced. A rate above MAX_RATE raises, since such weights are an error.
    """
    keep = without(docs, ["rate", "n_copies", "copy_no", "shuffle_key", "_key"])
    rates = source_rates(docs, weights, epochs, temperature, text, source)
    checked = F.when(F.col("_rate") <= MAX_RATE, F.col("_rate")).otherwise(F.raise_error(F.lit("a source's weight asks for too many copies")))
    drawn = rates.select("_source", checked.alias("rate")).withColumn("_cdf", cumulative_poisson(F.col("rate")))
    packed = docs.select(F.struct(*keep).alias("_row"), F.col(source).alias("_from"), F.col(id_col).cast("string").alias("_key"))
    joined = packed.join(drawn, F.col("_from").eqNullSafe(F.col("_source")))
    u = hashed_unit(F.lit(seed), F.col("_key"))
    counted = joined.withColumn("n_copies", F.size(F.filter("_cdf", lambda x: x <= u))).where("n_copies > 0")
    copies = counted.select("_row.*", "rate", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"), F.coalesce("_key", F.lit("null")).alias("_key"))
    key = F.md5(F.concat_ws("|", F.lit(seed + 1), "_key", F.col("copy_no")))
    return copies.withColumn("shuffle_key", key).drop("_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
