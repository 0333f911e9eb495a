"""Corpus operators: slices, positions, vocabulary, co-occurrence and association.

Facts carry `slice_id`; order is always a column. No window spans a whole slice: running sums are
taken in two levels over blocks of documents, and co-occurrence works in blocks of positions that
repeat the first tokens of the next block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.tables import bound_batches
from weftgraph.functions.text import tokens

BLOCK_DOCS, BLOCK_TOKENS = 4096, 8192


def document_tokens(docs: DataFrame, slice_id: Column, order: str = "doc_id", text: str = "text", language: str | None = None, compose: bool = False) -> DataFrame:
    """(slice_id, doc, words): the kept tokens of each document as an array; compose: of the text in canonical composition."""
    if compose:
        bound_batches(docs.sparkSession)
    return docs.select(slice_id.alias("slice_id"), F.col(order).alias("doc"), tokens(F.col(text), language, compose).alias("words"))


def running_start(df: DataFrame, keys: list[str], order: str, value: Column, out: str, block: int = BLOCK_DOCS) -> DataFrame:
    """Sum of `value` over the rows of the key before each row, for an integer `order`.

    Blocks of `order` are summed first and only their sums are added up along the key; inside, a
    window spans one block.
    """
    dealt = df.withColumns({"_block": F.floor(F.col(order) / block), "_value": value})
    totals = dealt.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(starts, [*keys, "_block"])
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_block", "_value", "_start")


def positions(doc_tokens: DataFrame, per_document: bool = False) -> DataFrame:
    """(slice_id, doc, pos, token); positions run on across a slice's documents unless they are to restart in each."""
    if per_document:
        return doc_tokens.select("slice_id", "doc", F.posexplode("words").alias("pos", "token"))
    placed = running_start(doc_tokens, ["slice_id"], "doc", F.size("words").cast("long"), "start")
    spread = placed.select("slice_id", "doc", "start", F.posexplode("words").alias("at", "token"))
    return spread.select("slice_id", "doc", (F.col("start") + F.col("at")).alias("pos"), "token")


def token_batches(tokens_at: DataFrame, size: int) -> DataFrame:
    """Token stream cut into batches of `size` positions: batch-0, batch-1, ..."""
    batch = F.floor(F.col("pos") / max(size, 1))
    return tokens_at.withColumn("batch", batch).withColumn("slice_id", F.concat(F.lit("batch-"), batch.cast("string")))


def keep_slices(doc_tokens: DataFrame, min_tokens: int) -> DataFrame:
    """Slices with at least `min_tokens` tokens, and one at least; `ord` numbers what is left."""
    totals = doc_tokens.groupBy("slice_id").agg(F.sum(F.size("words")).alias("token_count")).where(F.col("token_count") >= max(min_tokens, 1))
    return totals.withColumn("ord", F.row_number().over(Window.orderBy("slice_id")) - 1)


def unigrams(doc_tokens: DataFrame, shared: bool = False) -> DataFrame:
    """Counts of tokens, in each slice or over all."""
    keys = [] if shared else ["slice_id"]
    return doc_tokens.select(*keys, F.explode("words").alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("cnt"))


def vocabulary(counts: DataFrame, min_count: int, shared: bool = False) -> DataFrame:
    """Tokens that occur often enough, with an index from 0 in the order of their bytes."""
    keys = [] if shared else ["slice_id"]
    kept = counts.where(F.col("cnt") >= min_count).withColumn("_head", F.substring("token", 1, 2))  # in the order of the tokens
    heads = kept.groupBy(*keys, "_head").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1))
    starts = heads.select(*keys, "_head", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_head").orderBy("token"))
    return kept.join(starts, [*keys, "_head"]).select(*keys, "token", "cnt", (F.col("_start") + inside - 1).cast("int").alias("idx"))


def cooccurrence(tokens_at: DataFrame, vocab: DataFrame, window: int = 5, slide: int = 1, unit: list[str] | None = None) -> DataFrame:
    """(slice_id, a, b, cnt): how often vocabulary tokens stand within `window` positions of a centre.

    Every `slide`-th position is a centre. Directed counts are made symmetric by adding both
    directions off the diagonal, so with slide 1 a pair counts twice. Other tokens keep their place.
    Windows stay inside `unit` (the slice, or the slice and document where positions restart).
    """
    unit = unit or ["slice_id"]
    known = tokens_at.join(vocab.select("slice_id", "token", F.lit(True).alias("_known")), ["slice_id", "token"], "left")
    rows = known.select(*unit, "pos", F.when(F.col("_known"), F.col("token")).alias("t"))
    block = F.floor(F.col("pos") / BLOCK_TOKENS)
    again = (F.col("pos") % BLOCK_TOKENS < window) & (F.col("pos") >= BLOCK_TOKENS)
    homes = F.when(again, F.array(block, block - 1)).otherwise(F.array(block))
    dealt = rows.withColumn("_block", F.explode(homes)).withColumn("_own", F.floor(F.col("pos") / BLOCK_TOKENS) == F.col("_block"))
    along = Window.partitionBy(*unit, "_block").orderBy("pos")
    ahead = dealt.withColumns({f"_t{k}": F.lead("t", k).over(along) for k in range(1, window + 1)}).where(F.col("_own") & F.col("t").isNotNull())
    pair = lambda k: F.struct(F.lit(k).alias("k"), F.col(f"_t{k}").alias("u"))
    pairs = ahead.select("slice_id", "pos", "t", F.explode(F.array(*map(pair, range(1, window + 1)))).alias("p")).where(F.col("p.u").isNotNull())
    directed = pairs.select("slice_id", F.col("t").alias("a"), F.col("p.u").alias("b"), (F.col("pos") % slide == 0).cast("int").alias("right"), ((F.col("pos") + F.col("p.k")) % slide == 0).cast("int").alias("left"))
    counted = directed.groupBy("slice_id", "a", "b").agg(F.sum(F.col("right") + F.col("left")).alias("n")).where("n > 0")
    both = counted.where("a <> b").select("slice_id", F.col("b").alias("a"), F.col("a").alias("b"), "n").union(counted)
    return both.groupBy("slice_id", "a", "b").agg(F.sum("n").alias("cnt"))


def association(counts: DataFrame) -> DataFrame:
    """Adds pmi, ppmi and nppmi. The total is half the sum of counts while row sums are whole, so pmi lies one bit under the textbook's."""
    rows = counts.groupBy("slice_id", "a").agg(F.sum("cnt").alias("r"))
    total = rows.groupBy("slice_id").agg((F.sum("r") / 2).alias("total"))
    return scores(counts.join(rows, ["slice_id", "a"]).join(rows.select("slice_id", F.col("a").alias("b"), F.col("r").alias("c")), ["slice_id", "b"]).join(total, "slice_id"))


def scores(found: DataFrame) -> DataFrame:
    """The same of counts that have r and c, the sums of a's and b's counts, and total beside them."""
    pmi = F.log2(F.col("cnt") * F.col("total") / (F.col("r") * F.col("c").cast("double")))
    bits = -F.log2(F.col("cnt") / F.col("total"))
    scored = found.select("slice_id", "a", "b", "cnt", *(x for x in found.columns if x in ("i", "j")), pmi.alias("pmi"), bits.alias("_bits")).withColumn("ppmi", F.greatest("pmi", F.lit(0.0)))
    return scored.withColumn("nppmi", F.when(F.col("_bits") > 1e-10, F.least(F.col("ppmi") / F.when(F.col("_bits") > 1e-10, F.col("_bits")), F.lit(1.0))).otherwise(0.0)).drop("_bits")


def count_similarity(counts: DataFrame) -> DataFrame:
    """Counts over the slice's largest count; pairs stay where they are, a row for each slice goes to them."""
    most = counts.groupBy("slice_id").agg(F.max("cnt").alias("most"))
    return counts.join(F.broadcast(most), "slice_id").select("slice_id", "a", "b", (F.col("cnt") / F.col("most")).alias("similarity"))


def threshold_edges(scored: DataFrame, weight: str, least: float) -> DataFrame:
    """Undirected edges a < b whose weight exceeds `least`."""
    return scored.where((F.col("a") < F.col("b")) & (F.col(weight) > least)).select("slice_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.col(weight).alias("w"))


def top_pairs(scored: DataFrame, weight: str, k: int) -> DataFrame:
    """The k strongest pairs a < b of each slice; ties in the order of the words."""
    ranked = Window.partitionBy("slice_id").orderBy(F.desc(F.round(weight, 9)), "a", "b")
    return scored.where("a < b").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def all_union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
