"""Queries of the training-data operators, each over its whole table, with DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.binarycodes import near_vectors
from weftgraph.llm.kneserney import score_documents
from weftgraph.llm.licenses import scan_licenses
from weftgraph.llm.linededup import line_verdicts
from weftgraph.llm.mixing import mix_sources
from weftgraph.llm.packing import pack_documents
from weftgraph.llm.probminhash import near_duplicates
from weftgraph.llm.quality import judge_quality
from weftgraph.llm.sharding import shard_documents
from weftgraph.llm.substrings import dedup_substrings

#: Vocabulary for packing; any byte-level BPE file of the tokenizers library will do.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ORACLE: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return shard_documents(docs, 16).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_verdicts(_documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return lines.groupBy(F.col("_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), count("exact").alias("n_exact"), count("near").alias("n_near"),
        F.sum(F.when(F.col("kind") == "kept", F.col("_n_chars")).otherwise(0)).alias("kept_chars"),
    )


ORACLE["op2_line_dedup"] = r"""
WITH lines AS (SELECT doc_id, no - 1 AS no, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)
               WHERE length(trim(l, ' ' || chr(9) || chr(13) || chr(12) || chr(11))) > 0),
firsts AS (SELECT l, min((doc_id, no)) AS f FROM lines GROUP BY l),
longer AS (SELECT l, f, length(l) AS n FROM firsts WHERE length(l) >= 20),
halves AS (SELECT l, f, n, m, 'a' || left(l, m // 2) AS k FROM (SELECT *, n AS m FROM longer UNION ALL SELECT *, n - 1 FROM longer)
           UNION ALL SELECT l, f, n, m, 'b' || right(l, m - m // 2) FROM (SELECT *, n AS m FROM longer UNION ALL SELECT *, n - 1 FROM longer)),
near AS (SELECT DISTINCT y.l FROM halves x JOIN halves y ON x.k = y.k AND x.m = y.m AND x.f < y.f AND abs(x.n - y.n) <= 1 WHERE levenshtein(x.l, y.l) <= 1),
judged AS (SELECT doc_id, length(l) AS n, CASE WHEN (doc_id, no) <> f THEN 'exact' WHEN l IN (SELECT l FROM near) THEN 'near' ELSE 'kept' END AS kind FROM lines JOIN firsts USING (l))
SELECT doc_id, count(*) AS n_lines, count_if(kind = 'exact')::BIGINT AS n_exact, count_if(kind = 'near')::BIGINT AS n_near, sum(CASE WHEN kind = 'kept' THEN n ELSE 0 END)::BIGINT AS kept_chars
FROM judged GROUP BY doc_id
"""


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir).select("doc_id", "text"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_documents(spark, sf_dir).select("doc_id", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge_quality(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", F.round("rate", 9).alias("rate"), "n_copies", "copy_no", "shuffle_key")


ORACLE["op7_mixing"] = """
WITH sizes AS (SELECT source, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY source),
rates AS (SELECT source, sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes) * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes),
terms AS (SELECT source, rate, k, exp(k * ln(rate) - rate - CASE WHEN k < 2 THEN 0 ELSE lgamma(k + 1) END) AS p
          FROM rates, LATERAL (SELECT unnest(range(0, ceil(rate + 12 * sqrt(rate) + 31)::BIGINT)) AS k)),
cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM terms),
drawn AS (SELECT doc_id, source, (('0x' || substr(md5('17|' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
counted AS (SELECT doc_id, d.source, any_value(rate) AS rate, count(*) AS n_copies
            FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.upto <= d.u GROUP BY doc_id, d.source)
SELECT doc_id, source, round(rate, 9) AS rate, n_copies::INTEGER AS n_copies, copy_no::INTEGER AS copy_no, md5('18|' || doc_id || '|' || copy_no) AS shuffle_key
FROM counted, LATERAL (SELECT unnest(range(1, n_copies + 1)) AS copy_no)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
