"""From raw documents to packed training sequences: five stages over the whole table.

Each stage takes all that the one before it kept. quality drops the documents that the quality
rules reject; lines takes out repeated lines and the documents that were nothing else; near keeps
one document of each group of copies and near copies; mix replicates documents to the target
weights of their sources; pack lays the copies' tokens into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import stage
from weftgraph.llm.linededup import dedup_lines
from weftgraph.llm.mixing import mix_sources
from weftgraph.llm.packing import pack_documents
from weftgraph.llm.probminhash import keep_one
from weftgraph.llm.quality import judge_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep; a null text goes, a document without a label is judged as all others."""
    judged = judge_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, the same or within one edit, go; n_chars is counted anew. Of an empty table nothing is left."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of copies and near copies stays; rows that repeat an id and a text are one."""
    return keep_one(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy is a row of its own; copies of a document keep its id."""
    return mix_sources(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 tokens; each copy is packed for itself."""
    return pack_documents(docs, TOKENIZER)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("pack", pack)]
#: Shingle similarity and sub-word tokens are beyond SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
