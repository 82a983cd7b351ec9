"""The corpus pipeline: raw documents to token ids.

Each stage takes the documents its predecessor kept and returns those it keeps
(the columns of ``documents``); the last returns the token ids. Between stages
the rows are written as Parquet and read again, so a lost executor repeats at
most one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkcast.llm.byte_bpe import encode
from sparkcast.llm.decontaminate import drop_leaks
from sparkcast.llm.jaccard_join import drop_near_duplicates
from sparkcast.llm.language_id import keep_identified
from sparkcast.llm.repeats import strip_repeats
from sparkcast.llm.util import save

RANKS = "byte_bpe_50k.tiktoken"
#: Rows of an Arrow batch: whole texts, of which Python workers hold a batch or two.
BATCH = 1000


def _stage(f):
    """A stage with batches that suit whole texts; a setting of this application's session."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
        return f(spark, docs, sf_dir)
    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told."""
    return keep_identified(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_duplicates(docs, k=5, num=80, den=100)


@_stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of PASSAGE bytes or more go; n_chars follows the text."""
    return strip_repeats(docs, size=PASSAGE).withColumn("n_chars", F.length("text").cast("long"))


@_stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return encode(docs, public_tokenizers.path(RANKS)).select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


PASSAGE = 101           # bytes; 51 words of one letter and the blanks between them: no passage of over 50 words is shorter

STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("benchmark", benchmark), ("tokens", tokens)]

#: No stage but the last row filter has a plain SQL form: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
