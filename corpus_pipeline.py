"""The corpus pipeline: quality rules, SimHash near-dedup, benchmark
decontamination, PII sanitisation, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``. ``run`` writes
each stage as Parquet in the folder of spark.checkpoint.dir and rereads it, so
a lost executor costs a re-read of the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from abundance.llm import bpe, decontaminate, pii, quality, simhash
from abundance.llm.common import read_table
from abundance.llm.queries import tokenizer_file
from abundance.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that with the smallest id."""
    return simhash.one_of_each(docs, shingle=4, bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), width=13)


def pii_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced; n_chars follows."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed uint32), and the digests of ids and decoded text."""
    coded = bpe.round_trip(docs, tokenizer_file("byte_bpe_50k.json"), ids="token_ids", null_as_empty=True)
    return coded.select("doc_id", "lang", "source", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids",
                        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontamination),
          ("pii", pii_removal), ("bpe", bpe_tokens)]

# XXH64 fingerprints, components and BPE have no DuckDB form; the tests hold
# the pipeline against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4()}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
