"""A corpus pipeline of five stages. Each works on all that its predecessor kept, which is written as Parquet and
read again; its decisions take effect.

No SQL: a trained classifier and fingerprints can't be expressed in it. tests/llm tests the stages and run() against a brute-force
version of what they decide (test_pipeline).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixtab.llm import mixing, near_text, packing, pii, toxicity
from helixtab.llm.queries import TOXIC, pii_key
from helixtab.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC. Learns from the labels of all documents there are."""
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), machine, "toxicity").where(F.col("toxicity") < TOXIC).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a similarity of 0.8 or more."""
    return near_text.drop_near_texts(docs.select(*COLUMNS))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; n_chars follows the text."""
    done = pii.pseudonymise(docs.select(*COLUMNS), pii_key(spark))
    return done.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares of all sources, as many characters as before; a document's copies are rows."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 1024 tokens."""
    return packing.pack(written(packing.pieces(docs), "pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies), ("pii", replace_personal_data), ("mixing", mix_sources), ("best-fit packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
