"""A corpus-cleaning pipeline over `documents`: each stage's rows are the next one's input.

Each stage calls one operator of stanzaflow.llm on all rows that it gets. Stages 1 to 4 return the columns of
documents; the last returns the mix.

Defined results: a row without a doc_id can't be named by a decision, so that the filtering stages keep it. A decision
on a doc_id holds for all rows that repeat it. Null and empty texts are never toxic by themselves, no near-duplicates,
hold no benchmark item and no personal data, and have size 0 in the mix. Texts of any length are judged whole. Columns
beyond those of documents, whatever their names, are left out by each stage. No rows give no rows, and an empty
labels or benchmark table rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stanzaflow.llm import decontam, mixing, near_dedup, pii, toxicity
from stanzaflow.llm.scratch import bounded_batches, discard, materialise, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Keys of 8 bytes that are broadcast at most; beyond, a shuffled join does the same.
BROADCAST_KEYS = 2_000_000


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs but for those whose doc_id is among keys (doc_id); text moves only if the keys are very many."""
    keys = materialise(keys.select("doc_id").distinct())
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return docs.join(keys, "doc_id", "left_anti").select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that it predicts to be toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, toxicity.op4(docs, labels).filter("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 at 80 %: of each component the document with the smallest id stays, once."""
    found = near_dedup.near_duplicates(docs, "doc_id", "text", percent=80)
    return _without(docs, found.filter("NOT kept").select(F.col("key").alias("doc_id")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that contain a benchmark item by 80 % or more go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontam.op6(docs, benchmark))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: personal data is replaced by its kind; n_chars follows the text."""
    bounded_batches(spark)
    clean = docs.select("doc_id", pii.redacted(F.col("text")).alias("text"), "lang", "source", "n_chars")
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: how many words of each document the mix takes."""
    return mixing.op8(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]
#: Toxicity is a fitted model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        since = written()
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
            discard(since)  # what the stage wrote on its way; its own output is the last
    return docs
