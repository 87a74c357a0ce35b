"""The registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stanzaflow.llm import decontam, knn, mixing, near_dedup, negatives, packing, pii, quality, secrets, spelling, suffix_dedup, toxicity, window_dedup
from stanzaflow.llm.scratch import bounded_batches
from stanzaflow.sources.files import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "embeddings") else rows


def _plain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": lambda spark, d: secrets.op1(_table(spark, d, "documents")),
        "op2_substring_dedup": lambda spark, d: window_dedup.op2(_table(spark, d, "documents")),
        "op3_minhash_dedup": lambda spark, d: near_dedup.op3(_table(spark, d, "documents")),
        "op4_toxicity": lambda spark, d: toxicity.op4(_table(spark, d, "documents"), _table(spark, d, "labels")),
        "op5_suffix_dedup": lambda spark, d: suffix_dedup.op5(_table(spark, d, "documents")),
        "op6_decontamination": lambda spark, d: decontam.op6(_table(spark, d, "documents"), _table(spark, d, "benchmark")),
        "op7_quality": lambda spark, d: quality.op7(_table(spark, d, "documents"), _table(spark, d, "labels")),
        "op8_mixing": lambda spark, d: mixing.op8(_table(spark, d, "documents")),
        "op9_pii": lambda spark, d: pii.op9(_table(spark, d, "documents")),
        "op10_topk": lambda spark, d: knn.op10(_table(spark, d, "embeddings")),
        "op11_packing": lambda spark, d: packing.op11(_plain(spark, d, "documents"), _word_bpe()),
        "op12_spelling": lambda spark, d: spelling.op12(_plain(spark, d, "documents")),
        "op13_hard_negatives": lambda spark, d: negatives.op13(_plain(spark, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    from stanzaflow.llm.oracles import ORACLES

    return dict(ORACLES)
