"""From raw documents to packed rows of token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of documents, with any others that the table has. run() writes every stage's rows to
the shared folder and reads them again, so that a lost executor costs one stage's tasks at most; what a
stage wrote is removed once the next has written its own.

Null and empty texts are judged like any others: their classifier's features are 0, they share a
fingerprint, hold no benchmark words, have size 0 (one copy) and pack as an end token. Rows with a null
doc_id go through all stages; of near copies without any id one stays. Rows that repeat whole are near
copies. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratabranch.llm import decontam, mixing, packing, quality, simhash
from stratabranch.llm.common import release, stored, stored_folders, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality, with their site's posterior, is over the threshold."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints: the one that names it."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a full window of a benchmark item, or windows of two items."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("pack", pack),
]

#: SQL can't express the classifier, XXH64 or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), stored_folders()
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        release(spark, docs, before)
    return docs
