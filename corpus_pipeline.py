"""A training-data pipeline over ``documents``: quality, near-duplicates, benchmark text, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept.  The first four return the columns of ``documents``; the last
returns the pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm.feistel import TRIAL_KEY, pseudonymise
from tripleloom.llm.minmax import near_duplicates
from tripleloom.llm.packing import pack
from tripleloom.llm.qda import quality
from tripleloom.llm.store import read_table, stored
from tripleloom.llm.winnow import contamination

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "byte_bpe_50k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality(docs, read_table(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return scored.where("predicted = 1").select(*COLUMNS)


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id.

    Documents without words stay.  Rows that repeat an id within a group give
    one row; documents without an id stay only in groups where none has one.
    """
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    docs = docs.select(*COLUMNS)
    kept = near_duplicates(docs).where("kept and n_shingles > 0").groupBy("doc_id", "set_key").agg(
        F.min("row_key").alias("_key"))
    no_id = F.lit(-(2**63)).cast("long")
    kept = stored(kept.select(F.coalesce("doc_id", no_id).alias("_id"), "_key"), "kept")
    keyed = docs.where(~wordless).withColumns({
        "_id": F.coalesce(F.col("doc_id").cast("long"), no_id), "_key": F.xxhash64(F.col("doc_id").cast("long"), "text")})
    one = keyed.join(kept, ["_id", "_key"]).dropDuplicates(["_id", "_key"])
    return one.select(*COLUMNS).union(docs.where(wordless))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a twentieth of benchmark words."""
    found = contamination(docs, read_table(spark, sf_dir, "benchmark")).where("contaminated")
    found = stored(found.select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_dirty")).distinct(), "contaminated")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    same = (key == F.col("_dirty")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return docs.select(*COLUMNS).join(found, same, "left_anti").select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms."""
    made = pseudonymise(docs, TRIAL_KEY, carry=("lang", "source"))
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length."""
    return pack(docs, public_tokenizers.path(TOKENIZER), with_ids=False, added=True).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("minmax_near_dedup", keep_one_of_a_kind),
    ("benchmark_decontamination", drop_benchmark),
    ("pii_pseudonyms", hide_personal_data),
    ("power_of_two_packing", pack_sequences),
]
#: Trained scores, hashing and tokenizing have no SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written as Parquet and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
