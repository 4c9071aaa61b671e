"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm.bestfit import pack_best_fit
from tripleloom.llm.divergence import divergence
from tripleloom.llm.feistel import TRIAL_KEY, pseudonymise
from tripleloom.llm.fptree import source_divergence
from tripleloom.llm.katz import katz_scores
from tripleloom.llm.langid import identify
from tripleloom.llm.minmax import near_duplicates
from tripleloom.llm.oracle import CONTAMINATION, DIVERGENCE, SOURCE_DIVERGENCE, TRIE
from tripleloom.llm.packing import pack
from tripleloom.llm.qda import quality
from tripleloom.llm.reshard import lay_out, reshard, rewrite
from tripleloom.llm.store import read_table
from tripleloom.llm.toxicity import toxicity
from tripleloom.llm.trie import prefix_trie, rebuilt, turn_lists
from tripleloom.llm.winnow import contamination

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The others have trained scores, ciphers, tokens or hashing that SQL has not; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op7_winnowing_decontamination": CONTAMINATION,
    "op9_distribution_divergence": DIVERGENCE,
    "op11_peeled_prefix_trie": TRIE,
    "op13_fp_tree_divergence": SOURCE_DIVERGENCE,
}


def _query(run):
    QUERIES[run.__name__] = run
    return run


@_query
def op1_fused_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts teach from ``documents``; the pages of ``pages`` are judged."""
    return identify(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


@_query
def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(read_table(spark, sf_dir, "documents"))


@_query
def op3_viterbi_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@_query
def op4_min_cost_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 shards that hold whole sources, so of very unequal sizes, to 40 equal ones.

    ``documents`` has no shards: the old layout is made here, by a hash of the
    source.  Affected shards are rewritten, and the digests read from the files.
    """
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(32))
    laid = lay_out(read_table(spark, sf_dir, "documents"), old)
    return rewrite(laid, reshard(laid)).drop("row_id")


@_query
def op5_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                with_ids=False, added=True).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


@_query
def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


@_query
def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@_query
def op8_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@_query
def op9_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = divergence(read_table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 6) for c in ("js_chars", "js_words")})


@_query
def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents"), TRIAL_KEY)


@_query
def op11_peeled_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turn_lists(read_table(spark, sf_dir, "conversations"))))


@_query
def op12_histogram_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                         with_ids=False, added=True)


@_query
def op13_fp_tree_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))
