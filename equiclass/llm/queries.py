"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment
from .bitplanes import read_tokens, write_tokens
from .collocations import collocations, collocations_sql
from .common import table, work_path
from .containment import leaks
from .cws import fingerprints
from .interleave import interleave
from .licences import licence_scan
from .neardup import near_duplicates
from .partenum import jaccard_components
from .ppm import ppm_scores
from .raking import mixed
from .toxicity import toxicity_scores
from .treefields import main_text


SHARDS, SEED = 16, 42
#: Share of the tokens that the mixture keeps.
KEEP_SHARE = 0.8


def tokenizer_file() -> str:
    """The vocabulary file of the box; on a cluster the same path on every worker."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_file() -> str:
    """The second vocabulary's file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_bitplane_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Every text's ids through the bit-plane store; from what was read back."""
    path = work_path(spark, "bitplane-tokens")
    write_tokens(table(spark, d, "documents"), path, tokenizer_file())
    return read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_ppm_scores(spark: SparkSession, d: str) -> DataFrame:
    return ppm_scores(table(spark, d, "documents"))


def op3_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels"))


def op4_containment(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op5_raking(spark: SparkSession, d: str) -> DataFrame:
    """Every document's weight, inclusion probability and fate."""
    return mixed(table(spark, d, "documents"), keep_share=KEEP_SHARE, bounded=True).select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"),
        F.col("mix_weight").alias("weight"), F.col("mix_probability").alias("probability"),
        F.col("mix_kept").alias("kept"))


def op6_interleave(spark: SparkSession, d: str) -> DataFrame:
    return interleave(table(spark, d, "documents"), SHARDS, seed=SEED).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_licence_rules(spark: SparkSession, d: str) -> DataFrame:
    return licence_scan(table(spark, d, "documents"))


def op8_tree_fields(spark: SparkSession, d: str) -> DataFrame:
    text = F.array_join("blocks", "\n\n")
    return main_text(table(spark, d, "pages")).select(
        "page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


def op9_weighted_sampling(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints(table(spark, d, "documents"))


def op10_bayes_neardup(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "documents"), size=3, threshold=0.85).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op11_galloping_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment(table(spark, d, "documents"), tokenizer_file(), piece_file())


def op12_partenum_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_components(table(spark, d, "documents"), size=4, percent=85)


def op13_automata_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bitplane_tokens": op1_bitplane_tokens,
    "op2_ppm_scores": op2_ppm_scores,
    "op3_toxicity": op3_toxicity,
    "op4_containment": op4_containment,
    "op5_raking": op5_raking,
    "op6_interleave": op6_interleave,
    "op7_licence_rules": op7_licence_rules,
    "op8_tree_fields": op8_tree_fields,
    "op9_weighted_sampling": op9_weighted_sampling,
    "op10_bayes_neardup": op10_bayes_neardup,
    "op11_galloping_alignment": op11_galloping_alignment,
    "op12_partenum_join": op12_partenum_join,
    "op13_automata_collocations": op13_automata_collocations,
}

ORACLE: dict[str, str] = {"op13_automata_collocations": collocations_sql()}
