"""The training-corpus pipeline: five stages over ``documents``, each one operator of ``equiclass.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's
result as Parquet to the shared folder and reads it as the next one's ``docs``. The first four
return the columns of ``documents``, the last the token ids of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiclass.llm.bitplanes import read_tokens, write_tokens
from equiclass.llm.common import saved, table, work_path
from equiclass.llm.containment import without_leaks
from equiclass.llm.neardup import one_of_each_component
from equiclass.llm.queries import KEEP_SHARE, tokenizer_file
from equiclass.llm.raking import sampled
from equiclass.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return one_of_each_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample at the target mixture of sources, languages and topics."""
    return sampled(docs, keep_share=KEEP_SHARE, bounded=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, read back from the bit-plane store."""
    path = work_path(spark, "corpus-tokens")
    write_tokens(docs, path, tokenizer_file())
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("toxicity", toxicity),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]

# Classifier, connected components and tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
