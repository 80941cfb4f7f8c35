"""End-to-end flows a user of the reference runs, as lazy plans over the operators.

- ``rebalance_csv``: CSV -> rows per class -> oversample to the majority -> rows per class.
- ``smote_lines``: ``label i:v ...`` text lines -> SMOTE (ratio target).
- ``resampling_report``: class codes -> counts, then spread subsample, SMOTE (percent
  target) and uniform resample, each followed by its counts, as one long report.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import nominal_index
from ..operators.oversample import oversample
from ..operators.profile import class_counts
from ..operators.resample import resample_uniform
from ..operators.smote import smote, smote_percent
from ..operators.undersample import undersample_spread
from ..sources.readers import parse_labeled_vectors, read_lines, read_table


@dataclass
class Rebalanced:
    frame: DataFrame     # the balanced rows
    before: DataFrame    # class, n
    after: DataFrame     # class, n
    class_col: str


def rebalance_csv(spark: SparkSession, paths: str | Sequence[str], class_col: str | None = None,
                  header: bool = False, infer: bool = False, id_cols: list[str] | None = None,
                  seed: int = 42) -> Rebalanced:
    """Read CSV (class = last column by default), oversample every class to the largest."""
    df, c = read_table(spark, paths, header=header, infer=infer, class_col=class_col)
    balanced = oversample(df, c, id_cols, seed=seed)
    return Rebalanced(balanced, class_counts(df, c), class_counts(balanced, c), c)


def smote_lines(spark: SparkSession, paths: str | Sequence[str], size: int, k: int = 5,
                sampling_rate: float = 0.5, ratio_to_max: float = 0.5, seed: int = 42,
                index_base: int = 1, metric: str = "cosine") -> DataFrame:
    """Labelled vector lines -> SMOTE. Lines are identified by ``monotonically_increasing_id``
    (stable for a given input layout, also under task retries)."""
    lines = read_lines(spark, paths).withColumn("line_id", F.monotonically_increasing_id())
    parsed = parse_labeled_vectors(lines, size=size, index_base=index_base)
    return smote(parsed.select("line_id", "label", "features"), "label", "features", "line_id",
                 k=k, sampling_rate=sampling_rate, ratio_to_max=ratio_to_max, seed=seed,
                 metric=metric)


def resampling_report(df: DataFrame, class_col: str, feature_cols: list[str], id_col: str,
                      spread: float = 1.0, percent: int = 100, k: int = 5, bias: float = 1.0,
                      seed: int = 42) -> DataFrame:
    """(step, class_code, n) after each step of the chain, classes coded 0..m-1 in value order.

    Steps: ``original``, ``spread_subsample``, ``smote``, ``resample``; every step starts
    from the coded original rows.
    """
    coded = nominal_index(df, class_col, "class_code").filter(F.col("class_code").isNotNull())
    with_vec = coded.withColumn("features", F.array(*[F.col(c).try_cast("double") for c in feature_cols]))
    steps = [
        ("original", coded),
        ("spread_subsample", undersample_spread(coded, "class_code", [id_col], spread, seed=seed)),
        ("smote", smote_percent(with_vec, "class_code", "features", id_col, percent=percent, k=k,
                                seed=seed)),
        ("resample", resample_uniform(coded, "class_code", [id_col], bias=bias, seed=seed)),
    ]
    parts = [frame.groupBy("class_code").agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(name).alias("step"), "class_code", "n") for name, frame in steps]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
