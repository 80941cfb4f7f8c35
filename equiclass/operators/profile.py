"""Class-distribution reports and per-feature statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import round_half_up
from .classes import N, class_table, lit_long
from .naming import any_names


@any_names("class_col")
def class_counts(df: DataFrame, class_col: str, count_col: str = "n") -> DataFrame:
    """Rows per class (null is a class here), largest first, ties by class value.

    A partial + final hash aggregate: the shuffle carries one row per class per task.
    """
    return (df.groupBy(class_col).agg(F.count(F.lit(1)).alias(count_col))
            .orderBy(F.desc(count_col), F.asc_nulls_first(class_col)))


@any_names("code_col")
def code_counts(df: DataFrame, code_col: str, codes: int, count_col: str = "n") -> DataFrame:
    """Rows per integer code: 0..codes-1, zero-filled, and any other code that occurs (null first)."""
    code = F.col(code_col)
    zeros = df.sparkSession.range(codes).select(
        F.col("id").cast(df.schema[code_col].dataType).alias(code_col), lit_long(0).alias(count_col))
    counts = df.groupBy(code).agg(F.count(F.lit(1)).alias(count_col))
    return (counts.unionByName(zeros).groupBy(code).agg(F.sum(count_col).alias(count_col))
            .orderBy(code.asc_nulls_first()))


@any_names("class_col")
def class_profile(df: DataFrame, class_col: str, nulls: str = "drop") -> DataFrame:
    """Per class: n, share in %, and the table-wide size, count, max, min, majority % and
    imbalance ratio (largest / smallest)."""
    t = class_table(df, class_col, nulls)
    total, smallest = float(t.total or 1), t.smallest or 1   # of an empty table: no row shows them
    return t.frame.select(
        class_col,
        F.col(N).alias("n"),
        (F.col(N).cast("double") / F.lit(total) * F.lit(100.0)).alias("share_pct"),
        lit_long(t.total).alias("n_total"),
        lit_long(t.count).alias("n_classes"),
        lit_long(t.largest).alias("n_max"),
        lit_long(t.smallest).alias("n_min"),
        F.lit(t.largest / total * 100.0).alias("majority_pct"),
        F.lit(t.largest / smallest).alias("imbalance_ratio"),
    )


def compare_profiles(before: DataFrame, after: DataFrame, class_col: str) -> DataFrame:
    """Class sizes before and after a rebalancing step (full outer join; 0 when absent)."""
    b = before.groupBy(class_col).agg(F.count(F.lit(1)).alias("n_before"))
    a = (after.groupBy(class_col).agg(F.count(F.lit(1)).alias("n_after"))
         .withColumnRenamed(class_col, "_ec_after_class"))
    j = b.join(a, b[class_col].eqNullSafe(a["_ec_after_class"]), "full_outer")
    nb = F.coalesce(F.col("n_before"), lit_long(0))
    na = F.coalesce(F.col("n_after"), lit_long(0))
    return j.select(
        F.coalesce(F.col(class_col), F.col("_ec_after_class")).alias(class_col),
        nb.alias("n_before"), na.alias("n_after"), (na - nb).alias("delta"),
    )


def feature_stats(df: DataFrame, cols: list[str], digits: int | None = None) -> DataFrame:
    """Long form (feature, n, mean, variance, non_zeros) in one aggregation pass.

    ``variance`` is the sample variance. With ``digits`` mean and variance are rounded
    half up to that many decimals.
    """
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).try_cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"),
                 F.var_samp(x).alias(f"v{i}"), F.count_if(x != 0.0).alias(f"z{i}")]
    one = df.agg(*aggs)
    rnd = (lambda v: round_half_up(v, digits)) if digits is not None else (lambda v: v)
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"),
                 rnd(F.col(f"m{i}")).alias("mean"), rnd(F.col(f"v{i}")).alias("variance"),
                 F.col(f"z{i}").alias("non_zeros"))
        for i, c in enumerate(cols)
    ])
    return one.select(F.inline(rows))


def vector_stats(df: DataFrame, features_col: str) -> DataFrame:
    """Mean, variance and non-zero count per position of an ML vector column."""
    from pyspark.ml.stat import Summarizer

    s = Summarizer.metrics("mean", "variance", "numNonZeros", "count")
    return df.select(s.summary(F.col(features_col)).alias("s")).select("s.*")
