"""Sampling primitives with hash-based, repeatable randomness.

- ``sample_exact``: exactly min(n, m) rows per class, without replacement.
- ``sample_bernoulli``: each row kept when uniform01(seed, ids) < fraction.
- ``sample_with_replacement``: exactly ``size`` draws per class, with replacement.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..config import P
from ..functions.keys import uniform01
from .classes import (N, ClassTable, class_table, join_on_class, keep_classes, lit_long,
                      local_frame, row_keys, select_like)
from .ranking import RANK, flag_first, rank_rows
from .replicate import replicate
from .naming import any_names

QUOTA = P + "quota"
SIZE = P + "size"
DRAW = P + "draw"
TIMES = P + "times"


def per_class_value(table: ClassTable, sizes: int | Mapping, name: str) -> DataFrame:
    """class, n, ``name``: one number for all classes, or a per-class mapping (absent -> 0)."""
    c = table.class_col
    if isinstance(sizes, Mapping):
        spark = table.frame.sparkSession
        schema = StructType([StructField(c, table.frame.schema[c].dataType),
                             StructField(name, LongType())])
        wanted = local_frame(spark, [(k, int(v)) for k, v in sizes.items()], schema)
        t = join_on_class(table.frame, F.broadcast(wanted), c, table.null_safe, "left")
        return t.select(c, N, F.coalesce(F.col(name), lit_long(0)).alias(name))
    return table.frame.select(c, N, lit_long(max(int(sizes), 0)).alias(name))


@any_names("class_col", "id_cols")
def sample_exact(df: DataFrame, class_col: str, id_cols: list[str] | None, sizes: int | Mapping,
                 seed: int = 42, nulls: str = "drop", bucket_rows: int | None = None) -> DataFrame:
    """The first min(n, m) rows of every class in hash order: an exact sample without replacement."""
    id_cols = row_keys(df, id_cols)
    cols = df.columns
    base = keep_classes(df, class_col, nulls)
    table = class_table(base, class_col, nulls)
    if table.count == 0:
        return df.limit(0)
    info = per_class_value(table, sizes, QUOTA)
    x = table.attach(base, info.withColumn(QUOTA, F.least(F.col(N), F.col(QUOTA))))
    x = flag_first(x, table, id_cols, quota=QUOTA, size=N, seed=seed, keep_rest=False,
                   bucket_rows=bucket_rows)
    return select_like(x, cols)


@any_names("id_cols")
def sample_bernoulli(df: DataFrame, id_cols: list[str] | None, fraction: float,
                     seed: int = 42) -> DataFrame:
    """Keep a row when uniform01(seed, ids) < fraction (fraction clamped to [0, 1]); no shuffle.

    Without ids, equal rows are told apart by a number: distinct rows are counted, and each of
    a row's copies is decided for itself (needs columns that can all be grouped by).
    """
    f = min(max(float(fraction), 0.0), 1.0)
    if id_cols:
        return df.filter(uniform01(seed, id_cols) < F.lit(f))
    keys = row_keys(df, None)
    if keys != df.columns:
        raise ValueError("rows with array, map or struct columns need id_cols")
    total = df.count()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(SIZE))
    copies = replicate(counts, SIZE, total, heavy_out=total, index_col=DRAW)
    return copies.filter(uniform01(seed, [*keys, DRAW]) < F.lit(f)).select(*keys)


def draws_with_replacement(base: DataFrame, table: ClassTable, info: DataFrame, size_col: str,
                           id_cols: list[str], seed: int, max_size: int, total: int,
                           bucket_rows: int | None = None) -> DataFrame:
    """``size_col`` uniform draws with replacement per class of ``info``.

    Draw j of class c hits rank floor(uniform01(seed, c, j) * n) + 1 in the class's hash
    order (the bucketed exact rank). Draws are counted by (class, rank) before anything is
    joined, with partial sums per task, so what meets a row is one number however often it
    is drawn; ``replicate`` then spreads the copies over tasks.
    """
    c = table.class_col
    draws = replicate(info.select(c, N, size_col), size_col, max_size, heavy_out=total,
                      index_col=DRAW)
    rank = (F.floor(uniform01(seed, [c, DRAW]) * F.col(N)) + 1).cast("long")
    times = draws.select(c, rank.alias(RANK)).groupBy(c, RANK).agg(F.count(F.lit(1)).alias(TIMES))
    ranked = rank_rows(table.attach(base), table, id_cols, seed, N, bucket_rows).drop(N)
    drawn = join_on_class(ranked, times, c, table.null_safe, "inner", extra_keys=[RANK])
    return replicate(drawn, TIMES, max_size, heavy_out=total)


@any_names("class_col", "id_cols")
def sample_with_replacement(df: DataFrame, class_col: str, id_cols: list[str] | None,
                            sizes: int | Mapping, seed: int = 42, nulls: str = "drop",
                            bucket_rows: int | None = None) -> DataFrame:
    """Exactly ``m`` draws per class (or per-class mapping), uniformly with replacement."""
    id_cols = row_keys(df, id_cols)
    cols = df.columns
    base = keep_classes(df, class_col, nulls)
    table = class_table(base, class_col, nulls)
    if table.count == 0:
        return df.limit(0)
    info = per_class_value(table, sizes, SIZE)
    if isinstance(sizes, Mapping):
        max_size, total = max(sizes.values(), default=0), sum(sizes.values())
    else:
        max_size, total = int(sizes), int(sizes) * table.count
    return select_like(
        draws_with_replacement(base, table, info, SIZE, id_cols, seed, max_size, total, bucket_rows), cols
    )
