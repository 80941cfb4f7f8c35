"""Undersampling: cap every class relative to the smallest, or thin one class against another."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import P
from ..functions.keys import uniform01
from .classes import (N, class_table, keep_classes, lit_long, local_table, row_keys,
                      select_like)
from .ranking import flag_first
from .sample import sample_bernoulli
from .naming import any_names

TARGET = P + "target"


@any_names("class_col", "id_cols")
def undersample_spread(df: DataFrame, class_col: str, id_cols: list[str] | None = None,
                       spread: float = 1.0, seed: int = 42, nulls: str = "drop",
                       bucket_rows: int | None = None) -> DataFrame:
    """Keep at most floor(spread * smallest) rows per class, the first ones in hash order.

    ``spread`` >= 1 is the largest allowed ratio between a class and the smallest class;
    1 makes every class as small as the smallest one. Without replacement.
    """
    id_cols = row_keys(df, id_cols)
    if spread < 1.0:
        raise ValueError("spread must be >= 1")
    cols = df.columns
    base = keep_classes(df, class_col, nulls)
    table = class_table(base, class_col, nulls)
    if table.count == 0:
        return df.limit(0)
    cap = math.floor(spread * table.smallest)
    info = table.frame.select(class_col, N, F.least(F.col(N), lit_long(cap)).alias(TARGET))
    needing = sum(1 for _, n in table.rows if n > cap) if table.local else table.count
    if needing == 0:
        return select_like(base, cols)
    x = table.attach(base, info)
    x = flag_first(x, table, id_cols, quota=TARGET, size=N, seed=seed, keep_rest=False,
                   bucket_rows=bucket_rows)
    return select_like(x, cols)


@any_names("class_col", "id_cols")
def undersample_pair(df: DataFrame, class_col: str, id_cols: list[str] | None, key, second_key,
                     ratio: float = 1.0, seed: int = 42, exact: bool = False) -> DataFrame:
    """Keep class ``key`` whole and sample class ``second_key`` to about ``ratio`` x its size.

    With A = rows of ``key`` and B = rows of ``second_key``: Bernoulli fraction
    least(1, ratio * A / B) on B, or with ``exact`` the first least(B, floor(ratio * A))
    rows of B in hash order. Rows of all other classes are dropped; B = 0 yields A alone.
    One read of the whole rows: a predicate on class and hash.
    """
    if key == second_key:
        raise ValueError("key and second_key must be different classes")
    cols = df.columns
    pair = df.filter(F.col(class_col).isin([key, second_key]))
    counts = {r[0]: int(r[1]) for r in
              pair.groupBy(class_col).agg(F.count(F.lit(1))).collect()}
    a, b = counts.get(key, 0), counts.get(second_key, 0)
    first, second = F.col(class_col) == F.lit(key), F.col(class_col) == F.lit(second_key)
    if b == 0:
        return select_like(pair.filter(first), cols)
    if exact:
        table = local_table(df.sparkSession, class_col, df.schema[class_col].dataType, list(counts.items()))
        quota = F.when(second, lit_long(min(b, math.floor(ratio * a)))).otherwise(F.col(N))
        x = table.attach(pair, table.frame.withColumn(TARGET, quota))
        return select_like(flag_first(x, table, row_keys(df, id_cols), quota=TARGET, size=N, seed=seed,
                                      keep_rest=False), cols)
    fraction = min(1.0, ratio * a / b)
    if id_cols:
        return select_like(pair.filter(first | (uniform01(seed, id_cols) < F.lit(fraction))), cols)
    rest = sample_bernoulli(pair.filter(second), None, fraction, seed=seed)
    return select_like(rest.unionByName(pair.filter(first)), cols)
