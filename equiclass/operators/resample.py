"""Uniform resampling with replacement, with a bias towards equal class sizes.

Size of class c (n_c rows, N rows in C classes, bias b, size percent P):

    size_c = trunc(P / 100 * ((1 - b) * n_c + b * N / C))

b = 0 keeps the class distribution, b = 1 makes it uniform. Without an explicit P the
default is P = ceil(majority% * C * 10) / 10, so that with b = 1 every class reaches
about the majority size (for two classes: twice the majority share, rounded up to 0.1).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import P
from .classes import N, class_table, keep_classes, row_keys, select_like
from .sample import draws_with_replacement
from .naming import any_names

SIZE = P + "size"


def default_size_percent(largest: int, total: int, classes: int) -> float:
    majority_pct = largest / total * 100
    return math.ceil(majority_pct * classes * 10) / 10


@any_names("class_col", "id_cols")
def resample_uniform(df: DataFrame, class_col: str, id_cols: list[str] | None = None,
                     bias: float = 1.0, size_percent: float | None = None, seed: int = 42,
                     nulls: str = "drop", bucket_rows: int | None = None) -> DataFrame:
    """Draw ``size_c`` rows with replacement per class (formula in the module text)."""
    id_cols = row_keys(df, id_cols)
    if not 0.0 <= bias <= 1.0:
        raise ValueError("bias must be in [0, 1]")
    cols = df.columns
    base = keep_classes(df, class_col, nulls)
    table = class_table(base, class_col, nulls)
    if table.count == 0:
        return df.limit(0)
    pct = size_percent if size_percent is not None else default_size_percent(
        table.largest, table.total, table.count)
    scale = pct / 100
    uniform_part = bias * table.total / table.count
    size = F.lit(scale) * (F.lit(1.0 - bias) * F.col(N) + F.lit(uniform_part))
    info = table.frame.select(class_col, N, F.floor(size).cast("long").alias(SIZE))
    if table.local:
        sizes = [math.floor(scale * ((1.0 - bias) * n + uniform_part)) for _, n in table.rows]
        max_size, total = max(sizes), sum(sizes)
    else:
        max_size = math.floor(scale * ((1.0 - bias) * table.largest + uniform_part))
        total = max_size * table.count
    out = draws_with_replacement(base, table, info, SIZE, id_cols, seed, max_size, total, bucket_rows)
    return select_like(out, cols)
