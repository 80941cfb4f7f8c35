"""Random oversampling to the majority class.

Per class with n rows and majority size M: every row is kept ``M div n`` times and the
first ``M mod n`` rows in hash order once more, so every class ends with exactly M rows.
The majority passes unchanged. One plan: class table (broadcast) -> bucket offsets ->
per-row copy count -> explode. No per-class filters, unions or driver round trips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..config import P
from .classes import N, class_table, keep_classes, lit_long, row_keys, select_like
from .ranking import TAKE, flag_first
from .replicate import replicate
from .naming import any_names

COPIES = P + "copies"
REM = P + "rem"
MULT = P + "mult"


@any_names("class_col", "id_cols")
def oversample(df: DataFrame, class_col: str, id_cols: list[str] | None = None, seed: int = 42,
               nulls: str = "drop", chunk: int | None = None, bucket_rows: int | None = None) -> DataFrame:
    """Every class to exactly the majority size M: each row ``M div n`` times, plus the first
    ``M mod n`` rows of the class in hash order of (``seed``, ``id_cols``) once more.

    ``id_cols`` identify a row (default: all orderable columns); ``nulls`` is "drop" or
    "keep"; ``bucket_rows`` overrides the rows of a rank bucket.
    """
    id_cols = row_keys(df, id_cols)
    cols = df.columns
    base = keep_classes(df, class_col, nulls)
    table = class_table(base, class_col, nulls)
    if table.count == 0:
        return df.limit(0)
    m = table.largest
    info = table.frame.select(
        class_col, F.col(N),
        F.expr(f"CAST({m} AS BIGINT) div {N}").alias(COPIES),
        (lit_long(m) % F.col(N)).alias(REM),
    )
    x = table.attach(base, info)
    needing = sum(1 for _, n in table.rows if m % n) if table.local else table.count
    if needing:
        x = flag_first(x, table, id_cols, quota=REM, size=N, seed=seed, keep_rest=True,
                       bucket_rows=bucket_rows)
    else:  # every class size divides M: whole copies only, no ranking needed
        x = x.withColumn(TAKE, F.lit(False))
    x = x.withColumn(MULT, F.col(COPIES) + F.col(TAKE).cast("long"))
    max_copies = -(-m // table.smallest)
    if table.local:
        heavy_out = sum(n * (m // n + 1) for _, n in table.rows if m // n + 1 >= config.HEAVY_COPIES)
    else:
        heavy_out = table.count * m
    return select_like(replicate(x, MULT, max_copies, heavy_out, chunk), cols)
