"""Numeric -> nominal: replace a column's values by their position among the distinct values.

Codes are 0..m-1 in ascending value order (the attribute becomes nominal with one label
per distinct value); nulls stay null. The distinct-value table is size-checked: up to
``MAX_LOCAL_CLASSES`` values they are sorted, numbered on the driver and broadcast; above
that it is numbered with a range partitioning (per-partition row numbers plus offsets
of the earlier partitions) and joined back by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import config
from ..config import P, ensure_checkpoint_dir
from .classes import _approx_bytes, local_frame
from .naming import any_names

PID = P + "pid"
PCNT = P + "pcnt"
POFF = P + "poff"


def _number_distributed(values: DataFrame, col: str, code_col: str) -> DataFrame:
    spark = values.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    ranged = values.repartitionByRange(parts, col).withColumn(PID, F.spark_partition_id())
    # Both uses below must see the same range split: materialize it once.
    ensure_checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    per_part = ranged.groupBy(PID).agg(F.count(F.lit(1)).alias(PCNT))
    before = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn(POFF, F.coalesce(F.sum(PCNT).over(before), F.lit(0)))
    within = Window.partitionBy(PID).orderBy(col)
    return (ranged.join(F.broadcast(offsets.drop(PCNT)), PID)
            .select(col, (F.col(POFF) + F.row_number().over(within) - 1).cast("int").alias(code_col)))


@any_names("col")
def nominal_index(df: DataFrame, col: str, code_col: str | None = None,
                  max_local: int | None = None) -> DataFrame:
    """Add ``code_col`` (default ``<col>_code``): 0-based rank of the value among distinct values."""
    code_col = code_col or f"{col}_code"
    max_local = config.MAX_LOCAL_CLASSES if max_local is None else max_local
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    first = values.orderBy(col).limit(max_local + 1).collect()
    if len(first) <= max_local and _approx_bytes(first) <= config.MAX_LOCAL_BYTES:
        # Bounded: number the sorted values on the driver and broadcast a local table.
        schema = StructType([values.schema[col], StructField(code_col, IntegerType(), False)])
        codes = local_frame(df.sparkSession, [(r[0], i) for i, r in enumerate(first)], schema)
        return df.join(F.broadcast(codes), col, "left").select(*df.columns, code_col)
    codes = _number_distributed(values, col, code_col)
    return df.join(codes, col, "left").select(*df.columns, code_col)
