"""Row replication by a per-row count, without letting one task emit a huge share."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..config import P

CHUNK = P + "chunk"
COPY = P + "copy"
MAX_SPREAD = 200_000


def _expand(df: DataFrame, cnt) -> DataFrame:
    return df.withColumn(COPY, F.explode(F.sequence(F.lit(1).cast("long"), cnt.cast("long"))))


def replicate(df: DataFrame, count_col: str, max_count: int, heavy_out: int = 0,
              chunk: int | None = None, index_col: str | None = None) -> DataFrame:
    """Emit every row ``count_col`` times (0 drops it).

    Rows copied at least ``config.HEAVY_COPIES`` times are the ones that can swamp a
    task (a partition of a small class against a huge majority). When their total
    output ``heavy_out`` (known on the driver from the class table) exceeds
    ``config.ROWS_PER_TASK``, they are cut into chunks of at most ``chunk`` copies, the
    chunks are spread round-robin over ceil(heavy_out / ROWS_PER_TASK) partitions and only
    then expanded: the shuffle moves input rows, never the copies. All other rows are
    expanded in place. ``index_col`` receives the copy number (1-based) when given.
    """
    cnt = F.col(count_col)
    chunk = chunk or config.COPY_CHUNK
    heavy_min = config.HEAVY_COPIES
    per_task = config.ROWS_PER_TASK
    if max_count < heavy_min or heavy_out <= per_task:
        out = _expand(df.filter(cnt > 0), cnt)
    else:
        light = _expand(df.filter((cnt > 0) & (cnt < heavy_min)), cnt)
        size = F.lit(int(chunk)).cast("long")
        chunks = (df.filter(cnt >= heavy_min)
                  .withColumn(CHUNK, F.explode(F.sequence(F.lit(0).cast("long"),
                                                          F.floor((cnt - 1) / size).cast("long")))))
        parts = max(1, min(math.ceil(heavy_out / per_task), MAX_SPREAD))
        chunks = chunks.repartition(parts)
        first = F.col(CHUNK) * size + 1
        last = F.least(cnt.cast("long"), (F.col(CHUNK) + 1) * size)
        heavy = chunks.withColumn(COPY, F.explode(F.sequence(first, last))).drop(CHUNK)
        out = light.unionByName(heavy)
    if index_col:
        return out.withColumnRenamed(COPY, index_col)
    return out.drop(COPY)
