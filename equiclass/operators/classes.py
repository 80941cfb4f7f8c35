"""The class table: one row per class with its size, and the way it meets the rows.

The class table is the only thing the rebalancing operators need on the driver. It is
computed with a partial + final hash aggregate (map-side combine, so a class holding a
third of all rows costs one row per task in the shuffle). Its size is then *checked*:
up to ``MAX_LOCAL_CLASSES`` rows it is collected once and broadcast; above that it is
checkpointed to the shared checkpoint folder and joined by a shuffle on the class
(AQE's skew-join split handles a hot class there, since the class side has one row per key).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BinaryType, BooleanType, DateType, LongType, NumericType, StringType,
                               StructField, StructType, TimestampNTZType, TimestampType)

from .. import config
from ..config import P, ensure_checkpoint_dir
from .naming import any_names

N = P + "n"


_ORDERABLE = (NumericType, StringType, BooleanType, DateType, TimestampType, TimestampNTZType,
              BinaryType)


def row_keys(df: DataFrame, id_cols: list[str] | None) -> list[str]:
    """Columns that identify a row for hashing and tie-breaks.

    Default: every column of an orderable atomic type, in order (rows equal on all of them
    are interchangeable). Pass integer or string ids to compare results with another engine.
    """
    if id_cols:
        return list(id_cols)
    keys = [f.name for f in df.schema.fields if isinstance(f.dataType, _ORDERABLE)]
    if not keys:
        raise ValueError("no orderable column identifies the rows: pass id_cols")
    return keys


def keep_classes(df: DataFrame, class_col: str, nulls: str = "drop") -> DataFrame:
    """Apply the null-class policy: ``drop`` removes null-class rows, ``keep`` makes null a class."""
    if nulls == "drop":
        return df.filter(F.col(class_col).isNotNull())
    if nulls == "keep":
        return df
    raise ValueError(f"nulls must be 'drop' or 'keep', not {nulls!r}")


@any_names("class_col")
def class_rows(df: DataFrame, class_col: str, value) -> DataFrame:
    """The rows of one class (``None``: the rows without a class)."""
    return df.filter(F.col(class_col).eqNullSafe(F.lit(value)))


@dataclass
class ClassTable:
    frame: DataFrame          # class_col, _ec_n
    class_col: str
    count: int                # number of classes
    total: int                # rows over all classes
    largest: int
    smallest: int
    local: bool               # collected + broadcastable
    null_safe: bool
    rows: list = field(default_factory=list)   # (class, n) when local

    def sizes(self) -> dict:
        return {r[0]: r[1] for r in self.rows}

    def lookup(self, extra: DataFrame | None = None) -> DataFrame:
        """The class frame (or a derived one), with a broadcast hint when its size is proven."""
        t = self.frame if extra is None else extra
        return F.broadcast(t) if self.local else t

    def attach(self, df: DataFrame, info: DataFrame | None = None, how: str = "inner") -> DataFrame:
        """Join per-class columns onto the rows; no shuffle of the rows when local."""
        return join_on_class(df, self.lookup(info), self.class_col, self.null_safe, how)


def local_frame(spark, rows: list[tuple], schema: StructType) -> DataFrame:
    """A small driver-held table as a ``LocalRelation`` (broadcast without a Spark job).

    Built through pandas + Arrow; falls back to a plain ``createDataFrame`` for types
    that do not convert.
    """
    import pandas as pd

    cols = {f.name: pd.Series([r[i] for r in rows], dtype=object) for i, f in enumerate(schema.fields)}
    try:
        return spark.createDataFrame(pd.DataFrame(cols), schema=schema)
    except Exception:  # noqa: BLE001 - any conversion problem: take the generic path
        return spark.createDataFrame(rows, schema=schema)


def local_table(spark, class_col: str, class_type, rows: list[tuple], null_safe: bool = False) -> ClassTable:
    """A ClassTable from (class, n) pairs the caller already holds (bounded, broadcastable)."""
    schema = StructType([StructField(class_col, class_type), StructField(N, LongType(), False)])
    pairs = [(c, int(n)) for c, n in rows]
    counts = [n for _, n in pairs]
    return ClassTable(
        frame=local_frame(spark, pairs, schema), class_col=class_col, count=len(pairs),
        total=sum(counts), largest=max(counts, default=0), smallest=min(counts, default=0),
        local=True, null_safe=null_safe, rows=pairs,
    )


def join_on_class(left: DataFrame, right: DataFrame, class_col: str, null_safe: bool,
                  how: str = "inner", extra_keys: list[str] | None = None) -> DataFrame:
    keys = [class_col] + list(extra_keys or [])
    if not null_safe:
        return left.join(right, keys, how)
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, P + "r_" + k)
    cond = [left[k].eqNullSafe(renamed[P + "r_" + k]) for k in keys]
    out = left.join(renamed, cond, how)
    return out.drop(*[P + "r_" + k for k in keys])


def _approx_bytes(rows: list) -> int:
    return sum(len(str(r[0])) + 16 for r in rows)


def class_table(df: DataFrame, class_col: str, nulls: str = "drop",
                max_local: int | None = None) -> ClassTable:
    """Count rows per class and size-check the result (one small job)."""
    max_local = config.MAX_LOCAL_CLASSES if max_local is None else max_local
    base = keep_classes(df, class_col, nulls)
    sizes = base.groupBy(class_col).agg(F.count(F.lit(1)).alias(N))
    rows = sizes.limit(max_local + 1).collect()
    spark = df.sparkSession
    if len(rows) <= max_local and _approx_bytes(rows) <= config.MAX_LOCAL_BYTES:
        pairs = [(r[0], int(r[1])) for r in rows]
        frame = local_frame(spark, pairs, sizes.schema)
        counts = [n for _, n in pairs]
        return ClassTable(
            frame=frame, class_col=class_col, count=len(pairs), total=sum(counts),
            largest=max(counts, default=0), smallest=min(counts, default=0),
            local=True, null_safe=(nulls == "keep"), rows=pairs,
        )
    ensure_checkpoint_dir(spark)
    frame = sizes.checkpoint(eager=True)
    s = frame.agg(
        F.count(F.lit(1)).alias("c"), F.sum(N).alias("t"), F.max(N).alias("mx"), F.min(N).alias("mn")
    ).first()
    return ClassTable(
        frame=frame, class_col=class_col, count=int(s["c"]), total=int(s["t"]),
        largest=int(s["mx"]), smallest=int(s["mn"]), local=False, null_safe=(nulls == "keep"),
    )


def maybe_broadcast(frame: DataFrame, bound: int, limit: int | None = None) -> DataFrame:
    """Broadcast a lazily computed lookup only when its row count is bounded by ``limit``."""
    limit = config.MAX_BROADCAST_ROWS if limit is None else limit
    return F.broadcast(frame) if bound <= limit else frame


def select_like(df: DataFrame, columns: list[str]) -> DataFrame:
    """Back to the input's columns, order and metadata."""
    return df.select(*[F.col(c) for c in columns])


def lit_long(v: int) -> Column:
    return F.lit(int(v)).cast("long")
