"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ensure_checkpoint_dir

# Python tasks carry the helpers by value: workers need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: White space of the word rule ``[^\x20\x09-\x0D]+`` (a Java regular expression class).
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the driver and the executors share.

    That is ``spark.checkpoint.dir``; only a local session without one gets a temporary
    folder. Files stay until that folder is cleaned, as checkpoints do.
    """
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(id_col: str | Column, folds: int) -> Column:
    """True where crc32(id as text) mod ``folds`` is 0 (a null id counts as the empty text)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % F.lit(folds) == 0


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
