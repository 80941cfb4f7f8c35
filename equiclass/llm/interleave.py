"""Sharding by proportional stratified interleaving.

The rows of each source are put in a seeded random order; the row of rank r (from 0) of a
source of n rows gets the fractional rank (r + u) / n, where u in [0, 1) is the source's own
seeded offset (without it, all sources of one row would meet at one point). Sorted by
fractional rank, any stretch of it holds every source in proportion to within one row of
that source; the sorted rows are cut into shards whose sizes differ by one row at most. So
every shard matches the mixture, and so does every beginning of a shard.

Scale. Only the id, source, size and checksum (and columns asked for) are shuffled. No
window runs over a whole source: ranks come from buckets of the random key of about
``BUCKET_ROWS`` rows, plus the sizes of the buckets before; likewise positions in the sorted
order, whose buckets are even because fractional ranks are. The tables of bucket sizes
have a row per bucket.

Null sources are a source of their own; null texts have no bytes (size 1) and the empty
text's checksum. Rows equal in id and text are ordered among themselves by nothing else:
they are interchangeable. An empty table gives an empty result. There may be more shards
than rows: the rest stay empty. Columns that aren't named are neither read nor kept.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Rows of a bucket that one task sorts, on average.
BUCKET_ROWS = 8_192


def _before(counts: DataFrame, bucket: str, by: list[str]) -> DataFrame:
    """Adds ``before``: the rows of all buckets before, in the same group."""
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("rows").over(w), F.lit(0)))


def interleave(docs: DataFrame, shards: int, *, seed: int = 0, id_col: str = "doc_id",
               source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = (),
               bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes and 1), text_crc32, position, shard, slot, and ``keep``.

    slot counts from 0 in each shard, without gaps.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source = F.col(f"`{source_col}`").cast("string")
    kept = [F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), source.alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("stratum"), *kept)
    rows = saved(rows.withColumn("turn", F.shiftrightunsigned(
        F.xxhash64(F.lit(seed), "stratum", "doc_id", "text_crc32"), 1)), "interleave-rows")
    n = rows.count()
    bits = max(0, math.ceil(math.log2(max(1, n / bucket_rows))))

    # Ranks within a source.
    rows = rows.withColumn("bucket", F.shiftrightunsigned("turn", 63 - bits))
    sizes = _before(rows.groupBy("stratum", "bucket").agg(F.count("*").alias("rows")), "bucket", ["stratum"])
    sizes = sizes.withColumn("whole", F.sum("rows").over(Window.partitionBy("stratum"))).drop("rows")
    in_bucket = Window.partitionBy("stratum", "bucket").orderBy("turn", "doc_id", "text_crc32")
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("offset"), "stratum"), 11) / F.lit(float(1 << 53))
    ranked = rows.join(sizes, ["stratum", "bucket"]).withColumn(
        "rank", F.col("before") + F.row_number().over(in_bucket) - 1).withColumn(
        "fraction", (F.col("rank") + unit) / F.col("whole")).drop("bucket", "before", "whole", "rank")

    # Positions among all rows.
    buckets = 1 << bits
    ranked = saved(ranked.withColumn("bucket", F.least(
        F.floor(F.col("fraction") * buckets), F.lit(buckets - 1))), "interleave-ranks")
    sizes = _before(ranked.groupBy("bucket").agg(F.count("*").alias("rows")), "bucket", []).drop("rows")
    in_bucket = Window.partitionBy("bucket").orderBy("fraction", "turn", "stratum", "doc_id", "text_crc32")
    placed = ranked.join(sizes, "bucket").withColumn(
        "position", F.col("before") + F.row_number().over(in_bucket) - 1)
    shard = F.expr(f"position * {shards} div {max(n, 1)}")
    start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return (placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("position") - start)
            .select("doc_id", "source", "size", "text_crc32", "position", "shard", "slot",
                    *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep))))
