"""Exact per-class ranks in hash order, without a one-task-per-class window.

A row's rank inside its class is its position when the class is sorted by
``(md5(seed|ids), ids)``. ``partitionBy(class)`` would put a hot class into one task, so
a prefix of the hash splits big classes into buckets: a class of n rows uses
d = ceil(log16(n / RANK_BUCKET_ROWS)) hex digits (0 for small classes: one bucket), so a
bucket holds about ``RANK_BUCKET_ROWS`` rows at most, whatever the class size. Sorting by
(bucket, hash) is sorting by hash, so ranks do not depend on the bucket layout.

- ``flag_first`` (the first q rows of each class): bucket counts give, per class, the one
  bucket that holds the q-th row and the rows before it; that bucket's (class, ids) alone
  are shuffled and sorted to find the q-th row's (hash, ids), the class's cut. One row per
  class goes back, and a single wide pass compares each row with its class's cut: no wide
  row is shuffled or sorted. Only where several rows have exactly the cut's hash and ids
  (no ids given and equal rows, say) are the edge bucket's rows sorted whole.
- ``rank_rows`` (every row's rank): row_number per (class, bucket), then the offsets of
  the earlier buckets are joined on (class, bucket) *after* the window, so a shuffled join
  reuses the window's partitioning instead of moving the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .. import config
from ..config import P
from ..functions.keys import hash_hex
from .classes import ClassTable, join_on_class, local_frame, maybe_broadcast

H = P + "h"
B = P + "b"
CNT = P + "bcnt"
OFF = P + "boff"
EB = P + "eb"
EOFF = P + "eoff"
NEXT = P + "next"
CUT = P + "cut"
TIED = P + "tied"
RN = P + "rn"
RANK = P + "rank"
TAKE = P + "take"
MAX_DIGITS = 7


def bucket_digits(n: str, bucket_rows: int | None = None) -> Column:
    """Hex digits of the hash prefix for a class of ``n`` rows (``n`` a column name)."""
    per = bucket_rows or config.RANK_BUCKET_ROWS
    arms = " ".join(f"WHEN {n} <= {per * 16 ** k} THEN {k}" for k in range(MAX_DIGITS))
    return F.expr(f"CASE {arms} ELSE {MAX_DIGITS} END")


def bucket_count(n: int, bucket_rows: int | None = None) -> int:
    """Upper bound of the buckets of a class of ``n`` rows (driver side)."""
    per = bucket_rows or config.RANK_BUCKET_ROWS
    k = 0
    while k < MAX_DIGITS and n > per * 16 ** k:
        k += 1
    return min(n, 16 ** k)


def _hashed(df: DataFrame, seed: int | str, id_cols: list[str], size: str,
            bucket_rows: int | None, when: Column | None = None,
            with_hash: bool = True) -> DataFrame:
    """Add the bucket ``B`` (and, with ``with_hash``, the full hash ``H``).

    A class of one bucket gets "" without hashing; with ``when`` only those rows are
    hashed, the others also get "" (their bucket is never looked at).
    """
    h = hash_hex(seed, id_cols)
    d = bucket_digits(size, bucket_rows)
    need = d > 0 if when is None else (d > 0) & when
    cols = {B: F.when(need, F.substring(h, F.lit(1), d)).otherwise(F.lit(""))}
    if with_hash:
        cols[H] = h
    return df.withColumns(cols)


def _order(id_cols: list[str]) -> list[Column]:
    return [F.col(H)] + [F.col(c) for c in id_cols]


def bucket_offsets(hashed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., bucket, rows in bucket, rows in earlier buckets of the class)."""
    counts = hashed.groupBy(*keys, B).agg(F.count(F.lit(1)).alias(CNT))
    before = (Window.partitionBy(*keys).orderBy(B)
              .rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn(OFF, F.coalesce(F.sum(CNT).over(before), F.lit(0)).cast("long"))


def flag_first(df: DataFrame, table: ClassTable, id_cols: list[str], quota: str, size: str,
               seed: int | str, keep_rest: bool, edge_rank: str | None = None,
               bucket_rows: int | None = None) -> DataFrame:
    """Mark (``TAKE``) the first ``quota`` rows of every class in hash order.

    ``df`` already carries the per-class ``quota`` and ``size`` columns. With
    ``keep_rest=False`` the rows not taken are dropped instead of flagged. With
    ``edge_rank`` the quota-th row of a class gets its rank in that column (others null, or
    their own rank).
    """
    c = table.class_col
    q, n = F.col(quota), F.col(size)
    partial = (q > 0) & (q <= n)
    per = bucket_rows or config.RANK_BUCKET_ROWS
    # Buckets only matter for classes cut somewhere inside; the full hash (to sort) only
    # for the rows of the edge bucket, computed after the filter below.
    keys = [c] + [k for k in id_cols if k != c]
    narrow = _hashed(df.select(*keys, quota, size).filter(partial), seed, id_cols, size, bucket_rows,
                     with_hash=False)
    offs = bucket_offsets(narrow.select(c, quota, B), [c, quota])
    edges = (offs.filter((F.col(OFF) < q) & (F.col(OFF) + F.col(CNT) >= q))
             .select(c, F.col(B).alias(EB), F.col(OFF).alias(EOFF)))
    edge_schema = StructType([table.frame.schema[c], StructField(EB, StringType()),
                              StructField(EOFF, LongType())])
    if table.local:
        # At most one row per class. A class of at most ``per`` rows is one bucket: its edge
        # is ("", 0) without a job; only bigger classes need their buckets counted.
        rows = [(k, "", 0) for k, m in table.rows if m <= per]
        big = [k for k, m in table.rows if m > per]
        if big:
            big_t = local_frame(df.sparkSession, [(k,) for k in big],
                                StructType([table.frame.schema[c]]))
            rows += [tuple(r) for r in join_on_class(edges, F.broadcast(big_t), c,
                                                     table.null_safe).collect()]
        edges = F.broadcast(local_frame(df.sparkSession, rows, edge_schema))
    w = Window.partitionBy(c, B).orderBy(*_order(id_cols))
    key = F.struct(F.col(H), *[F.col(k) for k in id_cols])
    ranked = (join_on_class(narrow, edges, c, table.null_safe).filter(F.col(B) == F.col(EB))
              .withColumn(H, hash_hex(seed, id_cols))
              .withColumns({RN: F.col(EOFF) + F.row_number().over(w), NEXT: F.lead(key).over(w)}))
    cuts = ranked.filter(F.col(RN) == q).select(
        c, key.alias(CUT), F.coalesce(key == F.col(NEXT), F.lit(False)).alias(TIED))
    if table.local:
        found = cuts.collect()                 # one row per cut class
        if any(r[TIED] for r in found):
            return _flag_first_sorted(df, table, id_cols, quota, size, seed, keep_rest, edge_rank, bucket_rows,
                                      edges)
        cuts = F.broadcast(local_frame(df.sparkSession, [tuple(r)[:2] for r in found],
                                               cuts.drop(TIED).schema))
    elif not cuts.filter(TIED).isEmpty():
        return _flag_first_sorted(df, table, id_cols, quota, size, seed, keep_rest, edge_rank, bucket_rows, edges)
    else:
        cuts = cuts.drop(TIED)
    x = join_on_class(df, cuts, c, table.null_safe, "left")
    own = F.struct(F.when(partial & (q < n), hash_hex(seed, id_cols)).alias(H), *[F.col(k) for k in id_cols])
    if edge_rank is not None:
        own = F.struct(F.when(partial, hash_hex(seed, id_cols)).alias(H), *[F.col(k) for k in id_cols])
    x = x.withColumn(TAKE, F.when(q >= n, True).when(q <= 0, False).otherwise(own <= F.col(CUT)))
    if edge_rank is not None:
        x = x.withColumn(edge_rank, F.when(partial & (own == F.col(CUT)), q))
    return (x if keep_rest else x.filter(F.col(TAKE))).drop(CUT)


def _flag_first_sorted(df: DataFrame, table: ClassTable, id_cols: list[str], quota: str, size: str,
                       seed: int | str, keep_rest: bool, edge_rank: str | None, bucket_rows: int | None,
                       edges: DataFrame) -> DataFrame:
    """``flag_first`` where rows with equal hash and ids meet the cut: the edge buckets are sorted whole.

    Rows decided by their bucket and rows of the edge buckets are two branches of a union.
    """
    c = table.class_col
    q, n = F.col(quota), F.col(size)
    partial = (q > 0) & (q <= n)
    hashed = _hashed(df, seed, id_cols, size, bucket_rows, when=partial, with_hash=False)
    x = join_on_class(hashed, edges, c, table.null_safe, "left")
    b, eb = F.col(B), F.col(EB)
    edge = partial & (b == eb)
    whole = F.when(q >= n, True).when(q <= 0, False).otherwise(b < eb)
    w = Window.partitionBy(c, B).orderBy(*_order(id_cols))
    ranked = (x.filter(edge).withColumn(H, hash_hex(seed, id_cols))
              .withColumn(RN, F.col(EOFF) + F.row_number().over(w)))
    plain = x.filter(~F.coalesce(edge, F.lit(False)))
    if keep_rest:
        plain = plain.withColumn(TAKE, whole)
    else:
        plain = plain.filter(whole).withColumn(TAKE, F.lit(True))
    straddle = ranked.withColumn(TAKE, F.col(RN) <= q).drop(H)
    if edge_rank is not None:
        plain = plain.withColumn(edge_rank, F.lit(None).cast("long"))
        straddle = straddle.withColumnRenamed(RN, edge_rank)
    else:
        straddle = straddle.drop(RN)
    if not keep_rest:
        straddle = straddle.filter(F.col(TAKE))
    return plain.unionByName(straddle).drop(B, EB, EOFF)


def rank_rows(df: DataFrame, table: ClassTable, id_cols: list[str], seed: int | str,
              size: str, bucket_rows: int | None = None) -> DataFrame:
    """Add ``RANK`` (1..n) to every row: the exact position in hash order inside its class.

    ``df`` carries the class size column ``size``.
    """
    c = table.class_col
    hashed = _hashed(df, seed, id_cols, size, bucket_rows)
    per = bucket_rows or config.RANK_BUCKET_ROWS
    offsets = bucket_offsets(hashed.select(c, B), [c]).drop(CNT)
    if table.local and all(m <= per for _, m in table.rows):
        # Every class is one bucket: offsets are ("", 0), known without counting.
        offsets = F.broadcast(local_frame(df.sparkSession, [(k, "", 0) for k, _ in table.rows],
                                          offsets.schema))
        bound = 0
    elif table.local:
        bound = sum(bucket_count(m, bucket_rows) for _, m in table.rows)
    else:
        bound = table.count + table.total // per
    w = Window.partitionBy(c, B).orderBy(*_order(id_cols))
    ranked = hashed.withColumn(RN, F.row_number().over(w))
    x = join_on_class(ranked, offsets if bound == 0 else maybe_broadcast(offsets, bound), c,
                      table.null_safe, "inner", extra_keys=[B])
    return x.withColumn(RANK, F.col(OFF) + F.col(RN)).drop(H, B, OFF, RN)
