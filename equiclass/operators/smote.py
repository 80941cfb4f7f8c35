"""SMOTE: synthetic minority samples between a row and its nearest same-class neighbours.

``smote`` (ratio target, cosine neighbours by default). With class sizes n_c, M = the
largest, ratio q, k neighbours and sampling rate s:

1. classes with n_c <= 1 are dropped (``singleton="keep"`` passes them through);
2. a class is deficient when n_c < M*q and needs trunc(M*q - n_c) new rows;
3. k_c = k if n_c >= k else trunc(n_c/2), and at most n_c - 1;
4. r_c = round-half-up(k_c * s), between 1 and k_c, distinct neighbours per seed;
5. seeds are taken in hash order, each yields r_c rows from r_c of its k_c nearest
   neighbours (picked by hash), until the need is met: only the first ceil(need/r_c)
   seeds are searched at all; a class yields least(need, n_c * r_c) rows;
6. a new row is x + u_i * (y - x) with an independent u_i in [0, 1) per position.

``smote_percent`` follows Chawla et al. (2002): the minority class gets
trunc(n * N / 100) new rows from its k Euclidean neighbours; N >= 100 is rounded down to
a multiple of 100 and every row then yields N/100 rows with the neighbour drawn with
replacement; N < 100 lets the first rows in hash order yield one row each.

Output: (label, features array<double>, is_synthetic, source_id, neighbor_id) — originals
keep their id in ``source_id``; a synthetic row names its seed and neighbour.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import P, ensure_checkpoint_dir
from ..functions.keys import hash_hex, uniform01
from ..functions.vectors import as_double_array, interpolate, to_ml_vector
from .classes import N, ClassTable, class_table, lit_long, local_table
from .neighbors import NID, SID, nearest_neighbors
from .pruned import pruned_neighbors
from .ranking import TAKE, flag_first
from .naming import any_names

ID = P + "id"
FEAT = P + "features"
QUOTA = P + "seeds"
PICK = P + "pick"
PICKS = P + "picks"
LAST = P + "last"
DRAW = P + "draw"
ROWID = P + "rowid"


def smote_plan(n: int, largest: int, k: int, rate: float, ratio: float) -> dict:
    """Per-class numbers of ``smote``: need, k_c, r_c and seeds searched."""
    target = largest * ratio
    need = math.trunc(target - n) if n < target else 0
    kc = k if n >= k else math.trunc(n * 0.5)
    kc = max(0, min(kc, n - 1))
    r = max(1, min(kc, math.floor(kc * rate + 0.5))) if kc else 0
    seeds = min(n, -(-need // r)) if (need and r) else 0
    return {"n": n, "need": need, "k": kc, "r": r, "seeds": seeds}


def _base(df: DataFrame, label_col: str, features_col: str, id_col: str | None) -> DataFrame:
    if id_col is None:
        # No id: number the rows once and keep that numbering in the checkpoint folder, so
        # every branch of the plan (and any retried task) sees the same ids.
        ensure_checkpoint_dir(df.sparkSession)
        df = (df.select(label_col, features_col)
              .withColumn(ROWID, F.monotonically_increasing_id()).checkpoint(eager=True))
        id_col = ROWID
    return (df.where(F.col(label_col).isNotNull())
            .select(F.col(id_col).alias(ID), label_col, as_double_array(df, features_col).alias(FEAT)))


def _originals(base: DataFrame, label_col: str, features_col: str) -> DataFrame:
    return base.select(label_col, F.col(FEAT).alias(features_col), F.lit(False).alias("is_synthetic"),
                       F.col(ID).cast("long").alias("source_id"),
                       F.lit(None).cast("long").alias("neighbor_id"))


def plan_columns(n: Column, largest: int, k: int, rate: float, ratio: float) -> list[Column]:
    """``smote_plan`` as Spark expressions over the class size column ``n``."""
    target = F.lit(float(largest * ratio))
    need = F.when(n.cast("double") < target, F.floor(target - n)).otherwise(0).cast("long")
    kc = F.when(n >= k, F.lit(k)).otherwise(F.floor(n * F.lit(0.5))).cast("long")
    kc = F.greatest(F.lit(0).cast("long"), F.least(kc, n - 1))
    r = F.when(kc > 0, F.greatest(F.lit(1).cast("long"),
                                  F.least(kc, F.floor(kc * F.lit(float(rate)) + F.lit(0.5)).cast("long"))))
    r = r.otherwise(0).cast("long")
    return [need.alias("need"), kc.alias("k"), r.alias("r")]


SEEDS_SQL = f"CASE WHEN need > 0 AND r > 0 THEN least({N}, (need + r - 1) div r) ELSE 0L END"


@any_names("label_col", "features_col", "id_col")
def smote(df: DataFrame, label_col: str = "label", features_col: str = "features",
          id_col: str | None = "id", k: int = 5, sampling_rate: float = 0.5,
          ratio_to_max: float = 0.5,
          seed: int = 42, singleton: str = "drop", metric: str = "cosine",
          vector_output: bool = False) -> DataFrame:
    """SMOTE with a ratio target (see the module text). ``id_col`` must identify a row;
    ``None`` numbers the rows (kept in the checkpoint folder, so ids are stable but depend
    on the input layout). ``vector_output`` returns ML vectors instead of array<double>."""
    out = _smote(df, label_col, features_col, id_col, k, sampling_rate, ratio_to_max, seed,
                 singleton, metric)
    if vector_output:
        return out.withColumn(features_col, to_ml_vector(features_col))
    return out


def _smote(df: DataFrame, label_col: str, features_col: str, id_col: str | None, k: int,
           sampling_rate: float, ratio_to_max: float, seed: int, singleton: str,
           metric: str) -> DataFrame:
    if not 0.0 < sampling_rate <= 1.0:
        raise ValueError("sampling_rate must be in (0, 1]")
    if k < 1:
        raise ValueError("k must be >= 1")
    base = _base(df, label_col, features_col, id_col)
    table = class_table(base, label_col)
    if table.count == 0:
        return _originals(base, label_col, features_col).limit(0)
    n = F.col(N)
    info = (table.frame.select(label_col, N, *plan_columns(n, table.largest, k, sampling_rate,
                                                             ratio_to_max))
            .withColumn(QUOTA, F.expr(SEEDS_SQL)))
    originals = base
    if singleton != "keep" and table.smallest <= 1:
        originals = table.attach(base, info.filter(n > 1).select(label_col))
    out = _originals(originals, label_col, features_col)
    deficient = info.filter((n > 1) & (F.col(QUOTA) > 0))
    counts = None
    if table.local:
        plans = [(c, smote_plan(m, table.largest, k, sampling_rate, ratio_to_max))
                 for c, m in table.rows]
        plans = [(c, p) for c, p in plans if p["n"] > 1 and p["seeds"] > 0]
        if not plans:
            return out
        counts = [(c, p["seeds"], p["n"]) for c, p in plans]
    syn = _synthesize(base, table, deficient, label_col, seed, metric, counts)
    return out.unionByName(syn.withColumnRenamed(FEAT, features_col))


def _synthesize(base: DataFrame, table: ClassTable, deficient: DataFrame, label_col: str,
                seed: int, metric: str, counts: list | None) -> DataFrame:
    rows = table.attach(base, deficient)                # deficient classes only, with their plan
    # Seeds: the first ``seeds`` rows in hash order. Every seed yields r rows except the
    # last one, which yields what is left of the need: only that seed must be identified.
    seeds = flag_first(rows, table, [ID], quota=QUOTA, size=N, seed=seed, keep_rest=False,
                       edge_rank=LAST)
    is_last = F.coalesce(F.col(LAST) == F.col(QUOTA), F.lit(False))
    quota_left = F.least(F.col("r"), F.col("need") - (F.col(QUOTA) - 1) * F.col("r"))
    seeds = seeds.withColumn(PICKS, F.when(is_last, quota_left).otherwise(F.col("r")))
    nn = nearest_neighbors(
        seeds.select(label_col, ID, FEAT, "k", PICKS), rows.select(label_col, ID, FEAT),
        label_col, ID, FEAT, k="k", metric=metric, with_vectors=True, counts=counts,
        carry=[PICKS])
    w = Window.partitionBy(label_col, SID).orderBy(hash_hex(seed, [SID, NID]), NID)
    picks = nn.withColumn(PICK, F.row_number().over(w)).filter(F.col(PICK) <= F.col(PICKS))
    gap = lambda i: uniform01(seed, [F.col(SID), F.col(NID), i])
    return picks.select(
        label_col, interpolate("seed_vec", "neighbor_vec", gap).alias(FEAT),
        F.lit(True).alias("is_synthetic"), F.col(SID).alias("source_id"),
        F.col(NID).alias("neighbor_id"))


@any_names("label_col", "features_col", "id_col")
def smote_percent(df: DataFrame, label_col: str = "label", features_col: str = "features",
                  id_col: str | None = "id", percent: int = 100, k: int = 5, seed: int = 42,
                  class_value=None, metric: str = "euclidean") -> DataFrame:
    """SMOTE with a percent target on the minority class (or ``class_value``); see the
    module text. Originals of every class are returned with the synthetic rows."""
    spark = df.sparkSession
    base = _base(df, label_col, features_col, id_col)
    table = class_table(base, label_col)
    out = _originals(base, label_col, features_col)
    if table.count == 0 or percent <= 0:
        return out
    if table.local:
        if class_value is None:
            class_value = min(table.rows, key=lambda r: (r[1], r[0]))[0]
        n = table.sizes().get(class_value, 0)
    else:  # many classes: look the class up in the checkpointed table
        pick = (table.frame.orderBy(F.col(N), F.col(label_col)) if class_value is None
                else table.frame.filter(F.col(label_col) == F.lit(class_value)))
        row = pick.first()
        class_value, n = (row[0], int(row[1])) if row else (class_value, 0)
    kc = min(k, n - 1)
    if kc < 1:
        return out
    if percent < 100:
        n_seeds, per_seed = math.trunc(n * percent / 100), 1
    else:
        n_seeds, per_seed = n, percent // 100
    if n_seeds == 0:
        return out
    label_type = base.schema[label_col].dataType
    table1 = local_table(spark, label_col, label_type, [(class_value, n)])
    rows = table1.attach(base)
    seeds = rows
    if n_seeds < n:
        seeds = flag_first(rows.withColumn(QUOTA, lit_long(n_seeds)), table1, [ID], quota=QUOTA,
                           size=N, seed=seed, keep_rest=False).drop(TAKE, QUOTA)
    nn = pruned_neighbors(seeds.select(label_col, ID, FEAT), rows.select(label_col, ID, FEAT),
                          label_col, ID, FEAT, k=kc, metric=metric, with_vectors=True,
                          counts=[(class_value, n_seeds, n)])
    # Draw j of a seed takes the neighbour of rank floor(u(seed, j) * k) + 1; each
    # neighbour row finds the draws that hit it in place, so no join is needed.
    hits = F.filter(F.sequence(F.lit(1), F.lit(int(per_seed))),
                    lambda j: F.floor(uniform01(seed, [F.col(SID), j]) * kc) + 1 == F.col("k_rank"))
    picked = nn.withColumn(DRAW, F.explode(hits))
    gap = lambda i: uniform01(seed, [F.col(SID), F.col(DRAW), i])
    syn = picked.select(
        label_col, interpolate("seed_vec", "neighbor_vec", gap).alias(features_col),
        F.lit(True).alias("is_synthetic"), F.col(SID).alias("source_id"),
        F.col(NID).alias("neighbor_id"))
    return out.unionByName(syn)
