"""Exact k nearest neighbours inside each class, computed in bounded tiles.

Every class is cut into seed blocks and candidate blocks (``pmod(xxhash64(id), blocks)``): of about
``tile`` rows while these are ``BLOCK_SIDE`` at most, larger ones up to ``BLOCK_ROWS`` rows otherwise.
Each seed is sent to every candidate block of its class and each candidate to every seed block, so
one (class, seed block, candidate block) group is one bounded task. A cogrouped ``applyInPandas``
scores it piece by piece with numpy (``top_pairs``) and emits only its top k per seed; a window with
a group limit then merges these lists into the exact top k. No pair is ever emitted as a row, no
class is gathered in one task, and nothing passes through the driver.

Scores are summed as a left fold in vector order (like ``aggregate``/``list_reduce``
in SQL), so the same numbers come out of Spark and of a SQL engine. Ties are broken by
the smaller neighbour id.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, LongType, StructField, StructType)

from pyspark import cloudpickle

from ..config import BLOCK_ROWS, BLOCK_SIDE, P, TILE_ROWS
from .classes import N, ClassTable, class_table, join_on_class, local_frame

# The tile scorer runs in Python workers, which need not have this package installed:
# ship this module's functions by value with each task instead of by import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SB = P + "sb"
CB = P + "cb"
SBN = P + "sbn"
CBN = P + "cbn"
KCOL = P + "k"
VEC = P + "vec"
SID = "seed_id"
NID = "neighbor_id"
#: Keys that a task holds at once (8 bytes each).
PIECE = 1 << 18


def _fold_self(a: np.ndarray) -> np.ndarray:
    acc = np.zeros(a.shape[0])
    for j in range(a.shape[1]):
        acc += a[:, j] * a[:, j]
    return acc


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.to_numpy()])


def _first_copies(cands: np.ndarray, cid: np.ndarray, k: int) -> np.ndarray:
    """Positions, by id, of the candidates that can be among some seed's k nearest.

    Equal vectors score alike with every seed, so the smallest ids win: k rows of an id at most,
    and 2k of a vector, as a seed leaves out the rows of its own id.
    """
    order = np.argsort(cid, kind="stable")
    rows = pd.DataFrame({"v": [v.tobytes() for v in cands[order]], "id": cid[order]})
    if rows["v"].is_unique:
        return order
    few = (rows.groupby(["v", "id"], dropna=False).cumcount() < k).to_numpy()
    first = (rows[few].groupby("v").cumcount() < 2 * k).to_numpy()
    return order[few][first]


def _rank_in_row(rows: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of equal (sorted) row numbers."""
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))


def best_pairs(rows: np.ndarray, key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of every row's k smallest (key, id) pairs, in order of row, key and id."""
    if not len(rows):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((ids, key, rows))
    return order[_rank_in_row(rows[order]) < k]


class _Side:
    """Vectors with their norms as left folds, and the factor of a product that gives keys closely."""

    def __init__(self, x: np.ndarray, metric: str, seed: bool):
        self.columns = np.ascontiguousarray(x.T)
        self.square = _fold_self(x)
        self.norm = np.sqrt(self.square)
        self.none = self.norm == 0.0
        real = np.isfinite(x).all(axis=1)
        self.odd = real & (self.square > 1e200)
        if metric == "cosine":
            self.odd |= real & (self.square > 0.0) & (self.square < 1e-200)
            self.factor = x / np.where(self.none, 1.0, -self.norm if seed else self.norm)[:, None]
            self.factor[~real | self.odd] = np.nan
        else:
            extra = np.ones(len(x)) if seed else self.square
            self.factor = np.c_[-2.0 * x if seed else x, extra]


def _pair_scores(s: _Side, c: _Side, rows: np.ndarray, cols: np.ndarray, metric: str) -> np.ndarray:
    """Scores of single pairs, summed as left folds."""
    acc = np.zeros(len(rows))
    for a, b in zip(s.columns, c.columns):
        if metric == "cosine":
            acc += a[rows] * b[cols]
        else:
            diff = a[rows] - b[cols]
            acc += diff * diff
    if metric == "euclidean":
        return np.sqrt(acc)
    ns, nc = s.norm[rows], c.norm[cols]
    return np.where((ns != 0.0) & (nc != 0.0), acc / (ns * nc), 0.0)


def _kth(keys: np.ndarray, k: int) -> np.ndarray:
    """A bound of every row's k-th smallest key, from evenly spaced columns."""
    some = keys[:, ::max(1, keys.shape[1] // 1024)]
    if some.shape[1] < k:
        some = keys
    if some.shape[1] < k:
        return np.full(len(keys), np.inf)
    found = np.partition(some, k - 1, axis=1)[:, k - 1]
    return np.where(np.isnan(found), np.inf, found)


def top_pairs(seeds: np.ndarray, sid: np.ndarray, cands: np.ndarray, cid: np.ndarray, k: int, metric: str,
              limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed positions, candidate positions, scores) of every seed's k nearest, by seed, nearness and id.

    A matrix product gives all keys (smaller: nearer; Euclidean: squared, less the seed's square) up
    to a rounding margin. Only pairs within it of the k-th key, or of ``limit`` (a key that a seed's
    k-th neighbour is known not to exceed), are scored by the left fold that decides. Vectors too
    long or short for the margin are compared with all. Rows of a seed's own id, and pairs whose
    score is no finite number, are left out.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    with np.errstate(all="ignore"):
        kept = _first_copies(cands, cid, k)
        cid = cid[kept]
        s, c = _Side(seeds, metric, True), _Side(cands[kept], metric, False)
        margin = 4.0 * (seeds.shape[1] + 8) * np.finfo(np.float64).eps * np.ones(len(seeds))
        if metric == "euclidean":
            real = c.square[np.isfinite(c.square)]
            margin = margin * (s.square + real.max(initial=0.0)) + 1e-300
        own = np.searchsorted(cid, sid), np.searchsorted(cid, sid, "right")
        copies = (own[1] - own[0]) * (sid == sid)
        product = np.ascontiguousarray(c.factor.T)
        step = max(1, PIECE // len(cid))
        held = np.empty((min(step, len(seeds)), len(cid)))
        out = []
        for at in range(0, len(seeds), step):
            part = slice(at, at + step)
            keys = np.matmul(s.factor[part], product, out=held[:len(s.factor[part])])
            if metric == "cosine":
                keys[s.none[part]] = 0.0
                keys[:, c.none] = 0.0
            self_rows = np.repeat(np.arange(len(keys)), copies[part])
            self_cols = np.repeat(own[0][part], copies[part])
            if len(self_rows):
                self_cols = self_cols + _rank_in_row(self_rows)
            keys[self_rows, self_cols] = np.nan
            forced = s.odd[part].any() or c.odd.any()
            if forced:
                keys[s.odd[part]] = np.nan
                keys[:, c.odd] = np.nan
            bound = None
            if limit is not None:
                bound = limit[part] * (1 + 1e-14 * np.sign(limit[part]))
                if metric == "euclidean":
                    bound = bound - s.square[part]
            if bound is None or not np.isfinite(bound).all():
                kth = _kth(keys, k)
                bound = kth if bound is None else np.fmin(kth, bound)
            reach = bound + 2 * margin[part]
            reach[np.isnan(reach)] = np.inf
            near = keys <= reach[:, None]
            if forced:
                near[s.odd[part]] = True
                near[:, c.odd] = True
                near[self_rows, self_cols] = False
            rows, cols = np.divmod(np.flatnonzero(near), len(cid))
            if not forced and len(rows) > 2 * k * len(keys):
                value = keys[rows, cols]
                order = np.lexsort((value, rows))
                rank = _rank_in_row(rows[order])
                reach = np.full(len(keys), np.inf)
                last = order[rank == k - 1]
                reach[rows[last]] = value[last] + 2 * margin[part][rows[last]]
                close = value <= reach[rows]
                rows, cols = rows[close], cols[close]
            rows = rows + at
            score = _pair_scores(s, c, rows, cols, metric)
            real = np.isfinite(score)
            rows, cols, score = rows[real], cols[real], score[real]
            best = best_pairs(rows, -score if metric == "cosine" else score, cid[cols], k)
            out.append((rows[best], kept[cols[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _tile_fn(label_col: str, metric: str, with_vectors: bool, out_cols: list[str],
             carry: list[str]):
    def top_k(s: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if s.empty or c.empty:
            return pd.DataFrame({k: [] for k in out_cols})
        sv, cv = _stack(s[VEC]), _stack(c[VEC])
        sid = s[SID].to_numpy()
        cid = c[NID].to_numpy()
        rows, cols, score = top_pairs(sv, sid, cv, cid, int(s[KCOL].max()), metric)
        out = {
            label_col: s[label_col].to_numpy()[rows],
            SID: sid[rows],
            NID: cid[cols],
            "score": score,
            KCOL: s[KCOL].to_numpy()[rows],
        }
        for name in carry:
            out[name] = s[name].to_numpy()[rows]
        if with_vectors:
            out["seed_vec"] = list(sv[rows])
            out["neighbor_vec"] = list(cv[cols])
        return pd.DataFrame(out, columns=out_cols)

    return top_k


def block_count(n: int, tile: int) -> int:
    """Blocks of one side of a class of ``n`` rows."""
    return max(min(math.ceil(n / tile), BLOCK_SIDE), math.ceil(n / BLOCK_ROWS))


def _layout_frame(ts: ClassTable, tc: ClassTable, tile: int) -> DataFrame:
    """Block counts per class as a (shuffled, not broadcast) frame for very many classes."""
    c = ts.class_col

    def blocks(n: str) -> Column:
        few = F.least(F.ceil(F.col(n) / F.lit(float(tile))), F.lit(BLOCK_SIDE))
        return F.greatest(few, F.ceil(F.col(n) / F.lit(float(BLOCK_ROWS)))).cast("long")

    return (ts.frame.withColumnRenamed(N, "ns")
            .join(tc.frame.withColumnRenamed(N, "nc"), c)
            .select(c, blocks("ns").alias(SBN), blocks("nc").alias(CBN)))


def nearest_neighbors(seeds: DataFrame, candidates: DataFrame, label_col: str, id_col: str,
                      vec_col: str, k: int | str, metric: str = "cosine",
                      tile: int = TILE_ROWS, with_vectors: bool = False,
                      counts: list[tuple] | None = None,
                      carry: list[str] | None = None) -> DataFrame:
    """Top-k neighbours of every seed among the candidates of its own class (self excluded).

    ``seeds`` and ``candidates``: (label, id, vector array<double>); ``k`` a number or a
    column of ``seeds``. Returns (label, seed_id, neighbor_id, k_rank, score) and, with
    ``with_vectors``, the two vectors. ``score`` is the cosine similarity (higher is
    nearer) or the Euclidean distance (lower is nearer). ``counts`` — (label, seeds,
    candidates) per class — saves two counting jobs when the caller knows them.
    ``carry``: integer columns of ``seeds`` passed through to every output row.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    carry = list(carry or [])
    spark = seeds.sparkSession
    label_type = seeds.schema[label_col].dataType
    if counts is None:
        ts = class_table(seeds, label_col)
        tc = ts if candidates is seeds else class_table(candidates, label_col)
        if ts.local and tc.local:
            sizes_c = tc.sizes()
            counts = [(lb, ns, sizes_c.get(lb, 0)) for lb, ns in ts.rows]
    if counts is not None:   # bounded: one row per class, broadcast
        blocks = [(lb, block_count(ns, tile), block_count(nc, tile)) for lb, ns, nc in counts
                  if ns and nc]
        schema = StructType([StructField(label_col, label_type), StructField(SBN, LongType()),
                             StructField(CBN, LongType())])
        layout = F.broadcast(local_frame(spark, blocks, schema))
    else:
        layout = _layout_frame(ts, tc, tile)
    kc = F.col(k) if isinstance(k, str) else F.lit(int(k))
    zero = F.lit(0).cast("long")
    # Fresh aliases: seeds and candidates may come from one frame (a self cogroup).
    s = seeds.select(F.col(label_col).alias(label_col), F.col(id_col).cast("long").alias(SID),
                     F.col(vec_col).alias(VEC), kc.cast("long").alias(KCOL),
                     *[F.col(x).cast("long").alias(x) for x in carry])
    s = (join_on_class(s, layout, label_col, False)
         .withColumn(SB, F.pmod(F.xxhash64(SID), F.col(SBN)))
         .withColumn(CB, F.explode(F.sequence(zero, F.col(CBN) - 1))))
    c = candidates.select(F.col(label_col).alias(label_col),
                          F.col(id_col).cast("long").alias(NID), F.col(vec_col).alias(VEC))
    c = (join_on_class(c, layout, label_col, False)
         .withColumn(CB, F.pmod(F.xxhash64(NID, F.lit(7)), F.col(CBN)))
         .withColumn(SB, F.explode(F.sequence(zero, F.col(SBN) - 1))))
    fields = [StructField(label_col, label_type), StructField(SID, LongType()),
              StructField(NID, LongType()), StructField("score", DoubleType()),
              StructField(KCOL, LongType())] + [StructField(x, LongType()) for x in carry]
    if with_vectors:
        fields += [StructField("seed_vec", ArrayType(DoubleType())),
                   StructField("neighbor_vec", ArrayType(DoubleType()))]
    schema = StructType(fields)
    fn = _tile_fn(label_col, metric, with_vectors, [f.name for f in fields], carry)
    keys = [label_col, SB, CB]
    per_tile = (s.select(*keys, SID, VEC, KCOL, *carry).groupBy(*keys)
                .cogroup(c.select(*keys, NID, VEC).groupBy(*keys))
                .applyInPandas(fn, schema))
    order = F.desc("score") if metric == "cosine" else F.asc("score")
    w = Window.partitionBy(label_col, SID).orderBy(order, F.asc(NID))
    ranked = per_tile.withColumn("k_rank", F.row_number().over(w))
    # A literal k lets Spark cut every window group to k rows before the shuffle.
    limit = F.col(KCOL) if isinstance(k, str) else F.lit(int(k))
    ranked = ranked.filter(F.col("k_rank") <= limit).drop(KCOL)
    extra = ["seed_vec", "neighbor_vec"] if with_vectors else []
    return ranked.select(label_col, SID, NID, "k_rank", "score", *carry, *extra)
