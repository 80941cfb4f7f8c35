"""Exact k nearest neighbours inside each class, with cells pruned by pivots.

The blocks of ``neighbors`` send every vector to every opposite block. Here the candidates of
a large class are partitioned by their nearest pivot, and a cell that can't hold a neighbour
is never compared with the seed:

1. The ``LARGE`` largest classes above ``tile`` rows get a pivot per ``tile`` rows, up to ``pivots``
   (the first rows in hash order); other classes are searched by tiles. Pivots, and the number,
   radius and visitors of cells, are the only things that go through the driver: ``LARGE`` x
   ``pivots`` rows at most.
2. Every row's cell is that of its nearest pivot; a cell's radius is its farthest row's distance
   from the pivot. Cells whose pivots lie side by side make a bin, at least ``BLOCK_SIDE`` a class
   and of about ``BLOCK_ROWS`` rows at most; larger cells are cut.
3. Each seed is compared with rows of its own cell; its k-th neighbour there bounds all others.
   Seeds, bounds and bins to visit are kept in the checkpoint folder.
4. A seed is sent once to each bin with a cell that may hold a nearer row: by the triangle
   inequality one with distance(seed, pivot) - radius within the bound, and as a cell's rows are
   nearer to its pivot than to the seed's, one whose border with the seed's cell is within it (and a
   margin for rounding). In a bin only such cells are compared, or the whole bin where they hold most
   of its rows. Scores and ties are those of ``neighbors``, so results are equal value by value.

Cosine neighbours are searched among vectors scaled to length one, where the distance falls as
the cosine rises. Vectors of length zero score 0.0 with everything, so they are a cell for seeds
whose k-th neighbour scores no more, and such a seed visits all cells. Vectors with values that
are no finite numbers meet only these. Null vectors or labels are left out; ids are integers. An
empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..config import BLOCK_ROWS, BLOCK_SIDE, P, TILE_ROWS, ensure_checkpoint_dir
from .classes import N, class_table
from .neighbors import CB, NID, SB, SID, VEC, _rank_in_row, _stack, best_pairs, nearest_neighbors, top_pairs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIVOTS, LARGE = 512, 64
#: Margin of the bound for rounding, of unit vectors and relative to distances.
MARGIN = 1e-6
#: Rows of a seed's own cell that it is compared with for its bound.
BOUND_ROWS = 4096
CLS, BLOCK, DIST, BOUND, SUB = P + "cls", P + "block", P + "dist", P + "bound", P + "sub"
BIN, BINS, PARTS = P + "bin", P + "bins", P + "parts"


def _scaled(x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in the searched metric, which of them have no place there)."""
    if metric == "euclidean":
        return x, np.zeros(len(x), dtype=bool)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
        none = (norm == 0.0) | ~np.isfinite(norm)
        return x / np.where(none, 1.0, norm)[:, None], none


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in pivots], axis=1))


def _placed(pivots: dict[int, np.ndarray], metric: str):
    """Rows with their class number -> cell and distance from its pivot; cell -1: no place in the metric."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, rows in frame.groupby(CLS):
                x, none = _scaled(_stack(rows[VEC]), metric)
                with np.errstate(all="ignore"):
                    d = _distances(x, pivots[number])
                block = d.argmin(axis=1)
                out = rows.copy()
                out[BLOCK] = np.where(none, -1, block)
                out[DIST] = np.where(none, 0.0, d[np.arange(len(d)), block])
                yield out

    return place


def _may_hold(x: np.ndarray, bound: np.ndarray, own: np.ndarray, pivots: np.ndarray, radii: dict[int, float],
              cells: list[int], metric: str) -> np.ndarray:
    """Which of the ``cells`` may hold a row nearer than the bound, for each seed."""
    with np.errstate(all="ignore"):
        y, none = _scaled(x, metric)
        d = _distances(y, pivots)
        nearest = d.argmin(axis=1)
        between = _distances(pivots, pivots)
        base = d[np.arange(len(d)), nearest]
        out = np.empty((len(x), len(cells)), dtype=bool)
        for i, cell in enumerate(cells):
            if cell == -1:
                out[:, i] = ~(bound < np.sqrt(2.0) - MARGIN)
                continue
            to = d[:, cell]
            reach = bound + MARGIN * (1.0 + to + radii[cell])
            border = (to * to - base * base) / (2.0 * between[nearest, cell])
            out[:, i] = ~(to - radii[cell] > reach) & ~((border > reach) & (nearest != cell)) | (own == cell)
    out[none] = True
    return out


def _bound_fn(pivots, radii, bins, k: int, metric: str, out_cols: list[str]):
    """Seeds with candidates of their bin -> bound of the k-th neighbour's distance, bins to visit."""

    def bound_of(s: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if s.empty:
            return pd.DataFrame({x: [] for x in out_cols})
        number = int(s[CLS].iloc[0])
        x, sid, own = _stack(s[VEC]), s[SID].to_numpy(), s[BLOCK].to_numpy()
        bound = np.full(len(s), np.inf)
        here = dict(list(c.groupby(BLOCK))) if len(c) else {}
        for cell in np.unique(own):
            if cell not in here:
                continue
            at, some = np.flatnonzero(own == cell), here[cell].iloc[:BOUND_ROWS]
            rows, _, score = top_pairs(x[at], sid[at], _stack(some[VEC]), some[NID].to_numpy(), k, metric)
            if len(rows):
                last = _rank_in_row(rows) == k - 1
                far = score[last]
                bound[at[rows[last]]] = np.sqrt(np.maximum(0.0, 2 - 2 * far)) if metric == "cosine" else far
        cells = sorted(radii[number])
        visits = _may_hold(x, bound, own, pivots[number], radii[number], cells, metric)
        into = np.array([bins[number][cell] for cell in cells], dtype=np.int64)
        out = s.copy()
        out[BOUND] = bound
        out[BINS] = [np.unique(into[v]) for v in visits]
        return out[out_cols]

    return bound_of


def _search_fn(label_col: str, pivots, radii, k: int, metric: str, with_vectors: bool, out_cols: list[str]):
    """Seeds that visit a bin with its candidates -> their k nearest there."""

    def search(s: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if s.empty or c.empty:
            return pd.DataFrame({x: [] for x in out_cols})
        number = int(s[CLS].iloc[0])
        x, sid, own, bound = _stack(s[VEC]), s[SID].to_numpy(), s[BLOCK].to_numpy(), s[BOUND].to_numpy()
        y, nid = _stack(c[VEC]), c[NID].to_numpy()
        cells, cell = np.unique(c[BLOCK].to_numpy(), return_inverse=True)
        visits = _may_hold(x, bound, own, pivots[number], radii[number], cells.tolist(), metric)
        if metric == "cosine":   # the bound's key, with its rounding
            limit = bound * bound / 2 - 1 + 1e-12
        else:
            limit = bound * bound
        most = visits @ np.bincount(cell) > len(c) / 2
        found = []
        for i in range(-1, len(cells)):
            at = np.flatnonzero(most if i < 0 else visits[:, i] & ~most)
            of = np.arange(len(c)) if i < 0 else np.flatnonzero(cell == i)
            if len(at):
                rows, cols, score = top_pairs(x[at], sid[at], y[of], nid[of], k, metric, limit[at])
                found.append((at[rows], of[cols], score))
        if not found:
            return pd.DataFrame({x: [] for x in out_cols})
        rows, cols, score = (np.concatenate(f) for f in zip(*found))
        best = best_pairs(rows, -score if metric == "cosine" else score, nid[cols], k)
        rows, cols, score = rows[best], cols[best], score[best]
        out = {label_col: s[label_col].to_numpy()[rows], SID: sid[rows], NID: nid[cols], "score": score}
        if with_vectors:
            out |= {"seed_vec": list(x[rows]), "neighbor_vec": list(y[cols])}
        return pd.DataFrame(out, columns=out_cols)

    return search


def _bins(pivots: np.ndarray, sizes: dict[int, int], tile: int) -> dict[int, int]:
    """Bin of each cell: cells in the order of their pivots' most varied value, filled up to a size."""
    total = sum(sizes.values())
    size = max(tile, min(BLOCK_ROWS, -(-total // BLOCK_SIDE)))
    value = pivots[:, pivots.var(axis=0).argmax()]
    out, number, filled = {}, 0, 0
    for cell in sorted(sizes, key=lambda i: (i == -1, value[i], i)):
        if filled and filled + sizes[cell] > size:
            number, filled = number + 1, 0
        out[cell] = number
        filled += sizes[cell]
    return out


def pruned_neighbors(seeds: DataFrame, candidates: DataFrame, label_col: str, id_col: str, vec_col: str, k: int,
                     metric: str = "cosine", tile: int = TILE_ROWS, pivots: int = PIVOTS,
                     with_vectors: bool = False, counts: list[tuple] | None = None) -> DataFrame:
    """(label, seed_id, neighbor_id, k_rank, score): the k nearest candidates of each seed's class, itself excluded.

    ``with_vectors`` and ``counts`` as in ``nearest_neighbors``.
    """
    return _searched(seeds, candidates, label_col, id_col, vec_col, k, metric, tile, pivots, with_vectors, counts)[0]


def _searched(seeds, candidates, label_col, id_col, vec_col, k, metric, tile, n_pivots, with_vectors=False,
              counts=None):
    """The result, and the rows of each side as they were sent to tasks."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    spark = seeds.sparkSession
    label_type = seeds.schema[label_col].dataType

    def rows_of(df: DataFrame, own_id: str) -> DataFrame:
        return df.select(F.col(f"`{label_col}`").alias(label_col), F.col(f"`{id_col}`").cast("long").alias(own_id),
                         F.col(f"`{vec_col}`").alias(VEC)).filter(F.col(label_col).isNotNull() & F.col(VEC).isNotNull())

    s, c = rows_of(seeds, SID), rows_of(candidates, NID)
    if counts is None:
        sizes = class_table(c, label_col)
        biggest = sizes.frame.filter(F.col(N) > tile).orderBy(F.desc(N), label_col).limit(LARGE)
        large, classes = [tuple(r) for r in biggest.select(label_col, N).collect()], sizes.count
    else:
        large = sorted(((lb, nc) for lb, _, nc in counts if nc > tile), key=lambda r: (-r[1], r[0]))[:LARGE]
        classes = len(counts)

    def plain(one: DataFrame, two: DataFrame, known: list[tuple] | None) -> DataFrame:
        return nearest_neighbors(one.withColumnRenamed(SID, id_col), two.withColumnRenamed(NID, id_col), label_col,
                                 id_col, VEC, k, metric, tile, with_vectors, known)

    if not large:
        return plain(s, c, counts), None
    names = F.broadcast(spark.createDataFrame([(r[0], i) for i, r in enumerate(large)], StructType(
        [StructField(label_col, label_type), StructField(CLS, LongType())])))
    rest = None
    if classes > len(large):
        rest = plain(s.join(names, label_col, "left_anti"), c.join(names, label_col, "left_anti"),
                     counts and [r for r in counts if r[0] not in {lb for lb, _ in large}])

    if metric == "euclidean":   # other values have no distance that is a number
        finite = F.forall(VEC, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        s, c = s.filter(finite), c.filter(finite)
    s, c = s.join(names, label_col), c.join(names, label_col)
    wanted = F.broadcast(spark.createDataFrame(
        [(i, min(n_pivots, -(-n // tile))) for i, (_, n) in enumerate(large)],
        StructType([StructField(CLS, LongType()), StructField(PARTS, LongType())])))
    first = Window.partitionBy(CLS).orderBy(F.xxhash64(NID), NID)
    usable = c if metric == "euclidean" else c.filter(F.exists(VEC, lambda v: v != 0.0))
    chosen = (usable.withColumn(N, F.row_number().over(first)).filter(F.col(N) <= n_pivots)
              .join(wanted, CLS).filter(F.col(N) <= F.col(PARTS)).select(CLS, VEC).collect())
    held = {i: np.zeros((1, 1)) for i in range(len(large))}
    for i in held:
        own = [r[VEC] for r in chosen if r[CLS] == i]
        if own:
            x, none = _scaled(np.array(own, dtype=np.float64), metric)
            if not none.all():
                held[i] = np.unique(x[~none], axis=0)

    def placed(df: DataFrame) -> DataFrame:
        schema = StructType([*df.schema.fields, StructField(BLOCK, LongType()), StructField(DIST, DoubleType())])
        return df.mapInPandas(_placed(held, metric), schema)

    c = placed(c)
    shape = c.groupBy(CLS, BLOCK).agg(F.count("*").alias(N), F.max(DIST).alias(DIST)).collect()
    radii: dict[int, dict[int, float]] = {i: {} for i in held}
    filled: dict[int, dict[int, int]] = {i: {} for i in held}
    for r in shape:
        radii[r[CLS]][r[BLOCK]], filled[r[CLS]][r[BLOCK]] = r[DIST], r[N]
    bins = {i: _bins(held[i], filled[i], tile) for i in held}
    load: dict[tuple, int] = {}
    for i in held:
        for cell, number in bins[i].items():
            load[i, number] = load.get((i, number), 0) + filled[i][cell]
    limit = max(tile, BLOCK_ROWS)
    place_of = F.broadcast(spark.createDataFrame(
        [(i, cell, number, max(1, round(load[i, number] / limit))) for i in held for cell, number in bins[i].items()],
        StructType([StructField(x, LongType()) for x in (CLS, BLOCK, BIN, SUB)])))
    subs = F.broadcast(spark.createDataFrame(
        [(i, number, max(1, round(n / limit))) for (i, number), n in load.items()],
        StructType([StructField(x, LongType()) for x in (CLS, BIN, SUB)])))
    c = (c.drop(DIST).join(place_of, [CLS, BLOCK])
         .withColumn(CB, F.pmod(F.xxhash64(NID, F.lit(7)), F.col(SUB))).drop(SUB))
    # A seed whose own cell has no candidates gets no bound in bin 0.
    s = placed(s).drop(DIST).join(place_of.drop(SUB), [CLS, BLOCK], "left").withColumn(
        BIN, F.coalesce(BIN, F.lit(0).cast("long")))
    zero = F.lit(0).cast("long")
    keys = [CLS, BIN, CB, SB]
    sent = []

    def together(one: DataFrame, two: DataFrame):
        """Both sides' rows of a bin, the seeds in parts of bounded size."""
        parts = F.broadcast(spark.createDataFrame(
            [(r[CLS], r[BIN], -(-r[N] // limit)) for r in one.groupBy(CLS, BIN).agg(F.count("*").alias(N)).collect()],
            StructType([StructField(x, LongType()) for x in (CLS, BIN, PARTS)])))
        one = one.join(parts, [CLS, BIN]).withColumn(SB, F.pmod(F.xxhash64(SID), F.col(PARTS))).drop(PARTS)
        two = two.join(parts, [CLS, BIN]).withColumn(SB, F.explode(F.sequence(zero, F.col(PARTS) - 1))).drop(PARTS)
        sent.append((one, two))
        return one.groupBy(*keys).cogroup(two.select(*keys, BLOCK, NID, VEC).groupBy(*keys))

    seed_fields = [StructField(label_col, label_type), StructField(CLS, LongType()), StructField(SID, LongType()),
                   s.schema[VEC], StructField(BLOCK, LongType()), StructField(BOUND, DoubleType()),
                   StructField(BINS, ArrayType(LongType()))]
    ensure_checkpoint_dir(spark)
    bounded = together(s.withColumn(CB, zero), c.filter(F.col(CB) == 0)).applyInPandas(
        _bound_fn(held, radii, bins, k, metric, [f.name for f in seed_fields]),
        StructType(seed_fields)).checkpoint(eager=True)

    visiting = (bounded.withColumn(BIN, F.explode(BINS)).drop(BINS).join(subs, [CLS, BIN])
                .withColumn(CB, F.explode(F.sequence(zero, F.col(SUB) - 1))).drop(SUB))
    fields = [StructField(label_col, label_type), StructField(SID, LongType()), StructField(NID, LongType()),
              StructField("score", DoubleType())]
    if with_vectors:
        fields += [StructField(x, ArrayType(DoubleType())) for x in ("seed_vec", "neighbor_vec")]
    near = together(visiting, c).applyInPandas(
        _search_fn(label_col, held, radii, k, metric, with_vectors, [f.name for f in fields]), StructType(fields))
    order = F.desc("score") if metric == "cosine" else F.asc("score")
    w = Window.partitionBy(label_col, SID).orderBy(order, F.asc(NID))
    ranked = near.withColumn("k_rank", F.row_number().over(w)).filter(F.col("k_rank") <= k)
    out = ranked.select(label_col, SID, NID, "k_rank", "score", *[f.name for f in fields[4:]])
    return out if rest is None else out.unionByName(rest.select(*out.columns)), sent
