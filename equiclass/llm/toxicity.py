"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features of a text: which character n-grams (sizes ``SIZES``) of its lower-cased text,
with every white-space run as one space and a space at either end, occur in it at all;
each is hashed to one of ``2**BITS`` buckets. A feature's value is its log-count ratio,
log P(feature | toxic) - log P(feature | clean) with one added to each count (Bernoulli
naive Bayes); a logistic regression learns a weight for each. No normalisation by length:
one insult in a very long text counts in full.

Fitting uses a bounded sample of labelled training rows, about ``PER_CLASS`` of each class,
chosen by a hash of the id. Its n-gram counts are summed from a dense table per task and
the ``SELECTED`` most telling buckets (G-squared) kept; then a single task runs AdaGrad
over the sample's rows, each an array of at most ``SELECTED`` numbers. The intercept is
corrected for the sampling rates. Scoring is one pass over all rows; a text is read in
slices, so that very long ones need no more memory.

Labels: a document is toxic if any of its label rows says 1; null labels and null ids in
``labels`` count as none. Without labelled rows of both classes every score is the class share
(0.5 without any). Null and empty texts hold one feature-less text and get the
intercept's score. Repeated ids are scored one by one. Columns other than those named
aren't read; the language, source and id never enter a score.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZES = (3, 4, 5)
BITS = 20
#: Rows of each class to fit on (expected number; a hash decides which).
PER_CLASS = 6_000
SELECTED = 30_000
EPOCHS = 12
RATE = 0.2
DECAY = 2e-5
#: Tasks that the sample is dealt to, pieces that a table of counts is cut into.
FIT_TASKS, PIECES = 24, 64
SLICE_CHARS = 1 << 20


def buckets(text: str, sizes=SIZES, bits: int = BITS) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, with repetitions, slice by slice and size by size."""
    chars = f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass")
    most = max(sizes)
    for at in range(0, len(chars), 4 * SLICE_CHARS):
        part = np.frombuffer(chars[at:at + 4 * (SLICE_CHARS + most - 1)], dtype="<u4").astype(np.uint64)
        rolled = part
        for n in range(2, most + 1):
            rolled = rolled[:-1] * np.uint64(0x100000001B3) + part[n - 1:]
            if n in sizes:
                own = rolled[:SLICE_CHARS]
                yield ((own ^ (own >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)
                       ).astype(np.uint32)


def present(text: str | None) -> np.ndarray:
    """The sorted distinct buckets of a text."""
    parts = [np.unique(b) for b in buckets(text or "")]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, text) -> the task's counts by class and bucket, cut into pieces."""
    table = np.zeros((2, 1 << BITS), dtype=np.int32)
    for b in batches:
        for toxic, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            table[toxic, present(text.as_py())] += 1
    for piece, part in enumerate(np.split(table, PIECES, axis=1)):
        if part.any():
            yield pa.RecordBatch.from_pydict({"piece": [piece], "counts": [part.tobytes()]})


def _summed(parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), dtype=np.int32).astype(np.int64) for x in parts.column("counts"))
    return pa.table({"piece": parts.column("piece")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def telling(table: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """The buckets of the greatest G-squared between presence and class, in ascending order.

    table: rows that hold the bucket, by [class, bucket]; rows: rows by class.
    """
    total, all_rows = table.sum(axis=0), rows.sum()
    score = np.zeros(table.shape[1])
    for k in (0, 1):
        for held, whole in ((table[k], total), (rows[k] - table[k], all_rows - total)):
            expected = np.maximum(whole * (rows[k] / all_rows), 1e-12)
            score += np.where(held > 0, held * np.log(np.maximum(held, 1) / expected), 0.0)
    score[total < 2] = 0.0
    best = np.argsort(-score, kind="stable")[:most]
    return np.sort(best[score[best] > 0])


def log_ratios(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.log((table[1] + 1) / (rows[1] + 2)) - np.log((table[0] + 1) / (rows[0] + 2))


def fit_weights(rows: list[np.ndarray], toxic: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad on rows of present features with values ``ratios``."""
    weights, bias = np.zeros(len(ratios)), 0.0
    squares, bias_square = np.full(len(ratios), 1e-8), 1e-8
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            own = rows[i]
            x = ratios[own]
            z = bias + weights[own] @ x
            error = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - toxic[i]
            slope = error * x + DECAY * weights[own]
            squares[own] += slope * slope
            weights[own] -= RATE * slope / np.sqrt(squares[own])
            bias_square += error * error
            bias -= RATE * error / bias_square ** 0.5
    return weights * ratios, bias


def _feature_rows(chosen):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets_ = chosen.value
        for b in batches:
            own = [np.flatnonzero(np.isin(buckets_, present(t.as_py()), assume_unique=True)).astype(np.int32)
                   for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(own, pa.list_(pa.int32()))],
                names=["turn", "toxic", "present"])

    return rows


def _fit(ratios):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([*batches]).sort_by([("turn", "ascending")])
        rows = [np.asarray(x.values) for x in table.column("present")]
        weights, bias = fit_weights(rows, table.column("toxic").to_numpy(), ratios.value)
        yield pa.RecordBatch.from_pydict({"bias": [bias], "weights": [weights.tobytes()]})

    return fit


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for b in batches:
            scores = []
            for text in b.column(2):
                held = [own[weights[own] != 0] for own in buckets(text.as_py() or "")]
                z = bias + (float(weights[np.unique(np.concatenate(held))].sum()) if held else 0.0)
                scores.append(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return score


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """doc_id, toxic (0 or 1): one row per id that has a label."""
    ids, toxic = F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("int")
    return (labels.select(ids.alias("doc_id"), toxic.alias("toxic")).dropna()
            .groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", folds: int = 5, per_class: int = PER_CLASS,
                 selected: int = SELECTED) -> tuple[np.ndarray, float]:
    """(weight of every bucket, intercept), learned from labelled rows outside fold 0."""
    spark = docs.sparkSession
    known = labelled(labels, id_col, label_col).filter(~held_out("doc_id", folds))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    weights = np.zeros(1 << BITS, dtype=np.float64)
    if len(sizes) < 2:
        share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
        return weights, float(np.log(share / (1 - share)))
    rates = {k: min(1.0, per_class / n) for k, n in sizes.items()}
    turn = F.xxhash64(F.lit("toxicity"), "doc_id")
    unit = F.shiftrightunsigned(turn, 11) / F.lit(float(1 << 53))
    sample = known.withColumn("turn", turn).filter(
        unit < F.when(F.col("toxic") == 1, F.lit(rates[1])).otherwise(F.lit(rates[0])))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    # About 2 * per_class ids: small by construction.
    fit_rows = saved(texts.join(F.broadcast(sample), "doc_id").select("turn", "toxic", "text")
                     .repartition(FIT_TASKS), "toxicity-sample")

    sums = (fit_rows.select("toxic", "text").mapInArrow(_counts, "piece bigint, counts binary")
            .groupBy("piece").applyInArrow(_summed, "piece bigint, counts binary").collect())
    table = np.zeros((2, 1 << BITS), dtype=np.int64)
    width = (1 << BITS) // PIECES
    for r in sums:
        table[:, r["piece"] * width:(r["piece"] + 1) * width] = np.frombuffer(
            r["counts"], dtype=np.int64).reshape(2, width)
    n = {r["toxic"]: r["count"] for r in fit_rows.groupBy("toxic").count().collect()}
    rows = np.array([n.get(0, 0), n.get(1, 0)])
    if not rows.all():
        share = sizes[1] / (sizes[0] + sizes[1])
        return weights, float(np.log(share / (1 - share)))
    chosen = telling(table, rows, selected)
    ratios = log_ratios(table[:, chosen], rows)
    share = spark.sparkContext.broadcast
    # Features are built in FIT_TASKS tasks; one task reads their numbers.
    features = saved(fit_rows.mapInArrow(_feature_rows(share(chosen)), "turn long, toxic int, present array<int>"),
                     "toxicity-features")
    fitted = (features.coalesce(1).mapInArrow(_fit(share(ratios)), "bias double, weights binary").collect()[0])
    weights[chosen] = np.frombuffer(fitted["weights"])
    return weights, fitted["bias"] + float(np.log(rates[0]) - np.log(rates[1]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    folds: int = 5, **fit) -> DataFrame:
    """doc_id, held_out (fold 0), score (0 to 1) and predicted (score at least 0.5) of every row."""
    weights, bias = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, folds=folds, **fit)
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       held_out(f"`{id_col}`", folds).alias("held_out"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(model), "doc_id bigint, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  **fit) -> DataFrame:
    """The rows of ``docs`` whose score is under 0.5, with their columns as they are."""
    weights, bias = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, **fit)
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.schema.get_field_index(text_col))
            scored = next(_scorer(model)(iter([pa.RecordBatch.from_arrays([text] * 3, names=["a", "b", "c"])])))
            yield b.filter(pa.array([s < 0.5 for s in scored.column("score").to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
