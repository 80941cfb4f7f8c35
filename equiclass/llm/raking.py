"""Mixing sources to target weights by iterative proportional fitting (raking).

The documents' tokens are summed by cell: source, language and topic. Raking scales the
cells' weights so that the weighted tokens meet the target share of every source, then of
every language, then of every topic, over and over; the weights converge to those closest
to equal weights (in Kullback-Leibler divergence) that meet all three marginals. A
document's inclusion probability is its cell's weight, scaled so that the greatest weight
keeps its documents whole (probability 1): then the expected sample meets the targets. With
``keep_share`` this share of the tokens is expected, with probabilities cut at 1; ``bounded``
rakes these probabilities themselves. A hash of the id decides, so the sample is the same
however often and wherever it is drawn.

Bounded. A sample without repetition can't hold more of a value than there is. The goal of
a value is the lesser of its own tokens and its target times a common scale, so that the
goals of each marginal sum to ``keep_share`` of all tokens: what a scarce value can't give goes
to the others in proportion to their targets. The probabilities, the weights cut at 1, are
raked to these goals until no marginal is off by more than ``TOLERANCE`` of the kept tokens.
Values that miss their target (scarce ones, and those that other marginals' scarce values
push aside) are logged, with the greatest share that could meet all targets by itself;
``marginals`` returns them.

Targets: by default each marginal's own shares, tempered: share**alpha, normalised. Given
targets (value -> share; other values get none) replace them.

Scale. Documents are aggregated to cells once, with partial sums, however hot a source;
all iterations run on the cells, each sweep written to the shared folder. Documents take
their cell's probability by a join salted over ``SALT`` copies of the cells, so that a cell
of a third of all rows is spread (Spark broadcasts the cells instead while they are small).

Null sources, languages and topics are values of their own. A null or empty text has no
tokens: such documents weigh nothing in the sums and are kept or dropped like their cell; a
cell without any tokens has weight 1 in raking and probability 1. Repeated rows have the
same fate as one another. An empty table gives an empty result.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, saved

log = logging.getLogger(__name__)

SWEEPS = 8
ALPHA = 0.7
SALT = 16
#: Cells that one task holds while raking.
CELLS_A_TASK = 100_000
#: Cells at most that the driver bounds by itself; more are bounded by sweeps over the shared folder.
DRIVER_CELLS = 50_000
#: Greatest error of a bounded marginal, as a share of the kept tokens; sweeps at most on the driver, and of files.
TOLERANCE = 1e-4
BOUND_SWEEPS, BOUND_FILE_SWEEPS = 2_000, 64

#: Topics by what a text holds, the first that applies; fixed values.
TOPIC_MARKS = (
    ("licence", ("licensed under", "License", "Copyright")),
    ("contact", ("@", "http://", "https://")),
    ("symbols", ("###", "$$$", "%%%", "&&&", "***")),
    ("code", ("def ", "return ", "{", "};")),
)


def topic_of(text: Column) -> Column:
    """A text's topic by fixed marks; long and short prose for the rest."""
    text = F.coalesce(text, F.lit(""))
    topic = None
    for name, marks in TOPIC_MARKS:
        found = None
        for mark in marks:
            found = F.contains(text, F.lit(mark)) if found is None else found | F.contains(text, F.lit(mark))
        topic = F.when(found, name) if topic is None else topic.when(found, name)
    return topic.when(F.length(text) >= 2000, "long prose").otherwise("short prose")


def tokens_of(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACES}|{SPACES}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def tempered(cells: DataFrame, dim: str, alpha: float) -> DataFrame:
    """dim, target: shares of the tokens to the power alpha, normalised."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("own"))
    sums = sums.withColumn("raised", F.when(F.col("own") > 0, F.pow(F.col("own").cast("double"), F.lit(alpha)))
                           .otherwise(0.0))
    whole = sums.agg(F.sum("raised")).first()[0] or 0.0
    return sums.select(dim, (F.col("raised") / whole if whole else F.lit(0.0)).alias("target"))


def _given(cells: DataFrame, dim: str, shares: Mapping[str | None, float]) -> DataFrame:
    whole = sum(shares.values())
    rows = [(_key(k), v / whole) for k, v in shares.items()]
    given = cells.sparkSession.createDataFrame(rows, f"{dim} string, target double")
    return cells.select(dim).distinct().join(given, dim, "left").fillna(0.0, ["target"])


def _key(value: str | None) -> str:
    return "" if value is None else f"={value}"


def rake(cells: DataFrame, dims: list[str], targets: Mapping[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """Adds ``weight`` to the cells (``dims``, tokens): after raking, weighted tokens meet the targets.

    Sums to the total of tokens. A marginal value whose cells hold no tokens is left as it is.
    """
    total, n = cells.agg(F.sum("tokens"), F.count("*")).first()
    whole, tasks = float(total or 0), max(1, math.ceil(n / CELLS_A_TASK))
    marks = {d: saved(targets[d].select(d, (F.col("target") * F.lit(whole)).alias("goal")), f"rake-{d}")
             for d in dims}
    cells = cells.coalesce(tasks).withColumn("weight", F.lit(1.0))
    for _ in range(sweeps):
        for d in dims:
            sums = cells.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now"))
            factors = sums.join(marks[d], d).select(
                d, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(1.0).alias("factor"))
            cells = cells.join(factors, d).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        cells = saved(cells.coalesce(tasks), "rake-sweep")
    return cells


def filled(own: np.ndarray, target: np.ndarray, goal: float) -> np.ndarray:
    """least(own, scale * target) with the scale that makes the sum ``goal`` (or all that can be given)."""
    open_ = (own > 0) & (target > 0)
    full = np.zeros(len(own), dtype=bool)
    while True:
        free = open_ & ~full
        if not free.any():
            return np.where(full, own, 0.0)
        scale = (goal - own[full].sum()) / target[free].sum()
        over = free & (scale * target >= own)
        if not over.any():
            return np.where(full, own, np.where(free, scale * target, 0.0))
        full |= over


def bounded_here(tokens: np.ndarray, weight: np.ndarray, marks: list[tuple[np.ndarray, np.ndarray]],
                 goal: float) -> np.ndarray:
    """Probabilities of cells: ``marks`` has the index of every cell's value and the targets, by marginal."""
    goals = [filled(np.bincount(at, tokens, len(t)), t, goal) for at, t in marks]
    x = weight * (goal / ((tokens * weight).sum() or 1.0))

    def factor(wanted, now):
        return np.divide(wanted, now, out=np.ones_like(now), where=now > 0)

    for _ in range(BOUND_SWEEPS):
        for (at, _), wanted in zip(marks, goals, strict=True):
            x = np.minimum(x * factor(wanted, np.bincount(at, tokens * np.minimum(x, 1.0), len(wanted)))[at], 1e100)
        x = x * factor(np.array([goal]), np.array([(tokens * np.minimum(x, 1.0)).sum()]))[0]
        p = np.minimum(x, 1.0)
        off = max(np.abs(np.bincount(at, tokens * p, len(w)) - w).max() for (at, _), w in zip(marks, goals, strict=True))
        if off <= TOLERANCE * goal:
            break
    return np.minimum(x, 1.0)


def _filled(values: DataFrame, goal: float) -> DataFrame:
    """``filled`` of (own, target) rows, as column goal; a round per job."""
    cut = math.inf
    while True:
        full = (F.col("target") * F.lit(cut) >= F.col("own")) if cut < math.inf else F.lit(False)
        taken, rest = values.filter("own > 0 and target > 0").agg(
            F.sum(F.when(full, F.col("own"))), F.sum(F.when(~full, F.col("target")))).first()
        scale = (goal - float(taken or 0)) / rest if rest else math.inf
        if not rest or scale == cut:
            break
        cut = scale
    wanted = F.col("own").cast("double") if cut == math.inf else F.least(F.col("own"), F.col("target") * F.lit(cut))
    return values.withColumn("goal", F.when((F.col("own") > 0) & (F.col("target") > 0), wanted).otherwise(0.0))


def bounded(raked: DataFrame, dims: list[str], targets: Mapping[str, DataFrame], keep_share: float) -> DataFrame:
    """Adds ``probability`` (0 to 1) to raked cells: tokens * probability meets the goals, ``keep_share`` of all."""
    n, whole, weighted = raked.agg(F.count("*"), F.sum("tokens"), F.sum(F.col("tokens") * F.col("weight"))).first()
    goal = keep_share * float(whole or 0)
    if n <= DRIVER_CELLS:
        rows = raked.select(*dims, "tokens", "weight").collect()
        marks = []
        for d in dims:
            found = {r[d]: r["target"] for r in targets[d].select(d, "target").collect()}
            index = {v: k for k, v in enumerate(found)}
            marks.append((np.array([index[r[d]] for r in rows], dtype=np.int64), np.array([*found.values()], dtype=float)))
        p = bounded_here(np.array([r["tokens"] for r in rows], dtype=float),
                         np.array([r["weight"] for r in rows], dtype=float), marks, goal) if rows and goal else [1.0] * n
        schema = raked.select(*dims, "tokens", "weight").schema.add("probability", "double")
        return raked.sparkSession.createDataFrame([(*r, float(x)) for r, x in zip(rows, p, strict=True)], schema)
    tasks = max(1, math.ceil(n / CELLS_A_TASK))
    marks = {d: saved(_filled(raked.groupBy(d).agg(F.sum("tokens").alias("own")).join(targets[d], d), goal)
                      .select(d, "goal"), f"bound-{d}") for d in dims}
    cells, given = raked.withColumn("weight0", F.col("weight")), F.col("tokens") * F.least(F.lit(1.0), F.col("weight"))
    cells = cells.withColumn("weight", F.col("weight") * F.lit(goal / (weighted or 1.0)))
    for _ in range(BOUND_FILE_SWEEPS):
        for d in dims:
            sums = cells.groupBy(d).agg(F.sum(given).alias("now"))
            factors = sums.join(marks[d], d).select(
                d, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(1.0).alias("factor"))
            cells = cells.join(factors, d).withColumn(
                "weight", F.least(F.col("weight") * F.col("factor"), F.lit(1e100))).drop("factor")
        cells = saved(cells.coalesce(tasks), "bound-sweep")
        now = cells.agg(F.sum(given)).first()[0]
        cells = cells.withColumn("weight", F.col("weight") * F.lit(goal / now if now else 1.0))
        off = max(cells.groupBy(d).agg(F.sum(given).alias("now")).join(marks[d], d).agg(
            F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0.0 for d in dims)
        if off <= TOLERANCE * goal:
            break
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight"))).withColumn(
        "weight", F.col("weight0")).select(*dims, "tokens", "weight", "probability")


def marginals(cells: DataFrame, dims: list[str], targets: Mapping[str, DataFrame]) -> DataFrame:
    """marginal, value, own, target, reached (shares) of cells with ``probability``; value as in the cells."""
    own, kept = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).first()
    found = None
    for d in dims:
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("own"), F.sum(
            F.col("tokens") * F.col("probability")).alias("kept")).join(targets[d], d).select(
            F.lit(d).alias("marginal"), F.col(d).alias("value"), (F.col("own") / F.lit(float(own or 1))).alias("own"),
            "target", (F.col("kept") / F.lit(float(kept or 1))).alias("reached"))
        found = sums if found is None else found.unionByName(sums)
    return found


def _warned(cells: DataFrame, dims: list[str], targets: Mapping[str, DataFrame], keep_share: float) -> None:
    shares = saved(marginals(cells, dims, targets), "mix-marginals")
    missed = F.abs(F.col("reached") - F.col("target")) > 2 * TOLERANCE
    n, most = shares.agg(F.count_if(missed), F.min(F.when(F.col("target") > 0, F.col("own") / F.col("target")))).first()
    if n:
        worst = shares.filter(missed).orderBy(F.abs(F.col("reached") - F.col("target")).desc()).limit(20).collect()
        log.warning("keep_share %s: %d of the targets can't be met (by single marginals, at a share of %.4f at most): %s",
                    keep_share, n, most or 0.0, "; ".join(
                        f"{r['marginal']} {r['value']} target {r['target']:.4f} reached {r['reached']:.4f}" for r in worst))


def _decided(docs: DataFrame, topic: Column | None, id_col: str, text_col: str, source_col: str, lang_col: str,
             alpha: float, targets: Mapping[str, Mapping[str | None, float]] | None, keep_share: float | None,
             sweeps: int, seed: int, bounded: bool) -> DataFrame:
    """row (a struct of the columns of ``docs``) with the mix_ columns."""
    text = F.col(f"`{text_col}`").cast("string")
    dims = ["mix_source", "mix_lang", "mix_topic"]

    def value(c: Column) -> Column:
        return F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c.cast("string")))

    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("mix"), F.col(f"`{id_col}`")), 11) / F.lit(
        float(1 << 53))
    salt = F.pmod(F.xxhash64(F.lit("salt"), F.col(f"`{id_col}`")), F.lit(SALT)).cast("int")
    marked = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), tokens_of(text).alias("mix_tokens"),
        value(F.col(f"`{source_col}`")).alias("mix_source"), value(F.col(f"`{lang_col}`")).alias("mix_lang"),
        value(topic_of(text) if topic is None else topic).alias("mix_topic"), unit.alias("unit"),
        salt.alias("salt"))
    cells = saved(marked.groupBy(*dims).agg(F.sum("mix_tokens").alias("tokens")), "mix-cells")
    named = dict(zip(("source", "lang", "topic"), dims, strict=True))
    given = {named[k]: v for k, v in (targets or {}).items()}
    goals = {d: _given(cells, d, given[d]) if d in given else tempered(cells, d, alpha) for d in dims}
    raked = saved(_probabilities(rake(cells, dims, goals, sweeps), keep_share, goals if bounded else None),
                  "mix-probabilities")
    copies = raked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return (marked.join(copies, [*dims, "salt"]).withColumn("mix_kept", F.col("unit") < F.col("mix_probability"))
            .withColumn("mix_topic", F.when(F.col("mix_topic") != "", F.expr("substring(mix_topic, 2)"))))


def mixed(docs: DataFrame, *, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", lang_col: str = "lang", alpha: float = ALPHA,
          targets: Mapping[str, Mapping[str | None, float]] | None = None, keep_share: float | None = None,
          sweeps: int = SWEEPS, seed: int = 0, bounded: bool = False) -> DataFrame:
    """The columns of ``docs`` and mix_tokens, mix_topic, mix_weight, mix_probability, mix_kept.

    bounded: with ``keep_share``, the probabilities are raked, not only the weights. Columns of those names that ``docs`` has already are replaced.
    """
    found = _decided(docs, topic, id_col, text_col, source_col, lang_col, alpha, targets, keep_share, sweeps, seed,
                     bounded)
    added = ("mix_tokens", "mix_topic", "mix_weight", "mix_probability", "mix_kept")
    own = [c for c in docs.columns if c.lower() not in added]
    return found.select(*(F.col("row").getField(c).alias(c) for c in own), *added)


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mixture keeps (``options`` as for ``mixed``), columns as they are."""
    defaults = dict(topic=None, id_col="doc_id", text_col="text", source_col="source", lang_col="lang",
                    alpha=ALPHA, targets=None, keep_share=None, sweeps=SWEEPS, seed=0, bounded=False)
    found = _decided(docs, **{**defaults, **options})
    return found.filter("mix_kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _probabilities(raked: DataFrame, keep_share: float | None, targets: Mapping[str, DataFrame] | None) -> DataFrame:
    """mix_weight and mix_probability of every cell; bounded to ``targets`` if they are given."""
    dims = ["mix_source", "mix_lang", "mix_topic"]
    if keep_share is not None and targets is not None:
        targets = {d: saved(targets[d], f"goal-{d}") for d in dims}
        raked = saved(bounded(raked, dims, targets, keep_share), "mix-bounded")
        _warned(raked, dims, targets, keep_share)
        p = F.col("probability")
    elif keep_share is None:
        top = raked.filter("tokens > 0").agg(F.max("weight")).first()[0] or 1.0
        p = F.col("weight") / F.lit(top)
    else:
        own, weighted = raked.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("weight"))).first()
        p = F.least(F.lit(1.0), F.lit(keep_share * float(own or 0) / (weighted or 1.0)) * F.col("weight"))
    return raked.select(*dims, F.col("weight").alias("mix_weight"),
                        F.when(F.col("tokens") > 0, p).otherwise(1.0).alias("mix_probability"))
