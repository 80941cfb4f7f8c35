"""Jaccard join of word-shingle sets by PartEnum signatures, and the components of its links.

Two sets of x and y shingles with a similarity of at least t differ in at most
(x + y)(1 - t)/(1 + t) shingles, and their sizes by a factor of 1/t at most.

1. Sizes are cut into bands whose ends grow by 1/t. A pair is looked for in the band of its
   larger set: a set gives signatures for its own band, and for the next one if it reaches t
   times that band's least size. In a band of sizes up to r a pair differs in at most
   k = 2 r (1 - t)/(1 + t) shingles.
2. PartEnum: the domain of shingles is hashed into n1 parts and each of these into n2. At
   least n1 - k // (k2 + 1) parts hold k2 differences at most; in such a part, one of the
   subsets of n2 - k2 of its n2 pieces is equal in both sets. Every part's every subset gives
   a signature: a hash of the shingles in it.
3. A subset with fewer than ``m`` shingles says little (empty ones are equal in nearly all sets)
   and gives none. ``spare`` more parts make up for it: a pair has more than ``spare`` parts with
   an equal subset, so if at most ``spare`` parts of either set have such a weak subset, one
   equal signature is left. A set with more gives signatures of another partition as well,
   and so on until one has few enough; of a pair, both reach the first level at which either
   stops. So no link is missed, and no bucket holds what just isn't there.
4. Sets that share a signature share a bucket. In each, every set is a candidate of the least
   one; for each set the candidate with the most common buckets is verified on the words of
   both texts. This connects most of every group; the components are found.
5. What shares a bucket but not yet a component is compared: buckets of several components,
   joined where they share sets, are families; in each, the sets outside a bucket's largest
   component are compared with all others, in blocks of ``BLOCK`` shingles, each in one task. Of
   a set's links to a component one is kept: links within a component change nothing.

Documents with equal sets (a 128-bit digest) are one node. A class that holds a thousandth of
all rows or more is joined by broadcast (there are 1000 of them at most), a set that is the
candidate of very many by salted joins, a very common signature is counted before it is
shuffled and its rows are split by the skew join. Nothing else goes through the driver.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z; a text with fewer words than a shingle is
one shingle, the whole sequence; null texts and texts without words have no set and no links.
Null ids take part, but name no component unless all its ids are null. Repeated ids are
separate documents. A very long text is one set in its task: 8 bytes and a hash a shingle. An
empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .graph import components
from .neardup import WordHashes, _attached, _verifier, shingle_hashes, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE, PERCENT = 5, 80
#: (k2, n2): differences allowed in a part, and its pieces.
SHAPES = ((1, 3), (1, 2), (0, 1))
#: Signatures that a band may have: this share of its least size, and three.
SHARE = 0.3
#: Partitions tried for a set; the last one's weak subsets give signatures as well.
LEVELS = 100
#: Shingles of a family on either side of one block of comparisons.
BLOCK = 400_000
#: Share of all rows from which a class is joined by broadcast.
HOT = 1000


@dataclass(frozen=True)
class Band:
    """Parameters of the pairs whose larger set has ``low`` to ``high`` shingles."""

    number: int
    low: int
    high: int
    k2: int
    n2: int
    n1: int
    spare: int
    m: int


def _weak(mean: float, m: int) -> float:
    """Probability that a Poisson number of this mean is below ``m``."""
    return math.exp(-mean) * sum(mean ** j / math.factorial(j) for j in range(m))


def _shaped(number: int, low: int, high: int, percent: int, shape: tuple[int, int], m: int) -> Band | None:
    k2, n2 = shape
    if high * 2 * (100 - percent) < 100 + percent:  # only equal sets link
        return Band(number, low, high, 0, 1, 1, 0, 1)
    k = 2 * high * (100 - percent) // (100 + percent)
    least = -(-percent * low // 100)
    n1 = good = k // (k2 + 1) + 1
    for _ in range(60):
        weak = n1 * min(1.0, math.comb(n2, k2) * _weak(least * (n2 - k2) / (n2 * n1), m)) if n1 * n2 > 1 else 0.0
        spare = math.ceil(weak + 2 * math.sqrt(weak)) if weak > 0.05 else 0
        if good + spare <= n1:
            return Band(number, low, high, k2, n2, n1, n1 - good, m)
        n1 = good + spare
        if n1 > least:
            return None
    return None


def bands(percent: int, most: int) -> list[Band]:
    """The bands up to a size of ``most``."""
    out, low = [], 1
    while low <= most:
        high = low * 100 // percent
        found = [b for shape in SHAPES for m in (2, 1)
                 if (b := _shaped(len(out), low, high, percent, shape, m)) is not None]
        cheap = [b for b in found if b.n1 * math.comb(b.n2, b.k2) <= SHARE * b.low * percent / 100 + 3]
        k = 2 * high * (100 - percent) // (100 + percent)
        if cheap:       # the most shingles that a signature is sure to hold, then those it is likely to
            best = max(cheap, key=lambda b: (b.m, (b.n2 - b.k2) / (b.n2 * b.n1)))
        elif found:
            best = min(found, key=lambda b: b.n1 * math.comb(b.n2, b.k2))
        else:
            best = Band(len(out), low, high, 0, 1, k + 1, 0, 1)
        out.append(best)
        low = high + 1
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class PartEnum:
    """Signatures of sets of 64-bit shingle hashes."""

    def __init__(self, percent: int):
        self.percent, self.bands = percent, bands(percent, 1000)

    def signatures(self, hashes: np.ndarray) -> np.ndarray:
        size = len(hashes)
        if not size:
            return np.zeros(0, dtype=np.int64)
        while size > self.bands[-2].high:  # a set's band and the next one
            self.bands = bands(self.percent, 4 * self.bands[-1].high)
        own = next(i for i, b in enumerate(self.bands) if size <= b.high)
        out = self._of(self.bands[own], hashes)
        if 100 * size >= self.percent * self.bands[own + 1].low:
            out += self._of(self.bands[own + 1], hashes)
        return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, dtype=np.int64)

    def _of(self, band: Band, hashes: np.ndarray) -> list[np.ndarray]:
        out, cells = [], band.n1 * band.n2
        subsets = [list(s) for s in combinations(range(band.n2), band.n2 - band.k2)]
        for level in range(LEVELS):
            seed = np.uint64((band.number << 20) + level + 1)
            mixed = _mixed(hashes ^ _mixed(np.array([seed]))[0])
            cell = (mixed >> np.uint64(8)) % np.uint64(cells)
            by = np.argsort(cell, kind="stable")
            count = np.bincount(cell.astype(np.int64), minlength=cells)
            sums = np.zeros(cells, dtype=np.uint64)
            held = count > 0
            sums[held] = np.add.reduceat(_mixed(mixed + np.uint64(1))[by], (np.cumsum(count) - count)[held])
            count, sums = count.reshape(band.n1, band.n2), sums.reshape(band.n1, band.n2)
            weak = np.zeros(band.n1, dtype=bool)
            for j, subset in enumerate(subsets):
                n = count[:, subset].sum(axis=1)
                tag = (np.arange(band.n1, dtype=np.uint64) << np.uint64(8)) + np.uint64(j)
                keys = _mixed(sums[:, subset].sum(axis=1, dtype=np.uint64) + _mixed(tag + (seed << np.uint64(36))))
                thin = n < band.m
                weak |= thin
                out.append(keys if level == LEVELS - 1 else keys[~thin])
            if weak.sum() <= band.spare:
                break
        return out


SIGNED = "doc_id bigint, tie bigint, node bigint, n_shingles bigint, digest binary, sigs array<bigint>"


def _signed(size: int, percent: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        scheme, known, node = PartEnum(percent), WordHashes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for text in part.column(2):
                    hashes = shingle_hashes(words_of(text.as_py()), size, known)
                    node += 1
                    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None
                    out.append((node, len(hashes), digest, scheme.signatures(hashes)))
                nodes, n, digests, sigs = zip(*out, strict=True)
                offsets = pa.array(np.r_[0, np.cumsum([*map(len, sigs)])].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(digests, pa.binary()),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sigs)))],
                    names=["doc_id", "tie", "node", "n_shingles", "digest", "sigs"])

    return sign


def _with_class(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """``rows`` with their class's columns; the few classes that hold much of all rows by broadcast."""
    hot = classes.filter(F.col("n") * HOT >= F.lit(total))
    few = F.broadcast(hot.limit(HOT))
    return rows.join(few, "digest").unionByName(
        rows.join(few, "digest", "left_anti").join(
            classes.filter(F.col("n") * HOT < F.lit(total)).hint("merge"), "digest"))


def block_links(queries: list[tuple], members: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Links of queries to members of other components, one per query and component.

    Both are (node, component, sorted set).
    """
    nodes, parts = (np.array([m[i] for m in members], dtype=np.int64) for i in (0, 1))
    sizes = np.array([len(m[2]) for m in members])
    shingles, owner = np.concatenate([m[2] for m in members]), np.repeat(np.arange(len(members)), sizes)
    by = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[by], owner[by]
    for node, part, own in queries:
        low, high = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
        width = high - low
        at = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(width.sum())
        both = np.bincount(owner[at], minlength=len(members))
        linked = np.flatnonzero((parts != part) & (100 * both >= percent * (len(own) + sizes - both)))
        _, first = np.unique(parts[linked], return_index=True)
        for other in nodes[linked[first]].tolist():
            yield node, other


def _family_links(size: int, percent: int):
    """Rows (family, i, j, query, node, component, text), sorted by block -> links."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block, sides = WordHashes(), None, ([], [])

        def done() -> pa.RecordBatch:
            found = list(block_links(sides[1], sides[0], percent)) if sides[0] and sides[1] else []
            return pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for k, (family, i, j, query, node, component) in enumerate(zip(*columns, strict=True)):
                if (family, i, j) != block:
                    yield done()
                    block, sides = (family, i, j), ([], [])
                sides[query].append(
                    (node, component, shingle_hashes(words_of(batch.column(6)[k].as_py()), size, known)))
        yield done()

    return links


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                       percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links reach) of every row."""
    if not 70 <= percent <= 100:  # below, a signature would hold hardly a shingle
        raise ValueError("percent must be a whole number from 70 to 100")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn(
        "tie", F.xxhash64("text"))
    signed = saved(texts.select("doc_id", "tie", "text").mapInArrow(_signed(size, percent), SIGNED),
                   "partenum-signed")
    sets = signed.filter(F.col("digest").isNotNull())
    classes = saved(sets.groupBy("digest").agg(
        F.min("node").alias("rep"), F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "partenum-classes")
    total = signed.count()
    rows = saved(_with_class(sets.select("doc_id", "tie", "node", "n_shingles", "digest"),
                             classes.select("digest", "rep", "n"), total), "partenum-rows")

    # Buckets: signatures of several rows, then of several classes.
    # Half of a signature's bits tells nearly all that nothing else has, for half the shuffle.
    entries = sets.select("node", F.explode("sigs").alias("bucket")).withColumn(
        "cell", F.shiftright("bucket", 32).cast("int"))
    shared = saved(entries.groupBy("cell").agg(F.count("*").alias("k")).filter("k > 1").select("cell"),
                   "partenum-shared")
    held = saved(entries.join(shared.hint("merge"), "cell").select("bucket", "node"), "partenum-held")
    # Copies of a class have the same signatures; its representative is a row of them.
    # Sides that grow with the documents are shuffled at every size.
    held = held.join(classes.select(F.col("rep").alias("node")).hint("merge"), "node", "left_semi")
    least = held.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("k")).filter(
        "k > 1").select("bucket", "pivot")
    members = saved(held.join(least.hint("merge"), "bucket"), "partenum-members")
    pairs = members.filter("node != pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(
        F.count("*").alias("k"))
    best = saved(pairs.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a")).select("a", "b"),
                 "partenum-best")

    needed = saved(rows.filter("node = rep").join(members.select("node").distinct(), "node", "left_semi").select(
        "node", "doc_id", "tie", "n_shingles"), "partenum-needed")
    own = texts["doc_id"].eqNullSafe(needed["doc_id"]) & (texts["tie"] == needed["tie"])
    near = saved(texts.join(needed.hint("merge"), own).select("node", "text").dropDuplicates(["node"]), "partenum-texts")
    links = saved(_attached(best, near, "text").mapInArrow(
        _verifier(size, percent), "a bigint, b bigint, linked boolean").filter("linked").select("a", "b"),
        "partenum-links")
    label = saved(components(links), "partenum-components")

    # Buckets of several components, and the families that they form.
    placed = members.join(label, "node", "left").select(
        "bucket", "pivot", "node", F.coalesce("component", "node").alias("component"))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    largest = parts.groupBy("bucket").agg(
        F.count("*").alias("parts"), F.max_by("component", F.struct("k", -F.col("component"))).alias("largest")
    ).filter("parts > 1").select("bucket", "largest")
    placed = saved(placed.join(largest, "bucket"), "partenum-mixed")
    family = components(placed.select(F.col("pivot").alias("a"), F.col("node").alias("b"))).withColumnRenamed(
        "component", "family")
    kin = placed.groupBy("node", "component").agg(
        F.max((F.col("component") != F.col("largest")).cast("int")).alias("query")).join(family, "node").join(
        needed.select("node", "n_shingles"), "node")
    kin = saved(kin, "partenum-families")
    sizes = kin.groupBy("family").agg(
        F.ceil(F.sum("n_shingles") / F.lit(BLOCK)).cast("int").alias("rows"),
        F.ceil(F.sum(F.col("query") * F.col("n_shingles")) / F.lit(BLOCK)).cast("int").alias("queries"))
    turn = F.xxhash64("node")
    dealt = kin.join(sizes, "family").withColumn("side", F.explode(F.when(
        F.col("query") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    mine = F.when(F.col("side") == 1, F.pmod(turn, F.col("queries"))).otherwise(F.pmod(turn, F.col("rows")))
    others = F.sequence(F.lit(0), F.when(F.col("side") == 1, F.col("rows")).otherwise(F.col("queries")) - 1)
    dealt = dealt.withColumn("own", mine.cast("int")).withColumn("other", F.explode(others)).select(
        "family", F.when(F.col("side") == 1, F.col("own")).otherwise(F.col("other")).alias("i"),
        F.when(F.col("side") == 1, F.col("other")).otherwise(F.col("own")).alias("j"),
        F.col("side").alias("query"), "node", "component")
    blocks = dealt.join(near, "node").select("family", "i", "j", "query", "node", "component", "text")
    late = saved(blocks.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(
        _family_links(size, percent), "a bigint, b bigint"), "partenum-late")
    if not late.isEmpty():
        label = saved(components(links.unionByName(late)), "partenum-all-components")

    # Components by their least id, then back to every row.
    owned = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    least_ids = owned.groupBy("component").agg(F.min("least_id").alias("component_id"))
    owned = saved(owned.join(least_ids, "component").select("digest", "n", "component_id"), "partenum-owned")
    found = _with_class(sets.select("doc_id", "n_shingles", "digest"), owned, total)
    return found.select("doc_id", "n_shingles", "component_id").unionByName(
        signed.filter(F.col("digest").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
