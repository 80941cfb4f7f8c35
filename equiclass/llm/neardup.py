"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification.

A document is the set of its word shingles; documents whose sets have a Jaccard similarity
of at least the threshold are linked, and linked documents form components.

1. Documents with equal sets are one class, told by a 128-bit digest of the sorted set;
   everything below runs on one node per class, however many copies it has.
2. Signatures of ``bands * rows`` MinHash values; nodes that agree in all rows of a band share
   a bucket. Bands and rows follow from the threshold: as many rows as fit into
   ``MAX_VALUES`` while a pair at the threshold shares no bucket with probability ``MISS``
   at most. Only the values' low eight bits are kept beside the buckets.
3. In every bucket each node is compared with pivots: the least node under one of ``PIVOTS``
   orders, by band. The number of comparisons grows with the bucket, not its square.
4. A comparison looks at batches of ``BATCH`` signature values. After each, with m of n values
   equal, the pair is pruned if its similarity, with a uniform prior, reaches the threshold
   with posterior probability under ``MISS``.
5. Each node's best surviving partner is verified exactly, on the words of both texts. This
   connects most of every group; the components are found.
6. What shares a bucket but not yet a component: buckets that hold several components, joined
   where they share nodes, are families. In each, the nodes outside a bucket's largest
   component are compared with all others, as in 4, and survivors verified on their full sets.
   This happens in blocks of ``BLOCK`` by ``BLOCK`` nodes, each in one task; of a node's links to a
   component one is kept. Links within a component would change nothing, so the components
   are those of all links that share a bucket.

Hot nodes (a pivot of very many pairs) are dealt out by salted joins. Nothing is collected to
the driver but counts.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z; a text with fewer words than a shingle is
one shingle, the whole sequence; null texts and texts without words have no set and no links.
Null ids take part, but name no component unless all its ids are null. Repeated ids are
separate documents. An empty table gives an empty result. Only the id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .graph import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE, THRESHOLD = 5, 0.8
MISS = 1e-6
MAX_VALUES = 256
BATCH = 32
PIVOTS = 4
#: Row keys (24 bytes each) at most that are sent to every task to find their texts; more are joined by a shuffle.
SENT_ROWS = 1_000_000
#: Nodes of a family on either side of one block of comparisons.
BLOCK = 1_000
#: Pairs of one node that stay together in a join.
SPREAD = 2_000
#: Copies of every class row in the join that gives rows their component.
SALT = 8
SEED = 20_231


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shape(threshold: float, miss: float = MISS, most: int = MAX_VALUES) -> tuple[int, int]:
    """(bands, rows a band): the most rows whose bands fit into ``most`` values."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(miss) / math.log1p(-threshold ** rows)) if threshold < 1 else 1
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("the threshold is too low for this number of signature values")
    return best


def least_matches(values: int, threshold: float, miss: float = MISS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(n, m) after each batch: fewer than m equal values among n prune a pair.

    With a uniform prior, m equal of n leave Beta(m + 1, n - m + 1), which exceeds t with the
    probability that at most m of n + 1 trials succeed, each with probability t. Bytes of
    different values are equal in one of 256 cases, so t is the threshold raised by that.
    """
    out, t = [], threshold + (1 - threshold) / 256
    for n in [*range(batch, values, batch), values]:
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                             + m * math.log(t) + (n + 1 - m) * math.log1p(-t)) if t < 1 else float(m == n)
        out.append((n, m))
    return out


class WordHashes(dict):
    """64-bit hashes of words; up to 100,000 (about 14 MB) are remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = np.array([*map(known.__getitem__, words)], dtype=np.uint64)
    width = min(size, len(own))
    mixed = np.full(len(own) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        mixed = (mixed ^ own[j:len(own) - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def minhash(hashes: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    own = (hashes >> np.uint64(16)).astype(np.uint32)
    for at in range(0, len(own), 1024):
        np.minimum(least, (own[at:at + 1024] * factors[:, None] + terms[:, None]).min(axis=1), out=least)
    return least


class Signer:
    """Signatures and bucket keys of shingle sets."""

    def __init__(self, size: int, bands: int, rows: int):
        random = np.random.default_rng(SEED)
        n = bands * rows
        self.size, self.bands, self.rows = size, bands, rows
        self.factors = random.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.terms = random.integers(0, 1 << 32, n, dtype=np.uint32)
        self.mix = random.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        self.known = WordHashes()

    def shingles(self, text: str | None) -> np.ndarray:
        return shingle_hashes(words_of(text), self.size, self.known)

    def values(self, hashes: np.ndarray) -> np.ndarray:
        return minhash(hashes, self.factors, self.terms)

    def buckets(self, values: np.ndarray) -> np.ndarray:
        keys = np.bitwise_xor.reduce(values.reshape(self.bands, self.rows) * self.mix + (self.mix >> np.uint64(7)), axis=1)
        keys = (keys ^ (keys >> np.uint64(31)) ^ np.arange(self.bands, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        return keys.view(np.int64)


def _signed(size: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        signer, node = Signer(size, bands, rows), TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for text in part.column(2):
                    hashes = signer.shingles(text.as_py())
                    node += 1
                    if not len(hashes):
                        out.append((node, 0, None, None, None))
                        continue
                    values = signer.values(hashes)
                    out.append((node, len(hashes), hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(),
                                values.astype(np.uint8).tobytes(), signer.buckets(values)))
                nodes, n, digests, sigs, keys = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "tie", "node", "n_shingles", "digest", "sig", "bands"])

    return sign


SIGNED = "doc_id bigint, tie bigint, node bigint, n_shingles bigint, digest binary, sig binary, bands array<bigint>"


def surviving(one: np.ndarray, two: np.ndarray, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``one`` (or the one row) and ``two`` that no batch prunes, and their equal values."""
    left, equal, lo = np.arange(len(two)), np.zeros(len(two), dtype=np.int64), 0
    for n, least in limits:
        own = one[lo:n] if one.ndim == 1 else one[left, lo:n]
        equal = equal + (own == two[left, lo:n]).sum(axis=1)
        on = equal >= least
        left, equal, lo = left[on], equal[on], n
    return left, equal


def _pruner(values: int, threshold: float, miss: float):
    limits = least_matches(values, threshold, miss)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(-1, values)
                        for c in (b.column(2), b.column(3)))
            left, equal = surviving(one, two, limits)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(left)), b.column(1).take(pa.array(left)), pa.array(equal)],
                names=["a", "b", "equal"])

    return prune


def block_links(queries: list[tuple], members: list[tuple], limits, percent: int) -> Iterator[tuple[int, int]]:
    """Links of queries to members of other components, one per query and component.

    Both are (node, component, sorted set, signature bytes).
    """
    sigs = np.stack([m[3] for m in members])
    nodes, parts = (np.array([m[i] for m in members], dtype=np.int64) for i in (0, 1))
    sizes = np.array([len(m[2]) for m in members])
    shingles, owner = np.concatenate([m[2] for m in members]), np.repeat(np.arange(len(members)), sizes)
    by = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[by], owner[by]
    for node, part, own, sig in queries:
        left, _ = surviving(sig, sigs, limits)
        left = left[parts[left] != part]
        if not len(left):
            continue
        lo, hi = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
        width = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
        both = np.bincount(owner[at], minlength=len(members))[left]
        linked = left[100 * both >= percent * (len(own) + sizes[left] - both)]
        _, first = np.unique(parts[linked], return_index=True)
        for other in nodes[linked[first]].tolist():
            yield node, other


def _family_links(size: int, bands: int, rows: int, threshold: float, miss: float, percent: int):
    """Rows (family, i, j, query, node, component, text), sorted by block -> links."""
    limits = least_matches(bands * rows, threshold, miss)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, block, sides = Signer(size, bands, rows), None, ([], [])

        def done() -> pa.RecordBatch:
            found = list(block_links(sides[1], sides[0], limits, percent)) if sides[0] and sides[1] else []
            return pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for k, (family, i, j, query, node, component) in enumerate(zip(*columns, strict=True)):
                if (family, i, j) != block:
                    yield done()
                    block, sides = (family, i, j), ([], [])
                own = signer.shingles(batch.column(6)[k].as_py())
                sides[query].append((node, component, own, signer.values(own).astype(np.uint8)))
        yield done()

    return links


def _verifier(size: int, percent: int):
    def shingles(text: str) -> set:
        words = words_of(text)
        return set(zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else {tuple(words)}

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            linked = []
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, own = a, shingles(one.as_py())
                other = shingles(two.as_py())
                both = len(own & other)
                linked.append(100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return verify


def _attached(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """a, b, ``value``_a, ``value``_b: the side table's value for both nodes of each pair.

    The nodes of column a may be in very many pairs: their rows are copied, one copy for
    every ``SPREAD`` pairs, and the pairs dealt among the copies.
    """
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(SPREAD)).cast("int").alias("copies"))
    dealt = pairs.join(copies, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    one = side.select(F.col("node").alias("a"), F.col(value).alias(f"{value}_a")).join(copies, "a").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    two = side.select(F.col("node").alias("b"), F.col(value).alias(f"{value}_b"))
    return dealt.drop("copies").join(two, "b").join(one, ["a", "salt"]).select(
        "a", "b", f"{value}_a", f"{value}_b")


def _sent(keys: DataFrame) -> DataFrame:
    """Saved keys as the other side of a join with texts, which stay where they are if the keys are few."""
    return F.broadcast(keys) if keys.count() <= SENT_ROWS else keys


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                    threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """doc_id, tie (hash of the text), n_shingles, component_id, kept, first of every row.

    kept: the id is the component's least. first: true for one row of each component, whatever
    ids repeat (the least id's; ties by hash of the text).
    """
    percent = round(100 * threshold)
    if abs(percent - 100 * threshold) > 1e-9 or not 0 < percent <= 100:
        raise ValueError("the threshold must be a whole percentage")
    bands, rows = shape(threshold, miss)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn(
        "tie", F.xxhash64("text"))
    signed = saved(texts.select("doc_id", "tie", "text").mapInArrow(_signed(size, bands, rows), SIGNED),
                   "neardup-signed")

    # Classes of equal sets, each told by the node of one of its rows.
    classes = saved(signed.filter(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("node").alias("node"), F.min("doc_id").alias("least_id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "node")).alias("first_row")),
        "neardup-classes")
    nodes = saved(signed.join(classes.select("node").hint("merge"), "node", "left_semi").select(
        "node", "doc_id", "tie", "n_shingles", "sig", "bands"), "neardup-nodes")

    # Buckets of two nodes or more, with their pivot.
    entries = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "bucket")).withColumn(
        "mask", F.xxhash64(F.col("band") % PIVOTS))
    buckets = entries.groupBy("bucket", "mask").agg(
        F.count("*").alias("n"), F.min(F.col("node").bitwiseXOR(F.col("mask"))).alias("least")).filter(
        "n > 1").select("bucket", F.col("least").bitwiseXOR(F.col("mask")).alias("pivot"))
    members = saved(entries.select("node", "bucket").join(buckets.hint("merge"), "bucket"), "neardup-buckets")
    pairs = saved(members.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
                  .distinct(), "neardup-pairs")

    # The texts of nodes that share a bucket; others are never looked at again.
    needed = saved(nodes.select("node", "doc_id", "tie").join(
        members.select("node").distinct(), "node", "left_semi"), "neardup-needed")
    own = texts["doc_id"].eqNullSafe(needed["doc_id"]) & (texts["tie"] == needed["tie"])
    near = saved(texts.join(_sent(needed), own).select("node", "text")
                 .dropDuplicates(["node"]), "neardup-texts")

    survivors = saved(_attached(pairs, nodes, "sig").mapInArrow(
        _pruner(bands * rows, threshold, miss), "a bigint, b bigint, equal bigint"), "neardup-survivors")
    best = survivors.groupBy("b").agg(F.max("equal").alias("equal"))
    best = saved(survivors.join(best, ["b", "equal"]).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"),
                 "neardup-best")
    links = saved(_attached(best, near, "text").mapInArrow(
        _verifier(size, percent), "a bigint, b bigint, linked boolean").filter("linked").select("a", "b"),
        "neardup-links")
    label = saved(components(links), "neardup-components")

    # Buckets of several components, and the families that they form.
    placed = members.join(label, "node", "left").select(
        "bucket", "pivot", "node", F.coalesce("component", "node").alias("component"))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    several = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max("n").alias("n")).filter("parts > 1")
    largest = parts.join(several.select("bucket", "n"), ["bucket", "n"]).groupBy("bucket").agg(
        F.min("component").alias("largest"))
    placed = saved(placed.join(largest, "bucket"), "neardup-mixed")
    family = components(placed.select(F.col("pivot").alias("a"), F.col("node").alias("b"))).withColumnRenamed(
        "component", "family")
    kin = placed.groupBy("node", "component").agg(
        F.max((F.col("component") != F.col("largest")).cast("int")).alias("query")).join(family, "node")
    kin = saved(kin, "neardup-families")
    sizes = kin.groupBy("family").agg(
        F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("rows"),
        F.ceil(F.sum("query") / F.lit(BLOCK)).cast("int").alias("queries"))
    turn = F.xxhash64("node")
    dealt = kin.join(sizes, "family").withColumn("sides", F.when(
        F.col("query") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).withColumn(
        "side", F.explode("sides"))
    own_block = F.when(F.col("side") == 1, F.pmod(turn, F.col("queries"))).otherwise(F.pmod(turn, F.col("rows")))
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 1, F.col("rows")).otherwise(F.col("queries")) - 1))
    dealt = dealt.withColumn("own", own_block.cast("int")).withColumn("other", others).select(
        "family", F.when(F.col("side") == 1, F.col("own")).otherwise(F.col("other")).alias("i"),
        F.when(F.col("side") == 1, F.col("other")).otherwise(F.col("own")).alias("j"),
        F.col("side").alias("query"), "node", "component")
    blocks = dealt.join(near, "node").select(
        "family", "i", "j", "query", "node", "component", "text")
    late = saved(blocks.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(
        _family_links(size, bands, rows, threshold, miss, percent), "a bigint, b bigint"), "neardup-late")
    if not late.isEmpty():
        label = saved(components(links.unionByName(late)), "neardup-all-components")

    # Components by their least id, then back to every row.
    owned = classes.join(label, "node", "left").select(
        "digest", "least_id", "first_row", F.coalesce("component", "node").alias("component"))
    least = owned.groupBy("component").agg(F.min("least_id").alias("component_id"),
                                           F.min("first_row").getField("node").alias("first_node"))
    owned = owned.join(least, "component").select(
        "digest", "component", "component_id", "first_node", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    every = signed.select("doc_id", "tie", "node", "n_shingles", "digest",
                          F.pmod("node", F.lit(SALT)).cast("int").alias("salt"))
    found = every.join(owned, ["digest", "salt"], "left").withColumn(
        "component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return found.select("doc_id", "tie", "n_shingles", "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                        (F.col("digest").isNull() | (F.col("node") == F.col("first_node"))).alias("first"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                            size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component.

    Rows equal in id and text count as one and stay together; see ``one_of_each_component``.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, size=size, threshold=threshold)
    gone = saved(found.filter(~F.col("kept")).select(
        F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie")).distinct(), "neardup-gone")
    tie = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return docs.join(_sent(gone), F.col(f"`{id_col}`").cast("long").eqNullSafe(gone["gone_id"])
                     & (tie == gone["gone_tie"]), "left_anti")


def one_of_each_component(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                          size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each component, whatever ids repeat or are null; rows without words all stay.

    Of rows equal in id and text, the one with the least hash of all columns (but maps) stays.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, size=size, threshold=threshold)
    marks = found.filter("n_shingles > 0").groupBy("doc_id", "tie").agg(
        F.max("first").alias("first"), F.count("*").alias("n")).filter("not first or n > 1")
    marks = saved(marks.select(F.col("doc_id").alias("mark_id"), F.col("tie").alias("mark_tie"), "first"),
                  "neardup-marks")
    own_id = F.col(f"`{id_col}`").cast("long")
    tie = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    same = own_id.eqNullSafe(marks["mark_id"]) & (tie == marks["mark_tie"])
    few = _sent(marks)
    single, repeated = docs.join(few, same, "left_anti"), few.filter("first")
    if repeated.isEmpty():
        return single
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    several = docs.join(repeated, same, "left_semi").groupBy(own_id.alias("own_id"), tie.alias("own_tie")).agg(
        F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*hashed)).alias("row"))
    return single.unionByName(several.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))
