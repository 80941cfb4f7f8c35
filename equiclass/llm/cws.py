"""Document fingerprints by consistent weighted sampling.

A text is a bag of terms: its words, weighted by how often they occur. For each of K
samples, a term x of weight w draws from hashes of (x, k): r and c from Gamma(2, 1), b
uniform; then t = floor(ln w / r + b) and ln a = ln c - r * (t - b + 1). The sample is the
(x, t) of the least a. Two texts have equal samples with the probability of their
generalised Jaccard similarity, sum of min(w) / sum of max(w), so the share of equal
samples estimates it.

A sample travels as one long: ln a in fixed point above 32 bits that tell (x, t), so that
the least long is the sample, and sampling is a plain ``min`` aggregate: rows of one text
are next to one another, so each task sums them up before anything is shuffled.

The edited text of a document (the contract's second text) replaces its second half by
the beginning of the next document's text, in ascending order of ids. The order is cut
into ranges of about ``RANGE_ROWS`` documents; the next text is found in the range, whose
end holds a copy of the following range's first document. Texts are shuffled once, by
range, and nothing else is: a text and its edited form share most of their terms, so a
term of one weight in both is one row, drawn for once; the next document's signature is the
one below in the range. There are at most ``MAX_RANGES``
ranges of ids (their bounds are part of the plan), so ranges grow beyond
``MAX_RANGES * RANGE_ROWS`` rows; sorting them spills to disk. Rows without an id have
ranges of their own, by the hash of their texts.

Terms are 63-bit hashes. Very long texts: a text's words are one array of hashes in its
row, whole; what follows is one row per distinct term.

Null texts count as empty. A text without words has no samples: its fingerprint is
``EMPTY``, its likeness 1 to another such text and 0 to any other. Null ids come first;
equal ids are ordered by a hash of the text. The one document of a table is its own next.
An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SAMPLES = 64
RANGE_ROWS = 1_024
MAX_RANGES = 65_536
EMPTY = "empty"
#: Fixed point: ln a between -LIMIT and LIMIT, in steps of 1 / SCALE (31 bits).
LIMIT, SCALE = 128.0, float(1 << 23)


def terms(text: Column) -> Column:
    """The words of a text as even hashes, with repetitions."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    words = F.array_remove(F.split(spaced, " "), "")
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)))


def weighted(df: DataFrame, text: Column, other: Column, keep: list[str]) -> DataFrame:
    """The distinct terms of two texts: ``keep``, term, weight, part; one row of nulls if both have none.

    ``part`` is 1 for a term of the text, 2 for one of the other, 3 for a term of both with
    one weight.
    """
    # Odd hashes mark the other text, so its words follow the text's equal ones.
    odd = F.transform(terms(other), lambda h: h.bitwiseOR(F.lit(1)))
    df = df.select(*keep, F.sort_array(F.concat(terms(text), odd)).alias("hashes"))
    last = F.size("hashes") - 1
    own, bounds = F.col("hashes"), F.col("bounds")
    df = df.withColumn("firsts", F.when(last < 0, F.array().cast("array<int>")).otherwise(F.filter(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: (i == 0) | (F.get(own, i) != F.get(own, i - 1)))))
    df = df.withColumn("bounds", F.concat(F.col("firsts"), F.array(F.size(own))))

    def run(at: Column, j: Column) -> Column:
        """A run of equal hashes; null where the run before has told it."""
        h, end = F.get(own, at), F.get(bounds, j + 1)
        weight = end - at
        is_other = h.bitwiseAND(F.lit(1)) == 1
        told = is_other & (F.get(own, at - 1) == h - 1) & (at - F.get(bounds, j - 1) == weight)
        both = (F.get(own, end) == h.bitwiseOR(F.lit(1))) & (F.get(bounds, j + 2) - end == weight)
        part = F.when(is_other, 2).when(both, 3).otherwise(1)
        return F.when(~F.coalesce(told, F.lit(False)), F.struct(
            h.bitwiseAND(F.lit(-2)).alias("term"), weight.alias("weight"), part.alias("part")))

    runs = F.filter(F.transform("firsts", run), lambda r: r.isNotNull())
    return df.select(*keep, F.explode_outer(runs).alias("run")).select(*keep, "run.*")


def _units(h: Column) -> tuple[Column, Column]:
    """Two uniform numbers in (0, 1) from a hash's halves."""
    scale = F.lit(1.0 / (1 << 32))
    return ((F.shiftrightunsigned(h, 32) + F.lit(0.5)) * scale,
            (h.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)) * scale)


def sample(k: int) -> Column:
    """The k-th draw of a row's term as one long; the least of a text is its sample."""
    h = [F.xxhash64("term", F.lit(3 * k + i)) for i in range(3)]
    u, v = _units(h[0])
    r = -F.log(u * v)
    u, v = _units(h[1])
    log_c = F.log(-F.log(u * v))
    b, _ = _units(h[2])
    t = F.floor(F.col("log_weight") / r + b)
    log_a = log_c - r * (t - b + 1)
    level = F.floor((F.least(F.greatest(log_a, F.lit(-LIMIT)), F.lit(LIMIT - 1)) + F.lit(LIMIT)) * F.lit(SCALE))
    tag = h[2].bitwiseXOR(t * F.lit(0x9E3779B1)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(level, 32).bitwiseOR(tag)


def _least(a: Column, b: Column) -> Column:
    """The lesser of each two draws; null counts as no draws."""
    return F.coalesce(F.zip_with(a, b, lambda x, y: F.least(x, y)), a, b)


def pair_signatures(df: DataFrame, keys: list[str], text: Column, other: Column,
                    samples: int = SAMPLES) -> DataFrame:
    """``keys``, ``sig`` and ``other_sig`` (arrays of longs; null for a text without words), one row per distinct keys."""
    rows = weighted(df, text, other, keys).select(
        *keys, F.coalesce("part", F.lit(0)).alias("part"), "term", F.log(F.col("weight").cast("double")).alias("log_weight"))
    found = rows.groupBy(*keys, "part").agg(*(F.min(sample(k)).alias(f"s{k}") for k in range(samples)))
    sig = F.array(*(F.col(f"s{k}") for k in range(samples)))
    parts = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("part", sig))).alias("parts"))
    one, two, both = (F.col("parts")[i] for i in (1, 2, 3))
    return parts.select(*keys, _least(one, both).alias("sig"), _least(two, both).alias("other_sig"))


def signatures(df: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``sig`` (array of longs; null for a text without words): one row per row of distinct keys."""
    return pair_signatures(df, keys, F.col(text), F.lit(None).cast("string"), samples).drop("other_sig")


def fingerprint(sig: Column) -> Column:
    """Eight hex digits per sample."""
    digits = F.transform(sig, lambda s: F.lpad(F.lower(F.hex(F.xxhash64(s).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(EMPTY))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples, 0 to 1."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return (F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0)
            .otherwise(equal / F.lit(float(samples))))


def _ranged(docs: DataFrame, ranges: int, null_ranges: int = 1) -> DataFrame:
    """Adds ``range``: ascending with doc_id, cut at approximate quantiles (two-level lookup).

    Rows without an id come first, in ranges 0 to ``null_ranges`` - 1, ascending with ``tie``.
    """
    # The upper half of the hash, shifted to 0 .. 2**32 - 1.
    turn = F.shiftright("tie", 32) + F.lit(1 << 31)
    by_tie = F.shiftright(turn * F.lit(null_ranges), 32)
    found = None
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        found = docs.select(F.percentile_approx("doc_id", shares, 20 * ranges)).first()[0]
    bounds = sorted(set(found or []))
    if not bounds:
        return docs.withColumn("range", F.when(F.col("doc_id").isNull(), by_tie).otherwise(null_ranges).cast("long"))
    width = math.isqrt(len(bounds))
    groups = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    heads = F.from_json(F.lit(str([g[0] for g in groups])), "array<bigint>")
    tails = F.from_json(F.lit(str(groups)), "array<array<bigint>>")
    doc_id = F.col("doc_id")
    docs = docs.withColumn("group", F.size(F.filter(heads, lambda x: x <= doc_id)))
    in_group = F.size(F.filter(F.get(tails, F.col("group") - 1), lambda x: x <= doc_id))
    return docs.withColumn("range", F.when(doc_id.isNull(), by_tie).otherwise(F.lit(null_ranges) + F.when(
        F.col("group") == 0, 0).otherwise((F.col("group") - 1) * width + in_group)).cast("long")).drop("group")


def _placed(docs: DataFrame, range_rows: int) -> DataFrame:
    """The rows by range: doc_id, text, range, place (1, 2, ... in the range), copy, home, next_* of the row below.

    The last row of a range is the first of the following one (``copy`` 1, ``home`` its own
    range); the last range ends with the first's first.
    """
    n = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    ranges, null_ranges = (min(MAX_RANGES, max(1, math.ceil(c / range_rows))) for c in (n["ids"], n["n"] - n["ids"]))
    rows = _ranged(docs.withColumn("tie", F.xxhash64("text")), ranges, null_ranges)

    # The first document of each range, for the range before it (at most one row per range).
    firsts = rows.groupBy("range").agg(F.min_by(F.struct("doc_id", "tie"), F.struct("doc_id", "tie")).alias("f"))
    order = Window.orderBy("range")
    firsts = saved(firsts.select("range", "f.doc_id", "f.tie"), "cws-firsts")
    last = firsts.agg(F.max("range")).first()[0]
    firsts = firsts.withColumn("before", F.coalesce(F.lag("range").over(order), F.lit(last)))
    same = (rows["doc_id"].eqNullSafe(firsts["doc_id"]) & (rows["tie"] == firsts["tie"])
            & (rows["range"] == firsts["range"]))
    marked = rows.join(F.broadcast(firsts.select("doc_id", "tie", "range", "before")), same, "left").select(
        rows["doc_id"], "text", rows["tie"], rows["range"].alias("home"), "before")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("home").alias("range"), F.lit(0).alias("copy"))))
    places = places.otherwise(F.array(F.struct(F.col("home").alias("range"), F.lit(0).alias("copy")),
                                      F.struct(F.col("before").alias("range"), F.lit(1).alias("copy"))))
    rows = marked.withColumn("place", F.explode(places)).select(
        "doc_id", "text", "tie", "home", "place.range", "place.copy")
    w = Window.partitionBy("range").orderBy("copy", F.col("doc_id").asc_nulls_first(), "tie", "text")
    return rows.select("doc_id", "text", "range", "copy", "home", F.row_number().over(w).alias("place"),
                       *(F.lead(c).over(w).alias(f"next_{c}") for c in ("copy", "home", "text")))


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text (both as given, text not null) with key, next_key, next_text in ascending order of ids.

    After the last document comes the first. Keys are longs in that order.
    """
    rows = _placed(docs, range_rows).filter("copy = 0")
    rows = rows.withColumn("key", F.shiftleft("home", 32) + F.col("place"))
    next_key = F.when(F.col("next_copy") == 1, F.shiftleft("next_home", 32) + 1).otherwise(F.col("key") + 1)
    return rows.select("doc_id", "text", "key", next_key.alias("next_key"), "next_text")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 samples: int = SAMPLES) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = _placed(rows, RANGE_ROWS).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
                      F.substring(F.col("next_text"), F.lit(1), half))
    # A copied row gives its own signature to the row above and has no edited text.
    rows = rows.withColumn("edited", F.when(F.col("copy") == 0, edited)).withColumn(
        "edited_sha256", F.sha2(F.col("edited"), 256))
    # Grouped and ordered within the ranges: no further shuffle.
    keys = ["range", "place", "copy", "doc_id", "n_chars", "edited_sha256"]
    sigs = pair_signatures(rows, keys, F.col("text"), F.col("edited"), samples)
    following = F.lead("sig").over(Window.partitionBy("range").orderBy("place"))
    return sigs.withColumn("next_sig", following).filter("copy = 0").select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sig")).alias("fingerprint"),
        fingerprint(F.col("other_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("other_sig"), samples).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig"), samples).alias("near_next"))
