"""Benchmark decontamination: short test items inside long documents, by MinHash containment.

An item and a document are sets of word shingles; an item is found in a document that holds
at least ``THRESHOLD`` of the item's shingles. As in an LSH ensemble, documents are partitioned
by the size of their sets, and each partition has its own signatures, whose length suits
sets of that size: one-permutation MinHash with about ``2**extra`` bins for every shingle of the
partition's largest set (each shingle hashes into a bin, each bin keeps its least hash).
An item gets a signature in every partition. A bin in which both hold the same hash is a
collision; a document and an item with at least one are a candidate pair.

No cut on short items: with L shingles a bin on average, a document's shingle is its bin's
least with probability (1 - e**-L) / L, so a document that holds c shingles of an item is
missed with at most (1 - that)**c. ``extra`` is the least number that keeps this below
``MISS`` for the smallest item (from 2**-20 shingles a bin on, practically all are kept).

Candidates are verified exactly: their shingles are compared as strings.

Words are runs of letters and digits, lower-cased; shingles take ``WORDS`` of them. An item
with fewer words is one shingle, its whole sequence, and is found where a document has those
words next to one another: its hash is looked up among the document's windows of that many
words (only lengths that some item has are looked up), the words themselves are compared. A
text without words has no shingles and matches nothing. Null texts count as empty. Repeated items are matched one by one; rows repeated in
every column are too. An empty table gives an empty result. Only the ids and texts are read.

Scale. All work on a document's shingles happens within its row, up to the explode of its
signature, which is looked up in the items' signatures: these are sent to every task while
there are at most ``SENT_ROWS`` of them (the count is checked), else both sides are shuffled
by hash. Verification reads the candidates' texts alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

WORDS = 5
THRESHOLD = 0.8
MISS = 1e-6
MAX_EXTRA = 20
#: Rows of item signatures, or of item shingles, that are sent to every task (16 to about 60 bytes each).
SENT_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingled(df: DataFrame, words_col: str, size: int, to: Column, out: str) -> DataFrame:
    """Adds ``out``: ``to`` (a function of a start index) of every shingle of the words, in order."""
    n = F.size(words_col)
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))))
    return df.withColumn(out, F.transform(starts, to))


def hashed_shingles(df: DataFrame, text: str, size: int, out: str) -> DataFrame:
    """Adds ``out``: the sorted hashes of a text's shingles, with repetitions."""
    df = df.withColumn("sh_words", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    df = _shingled(df, "sh_words", size, lambda i: F.xxhash64(*(
        F.get("sh_words", i + j) for j in range(size))), "sh_hashes")
    return df.withColumn(out, F.sort_array("sh_hashes")).drop("sh_words", "sh_hashes")


def string_shingles(df: DataFrame, text: str, size: int, keep: list[str]) -> DataFrame:
    """One row per distinct shingle of a text: ``keep``, shingle."""
    df = df.withColumn("sh_words", words(F.col(text)))
    df = _shingled(df, "sh_words", size, lambda i: F.concat_ws(" ", F.slice("sh_words", i + 1, size)), "sh_all")
    return df.select(*keep, F.explode(F.array_distinct("sh_all")).alias("shingle"))


def extra_bits(smallest: int, threshold: float, miss: float) -> int:
    """How many bins a document's shingle must have (as a power of 2) for recall on the smallest item."""
    shared = max(1, math.ceil(threshold * smallest - 1e-9))
    for extra in range(MAX_EXTRA + 1):
        load = 2.0 ** -extra
        if (1 + math.expm1(-load) / load) ** shared <= miss:
            return extra
    return MAX_EXTRA


def signature(hashes: str, bits: Column) -> Column:
    """The least hash of every bin of ``2**bits`` that isn't empty; hashes are sorted."""
    own, shift = F.col(hashes), (F.lit(64) - bits).cast("int")
    return F.filter(own, lambda x, i: (i == 0) | (F.call_function("shiftrightunsigned", x, shift) != F.call_function(
        "shiftrightunsigned", F.get(own, i - 1), shift)))


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", size: int = WORDS,
          threshold: float = THRESHOLD, miss: float = MISS, sent_rows: int = SENT_ROWS) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment of every pair at or over the threshold.

    Rows of ``docs`` equal in id and text give one row (see ``without_leaks`` for filtering).
    """
    found = _matches(_keyed(docs, id_col, text_col), items, item_col, item_text_col, size, threshold, miss,
                     sent_rows)
    return found.select("doc_id", "item_id", "shared", "item_shingles", "containment")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).withColumn(
        "doc_key", F.xxhash64("doc_id", "text"))


def _matches(rows: DataFrame, items: DataFrame, item_col: str, item_text_col: str, size: int,
             threshold: float, miss: float, sent_rows: int) -> DataFrame:
    tests = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_col}`").alias("item_id"),
                         F.col(f"`{item_text_col}`").cast("string").alias("text"))
    tests = saved(tests, "leak-items")
    n_words = F.size(words(F.col("text")))
    short = tests.filter((n_words > 0) & (n_words < size))
    lengths = sorted(r[0] for r in short.select(n_words).distinct().collect())    # fewer than ``size`` numbers
    tests = tests.filter(n_words >= size)
    exact = saved(string_shingles(tests, "text", size, ["item", "item_id"]), "leak-item-shingles")
    sizes = exact.groupBy("item").agg(F.count("*").alias("item_shingles"))
    n_exact, smallest = exact.count(), sizes.agg(F.min("item_shingles")).first()[0]
    extra = extra_bits(smallest or 1, threshold, miss)

    # Partitions by size: the power of two not below the number of shingles.
    sets = hashed_shingles(rows.select("doc_key", "text"), "text", size, "hashes").select("doc_key", "hashes")
    level = F.ceil(F.log2(F.greatest(F.size("hashes"), F.lit(1)).cast("double"))).cast("int")
    sets = sets.withColumn("bits", F.least(level + F.lit(extra), F.lit(63)))
    own = sets.select("doc_key", "bits", F.explode(signature("hashes", F.col("bits"))).alias("least"))

    every = F.explode(F.sequence(F.lit(extra), F.lit(min(63, extra + 31)))).alias("bits")
    tests_sets = hashed_shingles(tests, "text", size, "hashes").select("item", "hashes", every)
    marks = saved(tests_sets.select("item", "bits", F.explode(signature("hashes", F.col("bits"))).alias("least"))
                  .groupBy("least", "item").agg(F.collect_set("bits").alias("partitions")), "leak-signatures")
    n_marks = marks.count()
    pairs = own.join(F.broadcast(marks) if n_marks <= sent_rows else marks, "least").filter(
        F.array_contains("partitions", F.col("bits")))
    pairs = saved(pairs.select("doc_key", "item").distinct(), "leak-candidates")

    texts = rows.join(pairs.select("doc_key").distinct(), "doc_key", "left_semi").dropDuplicates(["doc_key"])
    held = string_shingles(texts, "text", size, ["doc_key", "doc_id"])
    tested = exact.select("item", "item_id", "shingle")
    shared = held.join(F.broadcast(tested) if n_exact <= sent_rows else tested, "shingle").join(
        pairs, ["doc_key", "item"], "left_semi")
    counted = shared.groupBy("doc_key", "doc_id", "item", "item_id").agg(F.count("*").alias("shared"))
    found = counted.join(F.broadcast(sizes) if n_exact <= sent_rows else sizes, "item").withColumn(
        "containment", F.col("shared") / F.col("item_shingles")).filter(F.col("containment") >= F.lit(threshold))
    for n in lengths:
        found = found.unionByName(_held_short(rows, short.filter(n_words == n), n, sent_rows))
    return found


def _held_short(rows: DataFrame, items: DataFrame, n: int, sent_rows: int) -> DataFrame:
    """The pairs of documents and items of ``n`` words that stand in them."""
    marks = saved(hashed_shingles(items, "text", n, "hashes").select(
        "item", "item_id", F.col("text").alias("item_text"), F.col("hashes")[0].alias("window")), "leak-short-items")
    lookup = marks.select("window").distinct()
    few = marks.count() <= sent_rows
    windows = hashed_shingles(rows, "text", n, "hashes").select(
        "doc_key", F.explode(F.array_distinct("hashes")).alias("window"))
    pairs = saved(windows.join(F.broadcast(lookup) if few else lookup, "window").distinct(), "leak-short-candidates")
    texts = rows.join(pairs.select("doc_key").distinct(), "doc_key", "left_semi").dropDuplicates(["doc_key"])
    held = pairs.join(F.broadcast(marks) if few else marks, "window").join(texts, "doc_key")

    def sequence(text: str) -> Column:
        return F.concat(F.lit(" "), F.array_join(words(F.col(text)), " "), F.lit(" "))

    one = F.lit(1).cast("long")
    return held.filter(F.contains(sequence("text"), sequence("item_text"))).select(
        "item", "doc_key", "doc_id", "item_id", one.alias("shared"), one.alias("item_shingles"),
        F.lit(1.0).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = WORDS,
                  threshold: float = THRESHOLD, miss: float = MISS, sent_rows: int = SENT_ROWS) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    found = _matches(_keyed(docs, id_col, text_col), items, item_col, item_text_col, size, threshold, miss,
                     sent_rows)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = saved(found.select("doc_key").distinct(), "leak-documents").withColumnRenamed("doc_key", "leak_doc_key")
    return docs.join(keys, F.xxhash64(F.col(f"`{id_col}`"), text) == keys["leak_doc_key"], "left_anti")
