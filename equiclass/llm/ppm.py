"""Prediction by partial matching: code length of every document under a byte trie.

Text model. A text's A-Z become a-z; its words are runs of bytes other than ASCII white
space. The model sees the words joined by one space and one end symbol. Symbols are
bytes; the context of a symbol is the ``order`` bytes before it (a start symbol stands
before the text), or any shorter end of them.

Training counts every (context, symbol) window of the training texts, for every order.
Scoring walks from the longest context that training has seen down to the symbol:
escape estimation by method D (a symbol seen c times among n in a context with q distinct
symbols has (2c-1)/2n, the escape q/2n), and symbol exclusion: after an escape the
symbols of the longer context are left out of the shorter context's counts. Contexts are
suffixes of one another, so what is excluded depends on the longer context alone and the
whole trie becomes a table: window -> log10 probability. ``score`` is the sum of a
text's windows.

Scale. Counting sends each task's distinct words and windows to one aggregation. The trie
is cut by the last two context bytes; each part (at most 256**(order-1) windows, however
large the corpus) is turned into code lengths by itself, given the order-1 counts (at
most 256 * 256). Code lengths and word counts of the most frequent entries, at most
``HOT_WINDOWS`` and ``HOT_WORDS``, go to every task; all others are looked up by a join
on the (document, entry) pairs, so nothing is left out however large the vocabulary.

Nulls and empty texts are one end symbol. A null id counts as the empty text where the
folds are dealt. Repeated rows are scored one by one. An empty table gives an empty
result. Only the id and the text are read.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 5
#: Entries at most that are sent to every task.
HOT_WORDS = 300_000
HOT_WINDOWS = 1_000_000
#: A task hands on its counts when it holds so many words, or so many bytes of windows.
FLUSH_WORDS = 1_000_000
SLICE_BYTES = 1_000_000
START, END = 9, 10  # neither is part of a word, and the model's texts hold no other white space
END_WORD = b"\n"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def window_codes(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows (context bytes, then the symbol) of all texts in a row, and where each text's begin."""
    pad = bytes([START]) * order
    bodies = [b" ".join(t) + END_WORD for t in texts]
    octets = np.frombuffer(b"".join(pad + b for b in bodies), dtype=np.uint8)
    codes = np.zeros(len(octets) - order, dtype=np.uint64)
    for j in range(order + 1):
        codes <<= np.uint64(8)
        codes |= octets[j:len(octets) - order + j]
    starts = np.cumsum([0, *map(len, bodies)])[:-1]
    return codes[octets[order:] != START], starts


def _slices(rows: Iterator[tuple], most: int = SLICE_BYTES) -> Iterator[list[tuple]]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += sum(map(len, row[-1])) + len(row[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by code of (codes, counts of two columns)."""
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(codes, kind="stable")
    codes, counts = codes[by], counts[by]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(counts, first)


COUNT_SCHEMA = "word binary, code bigint, n_train bigint, n_all bigint"
COUNT_ARROW = pa.schema([("word", pa.binary()), ("code", pa.int64()), ("n_train", pa.int64()),
                         ("n_all", pa.int64())])


def _counter(order: int):
    """Rows (held_out, text) -> the task's counts: words of training texts, windows of all."""

    def word_rows(words: Counter) -> pa.RecordBatch:
        n = pa.array(words.values(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(words.keys(), pa.binary()), pa.nulls(len(words), pa.int64()), n, n], schema=COUNT_ARROW)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = Counter(), []
        rows = ((held, words_of(text.as_py())) for b in batches
                for held, text in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for part in _slices(rows):
            for held, text in part:
                if not held:
                    words.update(text)
                    words[END_WORD] += 1
            if len(words) > FLUSH_WORDS:
                yield word_rows(words)
                words = Counter()
            for train in (True, False):
                if texts := [text for held, text in part if held != train]:
                    codes, n = np.unique(window_codes(texts, order)[0], return_counts=True)
                    windows.append((codes, np.stack([n * train, n], axis=1)))
            windows = [_merged(windows)]
            if len(windows[0][0]) > 4 * FLUSH_WORDS:
                yield from window_rows(windows.pop())
        if words:
            yield word_rows(words)
        if windows:
            yield from window_rows(windows[0])

    def window_rows(merged: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        codes, n = merged
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(codes), pa.binary()), pa.array(codes.astype(np.int64)),
             pa.array(np.ascontiguousarray(n[:, 0])), pa.array(np.ascontiguousarray(n[:, 1]))],
            schema=COUNT_ARROW)

    return count


def _by_context(grams: np.ndarray, counts: np.ndarray):
    """Of sorted (context, symbol) grams: the contexts, their first gram, symbols and total."""
    contexts = grams >> np.uint64(8)
    first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]])
    return contexts[first], first, np.diff(np.r_[first, len(grams)]), np.add.reduceat(counts, first)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``keys`` in ``sorted_keys``, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def code_lengths(codes: np.ndarray, counts: np.ndarray, order: int, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each window's symbol after its context.

    codes: distinct windows that share their last two context bytes, all those of the
    corpus; counts: how often each is in the training texts (0: held out only); pairs:
    training counts [last context byte, symbol] of the whole corpus.
    """
    by = np.argsort(codes)
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    codes, counts = codes[by], counts[by]
    last = int(codes[0] >> np.uint64(8)) & 255
    symbols = (codes & np.uint64(255)).astype(np.int64)
    singles = pairs.sum(axis=0)

    # By order: is the context known, the symbol's count, the context's total and symbols,
    # and the total of the context's symbols in the next shorter context.
    levels = []
    shorter = None
    for k in range(2, order + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        grams, which = np.unique(codes & mask, return_inverse=True)
        n = np.bincount(which, weights=counts).astype(np.int64)
        grams, n = grams[n > 0], n[n > 0]
        own_symbols = (grams & np.uint64(255)).astype(np.int64)
        if k == 2:
            below = pairs[last][own_symbols]
        else:
            below = shorter[1][_find(shorter[0], grams & (mask >> np.uint64(8)))[0]] if len(grams) else n
        shorter = grams, n
        if not len(grams):
            zero = np.zeros(len(codes), dtype=np.int64)
            levels.append((zero.astype(bool), zero, zero, zero, zero))
            continue
        contexts, first, q, total = _by_context(grams, n)
        masked = np.add.reduceat(below, first)
        at, known = _find(contexts, (codes & mask) >> np.uint64(8))
        gram_at, seen = _find(grams, codes & mask)
        levels.append((known, np.where(seen, n[gram_at], 0), total[at], q[at], masked[at]))
    own = pairs[last]
    whole = np.full(len(codes), 1)
    levels.insert(0, (whole * own.sum() > 0, own[symbols], whole * own.sum(), whole * (own > 0).sum(),
                      whole * singles[own > 0].sum()))
    levels.insert(0, (whole * singles.sum() > 0, singles[symbols], whole * singles.sum(),
                      whole * (singles > 0).sum(), whole * 0))

    result = np.zeros(len(codes))
    todo = np.ones(len(codes), dtype=bool)
    cut_n = cut_q = np.zeros(len(codes), dtype=np.int64)  # what the longer context excludes
    for known, c, n, q, masked in reversed(levels):
        left, symbols_left = n - cut_n, q - cut_q
        here = todo & known & (left > 0)
        hit = here & (c > 0)
        result[hit] += np.log10((2 * c[hit] - 1) / (2 * left[hit]))
        todo &= ~hit
        escape = here & ~hit
        result[escape] += np.log10(symbols_left[escape] / (2 * left[escape]))
        cut_n, cut_q = np.where(known, masked, cut_n), np.where(known, q, cut_q)
    result[todo] -= np.log10(256 - (singles > 0).sum())
    return result[back]


def _compiler(order: int, pairs):
    def compile_part(part: pa.Table) -> pa.Table:
        codes = part.column("code").to_numpy().astype(np.uint64)
        cost = code_lengths(codes, part.column("n_train").to_numpy(), order, pairs.value)
        return pa.table({"code": part.column("code"), "cost": cost, "n_all": part.column("n_all")})

    return compile_part


def frequent(df: DataFrame, count: str, most: int) -> Column:
    """A condition that holds for the rows of the highest counts, ``most`` rows at most.

    Counts are compared in steps of 2**(1/8); the steps' sizes (a few hundred rows) come
    to the driver.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * 8)
    least, total = None, 0
    for row in sorted(df.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return F.lit(False) if least is None else step >= F.lit(least)


class CodeTable:
    """Values by uint64 code in an open-addressing table, looked up many at a time."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(codes)).bit_length())
        self.keys = np.full(1 << self.bits, ~np.uint64(0))
        self.values = np.zeros(1 << self.bits)
        todo, slots = np.arange(len(codes)), self._slots(codes)
        while len(todo):
            free = self.keys[slots] == ~np.uint64(0)
            self.keys[slots[free]] = codes[todo[free]]
            mine = self.keys[slots] == codes[todo]
            self.values[slots[mine]] = values[todo[mine]]
            todo, slots = todo[~mine], (slots[~mine] + 1) & ((1 << self.bits) - 1)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        mixed = (codes ^ (codes >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, codes: np.ndarray) -> np.ndarray:
        """The values; nan where a code isn't in the table."""
        slots = self._slots(codes)
        keys, out = self.keys[slots], self.values[slots]
        todo = np.flatnonzero(keys != codes)
        out[todo] = np.nan
        todo = todo[keys[todo] != ~np.uint64(0)]
        slots = slots[todo]
        while len(todo):
            slots = (slots + 1) & ((1 << self.bits) - 1)
            keys = self.keys[slots]
            hit = keys == codes[todo]
            out[todo[hit]] = self.values[slots[hit]]
            on = ~hit & (keys != ~np.uint64(0))
            todo, slots = todo[on], slots[on]
        return out


# One row per document (key: its own number), and one per entry that its task doesn't hold.
PART_SCHEMA = ("row bigint, doc_id bigint, held_out boolean, key binary, times bigint, n_tokens bigint,"
               " n_known bigint, base double, score double")
PART_ARROW = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("key", pa.binary()),
    ("times", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()),
    ("score", pa.float64())])


def window_key(code: int) -> bytes:
    """As a binary key that no word is."""
    return END_WORD + int(code).to_bytes(8, "big")


def _scorer(order: int, hot_words, hot_windows):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known_words, table = hot_words.value, CodeTable(*hot_windows.value)
        row = TaskContext.get().partitionId() << 40
        docs = ((i, held, words_of(text.as_py())) for b in batches for i, held, text in
                zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True))
        for part in _slices(docs):
            codes, starts = window_codes([words for _, _, words in part], order)
            costs = table.look_up(codes)
            unknown = np.flatnonzero(np.isnan(costs))
            costs[unknown] = 0.0
            sums = np.add.reduceat(costs, starts)
            out: list[tuple] = []
            for (doc_id, held, words), total in zip(part, sums.tolist(), strict=True):
                words.append(END_WORD)
                found = [*map(known_words.get, words)]
                values = [v for v in found if v is not None]
                row += 1
                out.append((row, doc_id, held, b" " + row.to_bytes(8, "big"), 0, len(words), len(values),
                            math.fsum(values), total))
                if len(values) < len(words):
                    rest = Counter(w for w, v in zip(words, found, strict=True) if v is None)
                    out += [(row, None, None, w, n, 0, 0, 0.0, 0.0) for w, n in rest.items()]
            if len(unknown):
                own = np.searchsorted(starts, unknown, side="right") - 1
                first = row - len(part) + 1
                for (at, code), n in Counter(zip(own.tolist(), codes[unknown].tolist(), strict=True)).items():
                    out.append((first + at, None, None, window_key(code), n, 0, 0, 0.0, 0.0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PART_ARROW, strict=True)],
                schema=PART_ARROW)

    return score


def ppm_scores(docs: DataFrame, train: Column | None = None, *, id_col: str = "doc_id",
               text_col: str = "text", folds: int = 10, order: int = ORDER,
               hot_words: int = HOT_WORDS, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    train: which rows to learn from (default: all whose fold isn't 0). base_score is the
    unigram word model with 0.1 added to each count, score the trie's log10 probability.
    """
    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")
    spark = docs.sparkSession
    held = held_out(f"`{id_col}`", folds) if train is None else ~F.coalesce(train, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held.alias("held_out"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))

    counts = saved(rows.select("held_out", "text").mapInArrow(_counter(order), COUNT_SCHEMA)
                   .groupBy("word", "code").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")),
                   "ppm-counts")
    words = counts.filter(F.col("word").isNotNull()).select("word", "n_train")
    windows = counts.filter(F.col("code").isNotNull()).select("code", "n_train", "n_all")
    n, v = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count("word")).first()
    floor = math.log10(0.1 / (n + 0.1 * (v + 1)))
    words = words.withColumn("value", F.log10((F.col("n_train") + 0.1) / F.lit(n + 0.1 * (v + 1))))

    pairs = np.zeros((256, 256), dtype=np.int64)  # 65,536 counts at most
    pair = F.col("code").bitwiseAND(F.lit(0xFFFF)).alias("pair")
    for r in windows.groupBy(pair).agg(F.sum("n_train").alias("n")).collect():
        pairs[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    part = F.shiftrightunsigned("code", 8).bitwiseAND(F.lit(0xFFFF)).alias("part")
    costs = saved(windows.groupBy(part).applyInArrow(
        _compiler(order, spark.sparkContext.broadcast(pairs)), "code bigint, cost double, n_all bigint"),
        "ppm-costs")

    hot_word, hot_window = frequent(words, "n_train", hot_words), frequent(costs, "n_all", hot_windows)
    sent = words.filter(hot_word).select("word", "value").toArrow()
    kept_words = dict(zip(sent.column(0).to_pylist(), sent.column(1).to_pylist(), strict=True))
    sent = costs.filter(hot_window).select("code", "cost").toArrow()
    kept_windows = sent.column(0).to_numpy().astype(np.uint64), sent.column(1).to_numpy()
    parts = rows.mapInArrow(_scorer(order, spark.sparkContext.broadcast(kept_words),
                                    spark.sparkContext.broadcast(kept_windows)), PART_SCHEMA)

    window_bytes = F.concat(F.lit(END_WORD), F.unhex(F.lpad(F.hex("code"), 16, "0")))
    rest = words.filter(~hot_word).select(F.col("word").alias("key"), "value", F.lit(True).alias("is_word"))
    rest = rest.unionByName(costs.filter(~hot_window).select(
        window_bytes.alias("key"), F.col("cost").alias("value"), F.lit(False).alias("is_word")))
    joined = parts.join(rest, "key", "left")
    times = F.col("times")
    is_window = F.startswith(F.col("key"), F.lit(END_WORD)) & (F.length("key") == 9)
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("is_word"), times).otherwise(0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        F.sum(F.col("base") + F.when(is_window, 0.0).otherwise(
            times * F.coalesce("value", F.lit(floor)))).alias("base_score"),
        F.sum(F.col("score") + F.when(is_window, times * F.col("value")).otherwise(0.0)).alias("score"),
    ).drop("row")
