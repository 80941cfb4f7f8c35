"""Alignment of two tokenizers' tokens over the same text, by galloping intersection of their ends.

Both tokenizers cut the same bytes, one space and the text. Where tokens of both end, the
tokens fall into groups; within a group the tokens whose byte ranges overlap are linked.

1. Text is cut into units: before a space or a line end that follows a character that is no
   white space. No token of either vocabulary crosses such a cut (the second's vocabulary is
   looked through when it is loaded), so a cut is an end of both, and a text's tokens are
   those of its units. Units repeat; a task remembers up to ``MEMORY`` bytes of them.
2. A unit's two lists of ends are intersected: for each end of the shorter list the position
   in the longer one is found by doubling steps from the last position, then by bisection.
   Common ends slice the groups.
3. Ranks give the overlaps: where a group has one token on a side, all tokens of the other
   are linked to it; else a token's range of partners lies between the ranks of its start
   and its end among the other's ends.
4. Every document keeps its distinct pairs of ids with their occurrences. A pair's count is
   the number of documents that hold it. The most frequent pairs (``SENT_PAIRS`` at most) are
   sent to the tasks, which add them up where the documents are; all others, which none is in
   very many documents, are joined by a shuffle.

Null and empty texts, and texts whose tokens' bytes joined aren't the text's (by the second
tokenizer's own normalisation), have no tokens: zeros and an empty digest. Special tokens'
strings inside texts are plain text. Very long texts are aligned ``SLICE`` units at a time; a
task holds one text's units and its distinct pairs. Repeated rows and ids are separate documents. An
empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of units that a task remembers, as estimated by ``UNIT_BYTES`` and their contents.
MEMORY = 256 << 20
UNIT_BYTES = 350
#: Texts whose new units are learnt together.
TEXTS = 128
#: Units of one text that are aligned at once.
SLICE = 200_000
#: Pairs (17 bytes each) whose counts are sent to the tasks.
SENT_PAIRS = 250_000
#: Steps of the logarithmic histogram of counts, by which the most frequent pairs are told.
STEPS = 32
#: Marks the last token of a group.
LAST = 1 << 31
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Marks the key of a unit of a space and then a line end: a lone surrogate, which no text holds.
SPACE = "\ud800"


def gallop(short: list[int], long: list[int]) -> list[tuple[int, int]]:
    """(index in ``short``, index in ``long``) of the common values of two ascending lists."""
    found, at, n = [], 0, len(long)
    for i, x in enumerate(short):
        step, low = 1, at
        while at < n and long[at] < x:      # doubling steps
            low, at, step = at + 1, at + step, 2 * step
        high = min(at, n)
        while low < high:                   # bisection between the last two
            middle = (low + high) // 2
            low, high = (middle + 1, high) if long[middle] < x else (low, middle)
        at = low
        if at == n:
            break
        if long[at] == x:
            found.append((i, at))
            at += 1
    return found


def units_of(text: str) -> list[str]:
    """Keys of the units: a unit that begins with a line end as it is, others without their space."""
    rest = text.replace("\n", " \n").split(" ")
    if "" not in rest and "\n" not in rest[1:] and not any(p[-1].isspace() for p in rest):
        return rest
    first, *others = CUT.split(text)
    bare = [first, *(u if u[0] == "\n" else u[1:] for u in others)]
    return [SPACE + k if k[:1] == "\n" and (not i or others[i - 1][0] == " ") else k for i, k in enumerate(bare)]


class Vocabulary:
    """Bytes of the tokens of a byte-level BPE file and of a sentencepiece model."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_file)
        # The byte-level alphabet: printable Latin-1 characters stand for their own byte,
        # the other bytes follow from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [x for x in range(256) if x not in own]
        octet = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(other)}
        tokens = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(octet[c] for c in tokens[i]) if i in tokens and all(c in octet for c in tokens[i])
                        else b"" for i in range(max(tokens) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(rb"\S[ \n]|\n.", x, re.S) for i, x in enumerate(self.b_bytes) if not self.b.is_byte(i)):
            raise ValueError("a piece crosses the end of a unit")
        self.space = self.b.piece_to_id("▁")
        self.a_len = np.array([*map(len, self.a_bytes)], dtype=np.int64)
        self.b_len = np.array([*map(len, self.b_bytes)], dtype=np.int64)
        # Every id's decimal digits behind each mark: first of a unit, within a side, A to B, next group.
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.digits = np.array([mark + str(i) for mark in ("", ",", "|", ";") for i in range(most)], dtype=object)
        self.widths = np.array([*map(len, self.digits)], dtype=np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()


class Aligner:
    """Aligned units, remembered; a unit is (ids of A, ids of B, groups as text).

    The ids' highest bit marks the last token of a group. None: the bytes aren't the text's.
    """

    def __init__(self, vocabulary: Vocabulary, memory: int = MEMORY):
        self.v, self.memory, self.held = vocabulary, memory, 0
        self.known: dict[str, tuple[bytes, bytes, bytes] | None] = {}
        self.before: dict[str, tuple[bytes, bytes, bytes] | None] = {}

    def learn(self, keys: Iterable[str]) -> None:
        """Align the units that aren't known: encoded, and their ends intersected, all in one."""
        new = []
        for key in keys:
            if key in self.before:
                self._keep(key, self.before.pop(key))
            else:
                new.append(key)
        if not new:
            return
        bare = [key.lstrip(SPACE) for key in new]
        whole = [key if key[:1] == "\n" else " " + k for key, k in zip(new, bare, strict=True)]
        a = [x.ids for x in self.v.a.encode_batch_fast(whole, add_special_tokens=False)]
        # The model puts a space before every text but the empty one; before a line end it is a
        # piece of its own.
        b = [x[1:] if key[:1] == "\n" else x or [self.v.space]
             for key, x in zip(new, self.v.b.encode(bare, num_threads=1), strict=True)]
        literal = [*map(str.encode, whole)]
        if not self._same(literal, a, b):
            good = [self._same([x], [y], [z]) for x, y, z in zip(literal, a, b, strict=True)]
            for key, ok in zip(new, good, strict=True):
                if not ok:
                    self._keep(key, None)
            new, a, b = ([x for x, ok in zip(side, good, strict=True) if ok] for side in (new, a, b))
            if not new:
                return
        for key, unit in zip(new, self._aligned(a, b), strict=True):
            self._keep(key, unit)

    def _same(self, literal: list[bytes], a: list[list[int]], b: list[list[int]]) -> bool:
        whole = b"".join(literal)
        return (all(a) and all(b) and whole == b"".join([self.v.a_bytes[i] for x in a for i in x])
                and whole == b"".join([self.v.b_bytes[i] for x in b for i in x]))

    def _aligned(self, a: list[list[int]], b: list[list[int]]) -> Iterator[tuple[bytes, bytes, bytes]]:
        """Units from their ids. Every unit's end is common, so one intersection serves all."""
        sides, ends, starts = [], [], []
        for ids, lengths in ((a, self.v.a_len), (b, self.v.b_len)):
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int64)
            sides.append(flat)
            ends.append(np.cumsum(lengths[flat]))
            starts.append(np.r_[0, np.cumsum([*map(len, ids)])])
        short, long = (0, 1) if len(ends[0]) <= len(ends[1]) else (1, 0)
        common = np.array(gallop(ends[short].tolist(), ends[long].tolist()), dtype=np.int64)
        last, first, group = [None, None], [None, None], [None, None]
        for side, column in ((short, 0), (long, 1)):
            n = len(sides[side])
            last[side] = np.zeros(n, dtype=np.int64)
            last[side][common[:, column]] = 1
            first[side] = np.r_[1, last[side][:-1]]
            group[side] = np.cumsum(last[side]) - last[side]
        # The groups' text: A's ids of a group, then B's; a mark before each.
        most, n = len(self.v.digits) // 4, len(common)
        sizes = [np.bincount(g, minlength=n) for g in group]
        at = [np.arange(len(group[0])) + (np.cumsum(sizes[1]) - sizes[1])[group[0]],
              np.arange(len(group[1])) + np.cumsum(sizes[0])[group[1]]]
        marked = np.zeros(len(group[0]) + len(group[1]), dtype=np.int64)
        marks = np.where(first[0] == 1, 3, 1)
        marks[starts[0][:-1]] = 0
        marked[at[0]] = sides[0] + most * marks
        marked[at[1]] = sides[1] + most * np.where(first[1] == 1, 2, 1)
        text = "".join(self.v.digits[marked].tolist()).encode()
        cuts = np.r_[0, np.cumsum(self.v.widths[marked])][(starts[0] + starts[1])].tolist()
        x, y = ((sides[k] | (last[k] << 31)).astype(np.uint32).tobytes() for k in (0, 1))
        p, q = ((4 * s).tolist() for s in starts)
        for i in range(len(a)):
            yield x[p[i]:p[i + 1]], y[q[i]:q[i + 1]], text[cuts[i]:cuts[i + 1]]

    def _keep(self, key: str, unit: tuple[bytes, bytes, bytes] | None) -> None:
        self.known[key] = unit
        self.held += UNIT_BYTES + len(key) + sum(map(len, unit or ()))

    def forget(self) -> None:
        if 2 * self.held > self.memory:  # the older half goes
            self.before, self.known, self.held = self.known, {}, 0

    def units(self, keys: list[str]) -> list[tuple[bytes, bytes, bytes]] | None:
        """The units of the keys; None if one can't be aligned."""
        try:
            found = [*map(self.known.__getitem__, keys)]
        except KeyError:
            self.learn({k for k in keys if k not in self.known})
            found = [*map(self.known.__getitem__, keys)]
        return None if None in found else found

    def links(self, units: list[tuple[bytes, bytes, bytes]]) -> tuple[int, int, int, np.ndarray]:
        """Tokens of both, groups, and every link as A's id * 2^32 + B's id."""
        a, b = (np.frombuffer(b"".join([u[k] for u in units]), dtype=np.uint32) for k in (0, 1))
        (a, a_last), (b, b_last) = ((x & np.uint32(LAST - 1), x >> np.uint32(31)) for x in (a, b))
        a, b = a.astype(np.int64), b.astype(np.int64)
        # Number of the group of each token, and B tokens before each group.
        a_group = np.cumsum(a_last, dtype=np.int64) - a_last
        b_group = np.cumsum(b_last, dtype=np.int64) - b_last
        n = int(a_last.sum())
        a_size, b_size = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        low = (np.cumsum(b_size) - b_size)[a_group]
        high = low + b_size[a_group]
        mixed = np.flatnonzero(((a_size > 1) & (b_size > 1))[a_group])
        if len(mixed):
            a_end, b_end = np.cumsum(self.v.a_len[a]), np.cumsum(self.v.b_len[b])
            low[mixed] = np.searchsorted(b_end, (a_end - self.v.a_len[a])[mixed], "right")
            high[mixed] = np.searchsorted(b_end, a_end[mixed], "left") + 1
        width = high - low
        at = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(width.sum())
        return len(a), len(b), n, (np.repeat(a, width) << 32) | b[at]

    def documents(self, texts: list[str | None]) -> list[tuple]:
        """Each text's result; the units that they share are learnt once."""
        self.forget()
        keys = [units_of(text) if text else [] for text in texts]
        self.learn({k for own in keys for k in own if k not in self.known})
        return [*map(self.document, keys)]

    def document(self, keys: list[str]) -> tuple:
        """n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs, their occurrences of a text's units."""
        none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))
        if not keys:
            return none
        digest, sums, pairs, times = hashlib.sha256(), [0, 0, 0, 0], [], []
        for at in range(0, len(keys), SLICE):
            if at:
                self.forget()
            units = self.units(keys[at:at + SLICE])
            if units is None:
                return none
            digest.update((b";" if pairs else b"") + b";".join([u[2] for u in units]))
            *n, links = self.links(units)
            sums = [x + y for x, y in zip(sums, (*n, len(links)), strict=True)]
            one, many = np.unique(links, return_counts=True)
            pairs.append(one)
            times.append(many)
        if len(pairs) > 1:
            one, own = np.unique(np.concatenate(pairs), return_inverse=True)
            pairs, times = [one], [np.bincount(own, weights=np.concatenate(times)).astype(np.int64)]
        return *sums, digest.hexdigest(), pairs[0], times[0].astype(np.int32)


ALIGNED = ("doc_id bigint, node bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint,"
           " groups_sha256 string, pairs array<bigint>, times array<int>")


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([*map(len, arrays)])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), kind))


def _aligned(byte_file: str, piece_file: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, node = Aligner(Vocabulary(byte_file, piece_file)), TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                rows = aligner.documents(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(range(node, node + len(rows)), pa.int64()),
                     *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)),
                     pa.array([r[4] for r in rows], pa.string()),
                     _lists([r[5] for r in rows], pa.int64()), _lists([r[6] for r in rows], pa.int32())],
                    names=["doc_id", "node", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
                           "pairs", "times"])
                node += len(rows)

    return align


def aligned(docs: DataFrame, byte_file: str, piece_file: str, *, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Every document's alignment: sizes, digest of its groups, distinct pairs of ids and their occurrences."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        _aligned(byte_file, piece_file), ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it), best (no pair of the same A id has more)."""
    counts = saved(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")),
                   "alignment-counts")
    own = F.shiftright("pair", 32)
    # One row per id of A: the vocabulary bounds it.
    most = counts.groupBy(own.alias("a")).agg(F.max("n").alias("most"))
    return saved(counts.join(F.broadcast(most), own == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")), "alignment-best")


def _floor(counts: DataFrame, most: int) -> int:
    """The least n such that ``most`` pairs at most have that many or more (from a histogram of log n)."""
    steps = F.floor(F.log2("n") * STEPS).cast("int")
    rows = counts.groupBy(steps.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect()
    held, floor = 0, (1 << 63) - 1
    for row in sorted(rows, key=lambda r: -r["step"]):
        held += row["k"]
        if held > most:
            break
        floor = row["n"]
    return floor


def _summed(sent):
    """Adds up the sent pairs of every document; the others stay to be joined."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = sent.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            offsets = np.asarray(pairs.offsets).astype(np.int64)
            own = np.asarray(pairs.values)[offsets[0]:offsets[-1]]
            often = np.asarray(times.values)[np.asarray(times.offsets)[0]:np.asarray(times.offsets)[-1]].astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at = np.searchsorted(keys, own)
            hit = np.zeros(len(own), dtype=bool)
            if len(keys):
                at = np.minimum(at, len(keys) - 1)
                hit = keys[at] == own
            sums = [np.zeros(batch.num_rows, dtype=np.int64) for _ in range(2)]
            if hit.any():
                np.add.at(sums[0], row[hit], often[hit] * best[at[hit]])
                np.add.at(sums[1], row[hit], often[hit] * counts[at[hit]])
            left = np.r_[0, np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in KEPT]
                + [pa.array(s) for s in sums]
                + [pa.ListArray.from_arrays(pa.array(left), pa.array(own[~hit])),
                   pa.ListArray.from_arrays(pa.array(left), pa.array(often[~hit]))],
                names=[*KEPT, "n_best", "count_sum", "pairs", "times"])

    return add


KEPT = ["doc_id", "node", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
SUMMED = ("doc_id bigint, node bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint,"
          " groups_sha256 string, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>")


def alignment(docs: DataFrame, byte_file: str, piece_file: str, *, id_col: str = "doc_id", text_col: str = "text",
              sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark = docs.sparkSession
    rows = saved(aligned(docs, byte_file, piece_file, id_col=id_col, text_col=text_col), "alignment-rows")
    counts = pair_counts(rows)
    floor = _floor(counts, sent_pairs)
    table = counts.filter(F.col("n") >= floor).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    near = saved(rows.mapInArrow(_summed(sent), SUMMED), "alignment-summed")
    sent.destroy()
    left = near.select("node", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "node", F.col("x.pairs").alias("pair"), F.col("x.times").alias("often"))
    late = left.join(counts.filter(F.col("n") < floor), "pair").groupBy("node").agg(
        F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("late_best"),
        F.sum(F.col("often") * F.col("n")).alias("late_sum"))
    return near.join(late, "node", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("late_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("late_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
