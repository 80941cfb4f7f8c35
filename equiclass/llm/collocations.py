"""Phrase collocations from weighted acyclic automata of word n-grams.

Every word of a text begins a window: itself and up to three words that follow it in its piece.
The number of occurrences of a phrase is the number of windows that begin with it, so an
automaton of the windows, with the sum of their counts on every state, holds the counts of
all phrases of one to four words.

1. A task turns its texts into shards of up to ``SHARD`` words of one language. A shard's words
   are numbered in byte order, its windows are sorted, equal ones counted: the paths of its
   automaton in order, from which states are built level by level, a state for every new
   prefix. A shard also reports the prefixes that hold a 2000th of its windows or more.
2. Paths are dealt by prefix: all that begin with the same word go to the same part; where a
   word (or two, or three) holds a 2000th of all windows, they are dealt by one word more.
   At most 2000 prefixes of each length can be that frequent; only these are collected.
3. A part is the union of the shards' automata in its range: word numbers are joined, states
   of equal prefixes merged and their weights summed. Every state of weight ``least`` is a phrase and its
   count; states above the words by which a frequent prefix was dealt hold part of their
   count, and are summed over the parts.
4. The parts of candidates are looked up by composition: phrases and the asked-for parts are
   dealt by the hash of language and phrase, each side of a partition becomes an automaton, and
   walking both at once gives the weight of every path that both have.
5. Candidates inside longer ones, scores (in decimals, without rounding) and ranks are joins,
   groups and a window with a limit per language over the phrases, which are few.

Words are ``[^\\x20\\x09]+`` in pieces between ``[.,;:!?\\x0A-\\x0D]``, A-Z lower-cased; a null language
is ``und``; null and empty texts and pieces without words have no windows. Very long texts fill
a shard of their own: 50 bytes a word. Repeated rows count each time. Ties are ranked by phrase, in
byte order. An empty table gives an empty result. Only the language and the text are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONGEST = 4
LEAST, TOP, INSIDE = 30, 2000, 80
#: Words of a shard, and windows of a part: a task holds the automata of all shards in its part at once.
SHARD = 1_000_000
PART = 1_000_000
#: A prefix with this share of the windows (one in ...) is dealt by one word more.
FREQUENT = 2000
#: Phrases of one partition when parts are looked up.
LOOKUP = 200_000
# One byte to one byte: A-Z to a-z, a tab to a space, every character that ends a piece to a full stop.
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(32 if c == 9 else 46 if c in ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Paths:
    """Sorted distinct word sequences of an automaton with their counts; -1 stands behind a shorter one's end."""

    def __init__(self, words: list[bytes], rows: np.ndarray, counts: np.ndarray):
        self.words, self.rows, self.counts = words, rows, counts

    @classmethod
    def of(cls, words: list[bytes], rows: np.ndarray, counts: np.ndarray | None = None) -> Paths:
        """From unsorted rows of numbers of unsorted words."""
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.empty(len(words) + 1, dtype=np.int64)
        rank[order], rank[-1] = np.arange(len(words)), -1
        rows, base = rank[rows], len(words) + 1
        high, low = ((rows[:, i] + 1) * base + rows[:, i + 1] + 1 for i in (0, 2))
        by = np.lexsort((low, high))
        new = np.r_[True, (np.diff(high[by]) != 0) | (np.diff(low[by]) != 0)][:len(by)]
        at = np.flatnonzero(new)
        own = np.ones(len(by), dtype=np.int64) if counts is None else counts[by]
        return cls([words[i] for i in order], rows[by][at].astype(np.int32),
                   np.add.reduceat(own, at) if len(at) else own)

    def hashes(self, language: str) -> list[np.ndarray]:
        """Hash of the first one, two, ... words of every path; the same for all shards."""
        import xxhash

        own = np.array([*map(xxhash.xxh3_64_intdigest, self.words), 1], dtype=np.uint64)
        out, last = [], np.uint64(xxhash.xxh3_64_intdigest(language.encode()))
        for d in range(LONGEST):
            last = mixed((own[self.rows[:, d]] ^ last) + np.uint64(d + 1))
            out.append(last)
        return out

    def pack(self, some: np.ndarray | None = None) -> bytes:
        """Bytes of the chosen paths, and of their words alone; columns by byte planes, compressed."""
        import zstandard

        rows = self.rows if some is None else self.rows[some]
        counts = self.counts if some is None else self.counts[some]
        used = np.zeros(len(self.words) + 1, dtype=bool)
        used[rows] = True
        used[-1] = False
        number = np.where(used, np.cumsum(used) - 1, -1)
        table = b" ".join([self.words[i] for i in np.flatnonzero(used).tolist()])
        planes = [np.ascontiguousarray(number[c].astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
                  for c in rows.T] + [np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()]
        head = np.array([len(rows), len(table)], dtype="<i8").tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + table + b"".join(planes))

    @classmethod
    def unpack(cls, octets: bytes) -> Paths:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(octets)
        n, width = np.frombuffer(raw, "<i8", 2).tolist()
        at = 16 + width
        rows = np.empty((n, LONGEST), dtype=np.int32)
        for d in range(LONGEST):
            rows[:, d] = np.ascontiguousarray(
                np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<i4").reshape(n)
            at += 4 * n
        counts = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").reshape(n)
        return cls(raw[16:16 + width].split(b" ") if width else [], rows, counts)


class Automaton:
    """States by level: the state before, the word that leads here, the weight of all paths through it."""

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @classmethod
    def built(cls, paths: Paths) -> Automaton:
        """From sorted paths: a state for every prefix that the path before doesn't share."""
        levels, n = [], len(paths.rows)
        state, new = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        if n:
            new[0] = True
        for d in range(LONGEST):
            word = paths.rows[:, d].astype(np.int64)
            new = new.copy()
            new[1:] |= np.diff(word) != 0
            here = word >= 0
            at = np.flatnonzero(new & here)
            own = np.cumsum(new & here) - 1
            weight = np.zeros(len(at), dtype=np.int64)
            np.add.at(weight, own[here], paths.counts[here])
            levels.append((state[at], word[at], weight))
            state = own
        return cls(paths.words, levels)

    @classmethod
    def union(cls, parts: list[Automaton]) -> Automaton:
        """States of equal prefixes merged, their weights summed."""
        words = sorted(set().union(*(p.words for p in parts)))
        number = {w: i for i, w in enumerate(words)}
        names = [np.array([number[w] for w in p.words], dtype=np.int64) for p in parts]
        states, levels = [np.zeros(1, dtype=np.int64) for _ in parts], []
        for d in range(LONGEST):
            keys = [s[p.levels[d][0]] * len(words) + name[p.levels[d][1]]
                    for s, p, name in zip(states, parts, names, strict=True)]
            every, own = np.unique(np.concatenate(keys), return_inverse=True)
            weight = np.zeros(len(every), dtype=np.int64)
            np.add.at(weight, own, np.concatenate([p.levels[d][2] for p in parts]))
            levels.append((every // max(1, len(words)), every % max(1, len(words)), weight))
            states = np.split(own, np.cumsum([*map(len, keys)])[:-1])
        return cls(words, levels)

    def phrases(self, d: int, some: np.ndarray) -> list[bytes]:
        """The prefixes of the chosen states of level ``d`` (from 0), space-joined."""
        columns = []
        for k in range(d, -1, -1):
            parent, word, _ = self.levels[k]
            columns.append([self.words[i] for i in word[some].tolist()])
            some = parent[some]
        return [b" ".join(x) for x in zip(*reversed(columns), strict=True)]

    def compose(self, other: Automaton) -> list[np.ndarray]:
        """Per level, for each of the other's states the weight of the same prefix here (0: there is none)."""
        number = {w: i for i, w in enumerate(self.words)}
        name = np.array([number.get(w, -1) for w in other.words], dtype=np.int64)
        out, state, base = [], np.zeros(1, dtype=np.int64), len(self.words)
        for (parent, word, weight), (before, label, _) in zip(self.levels, other.levels, strict=True):
            own, asked = parent * base + word, name[label]
            wanted = np.where((state[before] >= 0) & (asked >= 0), state[before] * base + asked, -1)
            at = np.minimum(np.searchsorted(own, wanted), max(0, len(own) - 1))
            hit = (own[at] == wanted) if len(own) else np.zeros(len(wanted), dtype=bool)
            state = np.where(hit, at, -1)
            out.append(np.where(hit, weight[at], 0) if len(own) else np.zeros(len(wanted), dtype=np.int64))
        return out


class Numbers(dict):
    """Words numbered as they come; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def windows(flat: np.ndarray) -> np.ndarray:
    """Rows of up to four numbers of each word and those behind it, -1 from the piece's end on."""
    rows = np.full((len(flat), LONGEST), -1, dtype=np.int64)
    going = flat > 0
    for d in range(LONGEST):
        after = np.r_[flat[d:], np.zeros(min(d, len(flat)), dtype=np.int64)]
        going = going & (after > 0)
        rows[going, d] = after[going] - 1
    return rows[flat > 0]


SHARDS = "lang string, n bigint, frequent array<struct<depth:int,prefix:bigint,n:bigint>>, paths binary"


def _shards(size: int):
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        total = 0

        def done() -> Iterator[pa.RecordBatch]:
            for lang, (numbers, flats) in held.items():
                rows = windows(np.concatenate(flats))
                if not len(rows):
                    continue
                paths = Paths.of(list(numbers)[1:], rows)
                frequent = []
                for d, keys in enumerate(paths.hashes(lang)[:-1]):
                    at = np.flatnonzero(np.r_[True, np.diff(keys) != 0])
                    n = np.add.reduceat(paths.counts, at)
                    for k in np.flatnonzero(n * FREQUENT >= len(rows)).tolist():
                        frequent.append({"depth": d, "prefix": int(keys[at[k]].view(np.int64)), "n": int(n[k])})
                yield pa.RecordBatch.from_pylist(
                    [{"lang": lang, "n": len(rows), "frequent": frequent, "paths": paths.pack()}], schema=SHARD_ARROW)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                words = text.encode("utf-8", "surrogatepass").translate(TABLE).replace(b".", b" . ").split()
                if lang not in held:
                    held[lang] = (Numbers({b".": 0}), [])
                numbers, flats = held[lang]
                flats.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
                flats.append(np.zeros(1, dtype=np.int64))
                total += len(words)
                if total >= size:
                    yield from done()
                    held, total = {}, 0
        yield from done()

    return shard


SHARD_ARROW = pa.schema([
    ("lang", pa.string()), ("n", pa.int64()),
    ("frequent", pa.list_(pa.struct([("depth", pa.int32()), ("prefix", pa.int64()), ("n", pa.int64())]))),
    ("paths", pa.binary())])


def _dealt(parts: int, frequent: list[np.ndarray]):
    """Shards -> the paths of each part of each."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, octets in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                paths = Paths.unpack(octets.as_py())
                keys = paths.hashes(lang)
                own, on = keys[0].copy(), np.ones(len(keys[0]), dtype=bool)
                for d in range(LONGEST - 1):
                    on &= np.isin(keys[d].view(np.int64), frequent[d])
                    own[on] = keys[d + 1][on]
                part = (mixed(own) % np.uint64(parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(part[by]) != 0])
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=True):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(part[by[a]])], pa.int32()), pa.array([lang], pa.string()),
                         pa.array([paths.pack(by[a:b])], pa.binary())], names=["part", "lang", "paths"])

    return deal


def _counted(least: int, frequent: list[np.ndarray]):
    """The shards' paths of one part -> its phrases, and what it holds of the frequent prefixes."""

    def count(table: pa.Table) -> pa.Table:
        by: dict[str, list[Automaton]] = {}
        for lang, octets in zip(table.column("lang").to_pylist(), table.column("paths"), strict=True):
            by.setdefault(lang, []).append(Automaton.built(Paths.unpack(octets.as_py())))
        out = ([], [], [], [])
        for lang, parts in by.items():
            whole = Automaton.union(parts)
            states = None
            for d, (parent, word, weight) in enumerate(whole.levels):
                keys = _state_hashes(whole, lang, d, states)
                shared = np.isin(keys.view(np.int64), frequent[d]) if d < LONGEST - 1 else np.zeros(len(word), dtype=bool)
                states = keys
                some = np.flatnonzero(shared | (weight >= least))
                out[0].extend([lang] * len(some))
                out[1].extend([d + 1] * len(some))
                out[2].extend(x.decode("utf-8", "surrogatepass") for x in whole.phrases(d, some))
                out[3].extend(weight[some].tolist())
        return pa.table({"lang": pa.array(out[0], pa.string()), "k": pa.array(out[1], pa.int32()),
                         "phrase": pa.array(out[2], pa.string()), "f": pa.array(out[3], pa.int64())})

    return count


def _state_hashes(whole: Automaton, lang: str, d: int, before: np.ndarray | None) -> np.ndarray:
    import xxhash

    own = np.array([*map(xxhash.xxh3_64_intdigest, whole.words)], dtype=np.uint64)
    parent, word, _ = whole.levels[d]
    last = np.uint64(xxhash.xxh3_64_intdigest(lang.encode())) if before is None else before[parent]
    return mixed((own[word] ^ last) + np.uint64(d + 1))


def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                  shard: int = SHARD, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f of every phrase of up to four words with f >= least; lang, n)."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    shards = saved(rows.mapInArrow(_shards(shard), SHARDS), "collocation-shards")
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    often = shards.select(F.explode("frequent").alias("x")).groupBy("x.depth", "x.prefix").agg(
        F.sum("x.n").alias("n")).filter(F.col("n") * FREQUENT >= F.lit(total)).collect()
    frequent = [np.array([r["prefix"] for r in often if r["depth"] == d], dtype=np.int64) for d in range(LONGEST - 1)]
    parts = max(1, -(-total // part))
    dealt = shards.select("lang", "paths").mapInArrow(_dealt(parts, frequent), "part int, lang string, paths binary")
    counted = dealt.groupBy("part").applyInArrow(
        _counted(least, frequent), "lang string, k int, phrase string, f bigint")
    phrases = counted.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= F.lit(least))
    return saved(phrases, "collocation-phrases"), totals


def _composed(key, have: pa.Table, asked: pa.Table) -> pa.Table:
    """The counts of the asked-for phrases of one partition."""
    out = ([], [], [])

    def automata(table: pa.Table, counts: list[int]) -> dict[str, Automaton]:
        by: dict[str, tuple[Numbers, list, list]] = {}
        for lang, phrase, n in zip(table.column("lang").to_pylist(), table.column("phrase").to_pylist(), counts,
                                   strict=True):
            numbers, rows, own = by.setdefault(lang, (Numbers(), [], []))
            row = [numbers[w] for w in phrase.encode("utf-8", "surrogatepass").split(b" ")]
            rows.append(row + [-1] * (LONGEST - len(row)))
            own.append(n)
        return {lang: Automaton.built(Paths.of(list(numbers), np.array(rows, dtype=np.int64), np.array(own, dtype=np.int64)))
                for lang, (numbers, rows, own) in by.items()}

    held = automata(have, have.column("f").to_pylist())
    for lang, wanted in automata(asked, [1] * asked.num_rows).items():
        if lang not in held:
            continue
        for d, weight in enumerate(held[lang].compose(wanted)):
            # All phrases of a partition have the same number of words, so other levels hold prefixes alone.
            some = np.flatnonzero(weight)
            if d + 1 != key[0].as_py() or not len(some):
                continue
            out[0].extend([lang] * len(some))
            out[1].extend(x.decode("utf-8", "surrogatepass") for x in wanted.phrases(d, some))
            out[2].extend(weight[some].tolist())
    return pa.table({"lang": pa.array(out[0], pa.string()), "phrase": pa.array(out[1], pa.string()),
                     "f": pa.array(out[2], pa.int64())})


def looked_up(phrases: DataFrame, asked: DataFrame, partition: int = LOOKUP) -> DataFrame:
    """lang, phrase, f of the distinct ``asked`` (lang, k, phrase), from ``phrases``."""
    parts = max(1, -(-phrases.count() // partition))
    part = F.pmod(F.xxhash64("lang", "phrase"), F.lit(parts)).cast("int")
    return phrases.groupBy("k", part.alias("part")).cogroup(
        asked.select("lang", "k", "phrase").distinct().groupBy("k", part.alias("part"))).applyInArrow(
        _composed, "lang string, phrase string, f bigint")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                 top: int = TOP, inside: int = INSIDE, shard: int = SHARD, part: int = PART) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` candidates."""
    phrases, totals = phrase_counts(docs, text_col=text_col, lang_col=lang_col, least=least, shard=shard, part=part)
    words = F.split("phrase", " ")
    candidates = phrases.filter("k > 1").withColumnRenamed("f", "a")

    def joined(column, start, length):
        return F.array_join(F.slice(column, start, length), " ")

    # Every contiguous phrase of two words or more inside a longer candidate.
    longer = candidates.filter("k > 2").select("lang", "k", "a", words.alias("words")).withColumn(
        "size", F.explode(F.expr("sequence(2, k - 1)"))).withColumn("start", F.explode(F.expr("sequence(1, k - size + 1)")))
    around = longer.select("lang", joined("words", F.col("start"), F.col("size")).alias("phrase"), "a").groupBy(
        "lang", "phrase").agg(F.max("a").alias("most"))
    wide = "decimal(38,0)"
    kept = candidates.join(around, ["lang", "phrase"], "left").filter(
        F.col("most").isNull()
        | (F.col("most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * inside)).drop("most")

    cuts = kept.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).withColumn("words", words).select(
        "lang", "phrase", "a", "k", "cut", joined("words", F.lit(1), F.col("cut")).alias("left"),
        joined("words", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = saved(cuts, "collocation-cuts")
    asked = cuts.select("lang", F.col("cut").alias("k"), F.col("left").alias("phrase")).unionByName(
        cuts.select("lang", (F.col("k") - F.col("cut")).alias("k"), F.col("right").alias("phrase")))
    found = saved(looked_up(phrases, asked), "collocation-parts")
    one = found.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    two = found.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(one, ["lang", "left"]).join(two, ["lang", "right"]).withColumn(
        "score", F.expr(f"cast(cast(a as decimal(20,0)) * 2000000 div cast(l + r as {wide}) as bigint)"))
    best = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= F.lit(top))
    # One row per language.
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> str:
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2),
    lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS ks(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {least}),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
subs AS (SELECT lang, a, array_to_string(ws[s:s + m - 1], ' ') AS phrase
  FROM c, (VALUES (2), (3)) AS ms(m), (VALUES (1), (2), (3)) AS ss(s) WHERE m < k AND s <= k - m + 1),
around AS (SELECT lang, phrase, max(a) AS most FROM subs GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN around USING (lang, phrase)
  WHERE most IS NULL OR 100 * most::HUGEINT < {inside} * a::HUGEINT),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS one, array_to_string(ws[cut + 1:k], ' ') AS two
  FROM kept, (VALUES (1), (2), (3)) AS cs(cut) WHERE cut < k),
scored AS (SELECT cuts.*, x.f AS l, y.f AS r, 2000000 * a::HUGEINT // (x.f + y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = one JOIN f y ON y.lang = cuts.lang AND y.phrase = two),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""
