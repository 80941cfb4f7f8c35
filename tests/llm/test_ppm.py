import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from equiclass.llm.ppm import CodeTable, code_lengths, ppm_scores, window_codes, words_of
from equiclass.llm.queries import op2_ppm_scores
from tests.llm.helpers import ROWS, documents, empty


def _held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


class Trie:
    """The same model, symbol by symbol, from plain dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts = order, defaultdict(Counter)
        for t in texts:
            for context, symbol in self.steps(t):
                for k in range(order + 1):
                    self.counts[context[order - k:]][symbol] += 1

    def steps(self, words):
        body = b"\t" * self.order + b" ".join(words) + b"\n"
        for i in range(self.order, len(body)):
            yield body[i - self.order:i], body[i]

    def cost(self, context, symbol):
        total, cut = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = self.counts.get(context[self.order - k:])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in cut}
            n = sum(left.values())
            if symbol in left:
                return total + math.log10((2 * left[symbol] - 1) / (2 * n))
            if n:
                total += math.log10(len(left) / (2 * n))
            cut = set(seen)
        return total - math.log10(256 - len(self.counts.get(b"", ())))

    def score(self, words):
        return sum(self.cost(c, s) for c, s in self.steps(words))


def _check(got, rows, order):
    tokens = [(i, words_of(t)) for i, t in rows]
    train = Counter(w for i, words in tokens if not _held(i) for w in [*words, b"\n"])
    n, v = sum(train.values()), len(train)
    trie = Trie([words for i, words in tokens if not _held(i)], order)
    want = []
    for i, words in tokens:
        own = [*words, b"\n"]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want.append((i, _held(i), len(own), sum(w in train for w in own), n, base, trie.score(words)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@pytest.mark.parametrize("order,hot", [(2, 10**6), (4, 10**6), (5, 20), (3, 0)])
def test_scores_match_a_plain_trie(spark, order, hot):
    rows = [r for r in ROWS if len(r[1] or "") < 5000]
    got = ppm_scores(documents(spark, rows), order=order, hot_words=hot, hot_windows=hot).select(COLUMNS).collect()
    _check(got, [r[:2] for r in rows], order)


def test_query_on_the_whole_table(spark, sf001):
    rows = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()
    got = op2_ppm_scores(spark, sf001).select(COLUMNS).collect()
    _check(got, [tuple(r) for r in rows], 5)


def test_long_text_empty_table_and_no_training_rows(spark):
    got = {r["doc_id"]: r for r in ppm_scores(documents(spark)).collect() if r["doc_id"]}
    assert got[5]["n_tokens"] == len(ROWS[4][1].split()) + 1 and got[2]["n_tokens"] == got[3]["n_tokens"] == 1
    assert ppm_scores(empty(spark)).count() == 0
    held = next(i for i in range(1000) if _held(i))
    r = ppm_scores(documents(spark, [(held, "ab", "en", "a", 2)])).first()
    assert r["held_out"] and r["train_tokens"] == 0 and math.isclose(r["score"], -3 * math.log10(256))


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    texts = [[bytes(rng.integers(97, 101, rng.integers(1, 5)).tolist()) for _ in range(30)] for _ in range(5)]
    codes, _ = window_codes(texts, 3)
    seen, n = np.unique(codes, return_counts=True)
    pairs = np.zeros((256, 256), dtype=np.int64)
    for c, k in zip(seen.tolist(), n.tolist(), strict=True):
        pairs[c >> 8 & 255, c & 255] += k
    for context in (seen[3] >> np.uint64(8), seen[-1] >> np.uint64(8), (seen[5] >> np.uint64(8)) | np.uint64(0xFF0000)):
        part = (context & np.uint64(0xFFFF)) << np.uint64(8)
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        own = seen[(seen & np.uint64(0xFFFF00)) == part]
        use = np.union1d(own, every)
        counts = np.array([int(n[seen == c][0]) if (seen == c).any() else 0 for c in use])
        cost = code_lengths(use, counts, 3, pairs)
        assert math.isclose((10 ** cost[np.isin(use, every)]).sum(), 1.0, rel_tol=1e-9)


def test_code_table():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 48, 5000, dtype=np.uint64))
    table = CodeTable(codes, np.arange(len(codes), dtype=float))
    assert (table.look_up(codes) == np.arange(len(codes))).all()
    assert np.isnan(table.look_up(codes ^ np.uint64(1 << 60))).all()
    assert np.isnan(CodeTable(codes[:0], np.zeros(0)).look_up(codes)).all()
