import random

import numpy as np
import pytest

from equiclass.llm.neardup import WordHashes, shingle_hashes, words_of
from equiclass.llm.partenum import PartEnum, bands, block_links, jaccard_components

from .helpers import documents, empty, prose


def shingles(text, size):
    words = words_of(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def linked(a, b, percent):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= percent * (len(a) + len(b) - both)


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j], percent):
                part[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def check(spark, df, size, percent):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    out = jaccard_components(df, size=size, percent=percent)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, size, percent)


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_sets_at_the_threshold_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    scheme, missed, tried = PartEnum(percent), 0, 0
    for size in [*range(1, 60), 75, 100, 150, 300, 700, 2000]:
        for _ in range(6):
            a = rng.integers(1, 1 << 63, size, dtype=np.uint64)
            for shift in (0, 1):  # equal sizes, or one set within the other
                # As few common elements as the threshold allows.
                if shift:
                    common, rest = -(-size * percent // 100), 0
                else:
                    common = -(-2 * size * percent // (100 + percent))
                    rest = size - common
                b = np.concatenate([a[:common], rng.integers(1, 1 << 63, rest, dtype=np.uint64)])
                one, two = (set(scheme.signatures(np.unique(x)).tolist()) for x in (a, b))
                tried += 1
                missed += not one & two
    assert tried > 700 and missed == 0


def test_bands_cover_all_sizes_and_bound_differences():
    for percent in (70, 80, 85, 100):
        found = bands(percent, 5000)
        assert [b.low for b in found[1:]] == [b.high + 1 for b in found[:-1]] and found[0].low == 1
        for b in found:
            k = 2 * b.high * (100 - percent) // (100 + percent)
            assert b.n1 - k // (b.k2 + 1) > b.spare >= 0


def test_sets_without_much_in_common_rarely_share_a_signature():
    rng, scheme = np.random.default_rng(1), PartEnum(85)
    common = rng.integers(1, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(1, 1 << 63, 240, dtype=np.uint64)])) for _ in range(60)]
    keys = [set(scheme.signatures(s).tolist()) for s in sets]
    assert sum(bool(keys[i] & keys[j]) for i in range(60) for j in range(i)) < 0.2 * 60 * 59 / 2


def test_block_links():
    known = WordHashes()
    texts = [prose(40, 1), prose(40, 1) + " end", prose(40, 2), prose(40, 2) + " end"]
    sets = [shingle_hashes(words_of(t), 3, known) for t in texts]
    rows = [(i, i, s) for i, s in enumerate(sets)]
    assert sorted(block_links(rows, rows, 85)) == [(0, 1), (1, 0), (2, 3), (3, 2)]


def test_odd_rows(spark):
    check(spark, documents(spark), 4, 85)
    check(spark, documents(spark), 5, 80)


def test_chains_near_the_threshold(spark):
    """Texts of which neighbours link and others don't, in random order, and unlinked ones beside them."""
    rng, rows = random.Random(4), []
    for family in range(4):
        words = prose(60 + 40 * family, family).split()
        for step in range(12):
            rows.append((len(rows) * 7 % 97 + 100 * family, " ".join(words)))
            for _ in range(1 + step % 3):
                words[rng.randrange(len(words))] = f"w{len(rows)}x{rng.random()}"
    rows += [(1000 + i, " ".join(prose(60, 0).split()[:30 + i])) for i in range(20)]
    rng.shuffle(rows)
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85)


def test_small_blocks(spark, monkeypatch):
    import equiclass.llm.partenum as module

    monkeypatch.setattr(module, "BLOCK", 500)
    test_chains_near_the_threshold(spark)


def test_whole_table(spark, sf001):
    check(spark, spark.read.parquet(f"{sf001}/documents.parquet"), 4, 85)


def test_copies_of_one_text(spark):
    rows = [(i, "one two three four five six") for i in range(300)] + [(400, None), (401, " ")]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85)


def test_empty_table(spark):
    assert jaccard_components(empty(spark)).count() == 0


def test_percent_is_checked(spark):
    with pytest.raises(ValueError):
        jaccard_components(empty(spark), percent=60)
