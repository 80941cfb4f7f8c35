import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from equiclass.llm import neardup
from equiclass.llm.graph import components
from equiclass.llm.neardup import (Signer, block_links, least_matches, near_duplicates, one_of_each_component,
                                   shape, surviving, without_near_duplicates, words_of)
from equiclass.llm.queries import op10_bayes_neardup
from tests.llm.helpers import ROWS, documents, empty, prose


def _set(text, size):
    words = words_of(text)
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def _brute(rows, size, percent):
    """doc_id -> (n_shingles, component) by comparing all that share a shingle."""
    sets = [(i, _set(t, size)) for i, t in rows]
    up, owners = list(range(len(rows))), defaultdict(list)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (_, s) in enumerate(sets):
        shared = Counter(j for x in s for j in owners[x])
        for j, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[j][1]) - c):
                up[find(k)] = find(j)
        for x in s:
            owners[x].append(k)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    out = []
    for ks in groups.values():
        ids = [rows[k][0] for k in ks if rows[k][0] is not None]
        out += [(rows[k][0], len(sets[k][1]), min(ids, default=None)) for k in ks]
    return sorted(out, key=str)


def _family(n, base_words, seed, edits, first):
    """Copies of one text, each with its own few changed words."""
    rng = random.Random(seed)
    base = prose(base_words, seed).split()
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice(edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((first + i, " ".join(words), "en", "hot", 1))
    return rows


def _check(spark, rows, size, threshold):
    got = near_duplicates(documents(spark, rows), size=size, threshold=threshold).collect()
    want = _brute([r[:2] for r in rows], size, round(100 * threshold))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return got


@pytest.mark.parametrize("size,threshold,block", [(3, 0.85, 1000), (5, 0.8, 7), (1, 1.0, 3)])
def test_matches_brute_force(spark, monkeypatch, size, threshold, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SPREAD", 5)
    rows = [*ROWS, *_family(120, 80, 3, (0, 1, 2, 3, 4, 6, 9), 100), *_family(60, 200, 4, (1, 5, 9, 14), 300),
            *[(400 + i, prose(40, 9) + f" tail {i} " + prose(60, 500 + i), "en", "hot", 1) for i in range(40)]]
    got = _check(spark, rows, size, threshold)
    clean = without_near_duplicates(documents(spark, rows), size=size, threshold=threshold)
    assert clean.columns == documents(spark, rows).columns
    assert clean.count() == sum(bool(r["kept"]) for r in got)


def test_empty_tables_and_no_links(spark):
    assert near_duplicates(empty(spark)).count() == 0 and without_near_duplicates(empty(spark)).count() == 0
    _check(spark, [(1, None, "", "", 1), (2, "", "", "", 1), (None, " ", "", "", 1)], 5, 0.8)
    with pytest.raises(ValueError):
        near_duplicates(empty(spark), threshold=0.805)


def test_shape_meets_the_miss_probability():
    for t in (0.5, 0.8, 0.85, 0.95):
        bands, rows = shape(t)
        assert bands * rows <= neardup.MAX_VALUES and (1 - t ** rows) ** bands <= neardup.MISS
    with pytest.raises(ValueError):
        shape(0.05)


def test_pairs_at_the_threshold_are_not_pruned():
    rng = np.random.default_rng(0)
    limits = least_matches(252, 0.85)
    one = rng.integers(0, 256, (20_000, 252), dtype=np.uint8)
    for similarity, lo, hi in ((0.85, 0.999, 1.0), (0.5, 0.0, 0.001)):
        two = np.where(rng.random(one.shape) < similarity, one, rng.integers(0, 256, one.shape, dtype=np.uint8))
        left, equal = surviving(one, two, limits)
        assert lo <= len(left) / len(one) <= hi
        assert (equal == (one[left] == two[left]).sum(axis=1)).all()


def test_block_links_are_exact():
    signer = Signer(3, *shape(0.85))
    rows = _family(60, 90, 5, (0, 2, 5, 9), 0)
    members = [(i, i, h := signer.shingles(t), signer.values(h).astype(np.uint8)) for i, t, *_ in rows]
    got = set(block_links(members, members, least_matches(len(members[0][3]), 0.85), 85))
    want = set()
    for i, _, s, _ in members:
        for j, _, t, _ in members:
            both = len(np.intersect1d(s, t))
            if i != j and 100 * both >= 85 * (len(s) + len(t) - both):
                want.add((i, j))
    assert got == want and len(want) > 100


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1100)] + [
        (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a in up and b in up and a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_on_the_whole_table(spark, sf001):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()]
    got = op10_bayes_neardup(spark, sf001).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == _brute(rows, 3, 85)


def test_one_row_of_each_component_stays(spark):
    a, b = prose(60, 31), prose(60, 32)
    rows = [(1, a, "en", "a", 1)] * 3 + [(1, a + " more", "en", "a", 1), (2, a, "en", "a", 1)]   # repeated rows and ids
    rows += [(None, b, "en", "a", 1)] * 4 + [(None, b + " more", "en", "a", 1)]                   # copies without any id
    rows += [(7, prose(60, 33), "en", "a", 1), (8, "", "en", "a", 1), (8, "", "en", "a", 1), (9, None, "en", "a", 1)]
    got = near_duplicates(documents(spark, rows)).collect()
    assert Counter(r["component_id"] for r in got if r["first"] and r["n_shingles"]) == {1: 1, None: 1, 7: 1}
    clean = one_of_each_component(documents(spark, rows))
    assert clean.columns == documents(spark, rows).columns
    ids = sorted((r["doc_id"] for r in clean.collect()), key=str)
    assert ids == sorted([1, None, 7, 8, 8, 9], key=str)
    assert one_of_each_component(empty(spark)).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_few_marks_find_their_rows_without_a_shuffle_of_texts(spark, monkeypatch, few):
    rows = [(i, prose(40, i % 20) + (" again" if i >= 20 else ""), "en", "a", 1) for i in range(30)]
    if not few:
        monkeypatch.setattr(neardup, "SENT_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")    # as if the marks were beyond it
    try:
        for found in (one_of_each_component(documents(spark, rows)), without_near_duplicates(documents(spark, rows))):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert ("Exchange hashpartitioning" in plan) != few
            assert sorted(r["doc_id"] for r in found.collect()) == list(range(20))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
