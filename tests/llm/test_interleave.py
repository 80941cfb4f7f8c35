import zlib
from collections import Counter, defaultdict

import pytest

from equiclass.llm.interleave import interleave
from equiclass.llm.queries import op6_interleave
from tests.llm.helpers import ROWS, documents, empty


def _check(rows, n, shards):
    assert len(rows) == n
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values(), default=0) - min([sizes[s] for s in range(shards)]) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(r["position"] for r in rows) == list(range(n))
    # any beginning of the order holds every source in proportion, but for rounding
    whole, so_far, spread = Counter(r["source"] for r in rows), Counter(), 0.0
    for i, r in enumerate(sorted(rows, key=lambda r: r["position"]), 1):
        so_far[r["source"]] += 1
        for s, k in whole.items():
            spread = max(spread, abs(so_far[s] - k * i / n))
    # each source's own order is even; where the shards are cut depends on the others' rounding
    assert spread <= 1 + len(whole) ** 0.5
    for s, k in whole.items():
        for shard in range(shards):
            assert abs(sum(r["source"] == s and r["shard"] == shard for r in rows) - k / shards) <= 1 + spread


@pytest.mark.parametrize("shards,bucket", [(1, 8192), (4, 2), (16, 3), (40, 1)])
def test_awkward_rows(spark, shards, bucket):
    rows = interleave(documents(spark), shards, bucket_rows=bucket).collect()
    _check(rows, len(ROWS), shards)
    text = {r[0]: (r[1] or "").encode() for r in ROWS}
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])


def test_one_hot_source_and_many_small_ones(spark):
    rows = [(i, f"t{i}", "en", "hot" if i < 300 else f"s{i % 90}", 1) for i in range(600)]
    a = interleave(documents(spark, rows), 7, seed=5, bucket_rows=16, keep=("text", "lang")).collect()
    _check([r for r in a], 600, 7)
    assert all(r["text"] == f"t{r['doc_id']}" for r in a)
    b = interleave(documents(spark, rows).repartition(5), 7, seed=5, bucket_rows=1000).collect()
    place = lambda rows: {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    assert place(a) == place(b)               # whatever the buckets and the partitions
    assert place(a) != place(interleave(documents(spark, rows), 7, seed=6).collect())


def test_empty_table(spark):
    assert interleave(empty(spark), 16).count() == 0
    with pytest.raises(ValueError):
        interleave(empty(spark), 0)


def test_query_on_the_whole_table(spark, sf001):
    rows = op6_interleave(spark, sf001).collect()
    n = spark.read.parquet(f"{sf001}/documents.parquet").count()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == n and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 16
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
