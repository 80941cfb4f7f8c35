import numpy as np
import pytest

from equiclass.operators.neighbors import nearest_neighbors
from equiclass.operators.pruned import _searched, pruned_neighbors


def clustered(spark, n, seed=1, clusters=12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, 6)) * 20
    rows = [(int(i), "a" if i % 5 else "b", (centers[i % clusters] + rng.normal(size=6)).tolist()) for i in range(n)]
    rows += [(n, "a", [0.0] * 6), (n + 1, "a", [0.0] * 6), (n + 2, "c", [1.0] * 6), (n + 3, "a", rows[1][2])]
    return spark.createDataFrame(rows, "id long, label string, vec array<double>")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_equals_the_search_of_all_tiles(spark, metric):
    df = clustered(spark, 500)
    want = nearest_neighbors(df, df, "label", "id", "vec", 4, metric)
    got = pruned_neighbors(df, df, "label", "id", "vec", 4, metric, tile=50, pivots=8)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_few_blocks_are_visited(spark):
    """Clustered vectors are sent to far fewer sub-blocks than there are."""
    df = clustered(spark, 1200).filter("label = 'a'")
    rows = df.count()
    _, sent = _searched(df, df, "label", "id", "vec", 3, "euclidean", 40, 16)
    tiles = -(-rows // 40)
    assert sum(one.count() for one, _ in sent) < 0.35 * rows * tiles
    assert sum(two.count() for _, two in sent) < 0.35 * rows * tiles


def test_small_and_empty_tables(spark):
    df = clustered(spark, 30)
    want = nearest_neighbors(df, df, "label", "id", "vec", 3, "euclidean")
    got = pruned_neighbors(df, df, "label", "id", "vec", 3, "euclidean")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    none = df.filter("false")
    assert pruned_neighbors(none, none, "label", "id", "vec", 3).collect() == []


def test_null_vectors_and_labels_are_left_out(spark):
    df = clustered(spark, 200)
    odd = df.unionByName(spark.createDataFrame([(900, "a", None), (901, None, [1.0] * 6)], df.schema))
    got = pruned_neighbors(odd, odd, "label", "id", "vec", 2, "cosine", tile=30, pivots=4)
    want = pruned_neighbors(df, df, "label", "id", "vec", 2, "cosine", tile=30, pivots=4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rows_are_sent_to_few_bins(spark):
    """Small tiles of vectors without clusters: a row goes to each bin once, not to each sub-block."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(rng.normal(size=(1500, 24)).tolist())],
                               "id long, label string, vec array<double>")
    got, sent = _searched(df, df, "label", "id", "vec", 3, "cosine", 10, 64)
    assert sum(one.count() for one, _ in sent) <= 12 * 1500
    assert sum(two.count() for _, two in sent) <= 4 * 1500
    want = nearest_neighbors(df, df, "label", "id", "vec", 3, "cosine")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_seeds_in_the_plane_visit_their_surroundings(spark):
    """Points of two values: fewer than two bins a seed, however many cells and bins there are."""
    rng = np.random.default_rng(6)
    rows = [(i, "a", [float(x), float(i % 25)]) for i, x in enumerate(rng.uniform(-999, 9999, 3000).round(2))]
    rows += [(3000, "a", [float("nan"), 1.0]), (3001, "a", [5.0, float("inf")]), (3002, "a", [5.0, None])]
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    got, sent = _searched(df, df, "label", "id", "vec", 5, "euclidean", 50, 512, True)
    assert sent[1][0].count() < 2 * 3000
    want = nearest_neighbors(df, df, "label", "id", "vec", 5, "euclidean", with_vectors=True)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
