import math

import pytest
from pyspark.sql import functions as F

from equiclass.functions.keys import uniform01
from equiclass.operators.resample import default_size_percent, resample_uniform
from equiclass.operators.sample import sample_bernoulli, sample_exact, sample_with_replacement
from equiclass.operators.undersample import undersample_pair, undersample_spread
from tests.test_oversample import _frame


def test_sample_exact_counts_and_subset(spark):
    df = _frame(spark, {"a": 50, "b": 20, "c": 3})
    out = sample_exact(df, "cls", ["id"], 10, seed=4)
    assert dict(out.groupBy("cls").count().collect()) == {"a": 10, "b": 10, "c": 3}
    assert out.exceptAll(df).count() == 0
    per = sample_exact(df, "cls", ["id"], {"a": 2, "c": 1}, seed=4)
    assert dict(per.groupBy("cls").count().collect()) == {"a": 2, "c": 1}


def test_bernoulli_is_hash_threshold(spark):
    df = _frame(spark, {"a": 300})
    out = sample_bernoulli(df, ["id"], 0.25, seed=9)
    want = df.filter(uniform01(9, ["id"]) < 0.25)
    assert out.exceptAll(want).count() == 0 and want.exceptAll(out).count() == 0
    assert sample_bernoulli(df, ["id"], 3.0).count() == 300  # clamped to 1
    assert sample_bernoulli(df, ["id"], 0.0).count() == 0


def test_with_replacement_sizes(spark):
    df = _frame(spark, {"a": 5, "b": 2})
    out = sample_with_replacement(df, "cls", ["id"], 11, seed=1)
    assert dict(out.groupBy("cls").count().collect()) == {"a": 11, "b": 11}
    assert out.select("id", "cls", "payload").subtract(df).count() == 0


def test_spread_subsample(spark):
    df = _frame(spark, {"a": 50, "b": 20, "c": 8})
    out = undersample_spread(df, "cls", ["id"], 1.0)
    assert dict(out.groupBy("cls").count().collect()) == {"a": 8, "b": 8, "c": 8}
    out2 = undersample_spread(df, "cls", ["id"], 2.5)
    assert dict(out2.groupBy("cls").count().collect()) == {"a": 20, "b": 20, "c": 8}
    assert out2.exceptAll(df).count() == 0
    with pytest.raises(ValueError):
        undersample_spread(df, "cls", ["id"], 0.5)


def test_pair_undersample(spark):
    df = _frame(spark, {"a": 30, "b": 200, "c": 5})
    out = undersample_pair(df, "cls", ["id"], "a", "b", ratio=1.0, seed=42)
    counts = dict(out.groupBy("cls").count().collect())
    assert counts["a"] == 30 and "c" not in counts
    frac = 30 / 200
    b = df.filter(F.col("cls") == "b")
    assert counts["b"] == b.filter(uniform01(42, ["id"]) < frac).count()
    exact = undersample_pair(df, "cls", ["id"], "a", "b", ratio=2.0, exact=True)
    assert dict(exact.groupBy("cls").count().collect()) == {"a": 30, "b": 60}
    # B larger than needed -> fraction clamped at 1: all of b kept
    allb = undersample_pair(df, "cls", ["id"], "b", "a", ratio=1.0)
    assert dict(allb.groupBy("cls").count().collect()) == {"a": 30, "b": 200}
    with pytest.raises(ValueError):
        undersample_pair(df, "cls", ["id"], "a", "a")
    # B absent
    only_a = undersample_pair(df, "cls", ["id"], "a", "zzz")
    assert dict(only_a.groupBy("cls").count().collect()) == {"a": 30}


def test_resample_default_percent_two_classes(spark):
    assert default_size_percent(500, 768, 2) == 130.3
    df = _frame(spark, {"0": 500, "1": 268})
    out = resample_uniform(df, "cls", ["id"], bias=1.0)
    assert dict(out.groupBy("cls").count().collect()) == {"0": 500, "1": 500}
    assert out.select("id", "cls", "payload").subtract(df).count() == 0


def test_resample_formula(spark):
    df = _frame(spark, {"a": 40, "b": 10, "c": 10})
    out = resample_uniform(df, "cls", ["id"], bias=0.5, size_percent=50.0)
    want = {c: math.floor(0.5 * (0.5 * n + 0.5 * 60 / 3)) for c, n in {"a": 40, "b": 10, "c": 10}.items()}
    assert dict(out.groupBy("cls").count().collect()) == want


@pytest.mark.parametrize("bucket_rows", [65_536, 4])
def test_many_draws_same_rows_in_any_layout(spark, monkeypatch, bucket_rows):
    from equiclass import config
    df = _frame(spark, {"a": 40, "b": 9, "c": 2})
    ref = sample_with_replacement(df, "cls", ["id"], 25, seed=3).cache()
    ref.count()
    monkeypatch.setattr(config, "MAX_BROADCAST_ROWS", 10)
    monkeypatch.setattr(config, "RANK_BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(config, "ROWS_PER_TASK", 8)
    got = sample_with_replacement(df, "cls", ["id"], 25, seed=3)
    assert ref.exceptAll(got).count() == 0 and got.exceptAll(ref).count() == 0


def test_bernoulli_without_ids_decides_row_by_row(spark):
    df = spark.createDataFrame([("x", 1)] * 1000 + [(None, 2)], "a string, b int")
    for seed in (1, 2, 3):
        n = sample_bernoulli(df, None, 0.5, seed=seed).filter("a = 'x'").count()
        assert 400 < n < 600
    assert sample_bernoulli(df, None, 1.0).exceptAll(df).count() == 0


def test_uniforms_reach_every_rank(spark):
    from equiclass.functions.keys import uniform01
    u = spark.range(2000).select(uniform01(1, ["id"]).alias("u"))
    assert u.filter("floor(u * 4503599627370496) != u * 4503599627370496").count() == 0
    assert u.filter("floor(u * 4294967296) != u * 4294967296").count() > 1900     # finer than 32 bits
