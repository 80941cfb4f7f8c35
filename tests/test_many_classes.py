"""The path for class tables too large to broadcast gives the same rows as the local path."""

import pytest

from equiclass import config
from equiclass.operators.oversample import oversample
from equiclass.operators.resample import resample_uniform
from equiclass.operators.sample import sample_exact
from equiclass.operators.smote import smote, smote_percent
from equiclass.operators.undersample import undersample_spread
from tests.test_oversample import _frame
from tests.test_smote_knn import _vectors


@pytest.fixture
def tiny_limits(monkeypatch):
    def apply():
        monkeypatch.setattr(config, "MAX_LOCAL_CLASSES", 2)
        monkeypatch.setattr(config, "MAX_BROADCAST_ROWS", 10)
        monkeypatch.setattr(config, "RANK_BUCKET_ROWS", 4)
    return apply


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("op", ["oversample", "sample_exact", "spread", "resample"])
def test_checkpointed_class_table_path(spark, tiny_limits, op):
    df = _frame(spark, {"a": 40, "b": 13, "c": 6, "d": 1, "e": 9})
    run = {
        "oversample": lambda: oversample(df, "cls", ["id"], seed=3),
        "sample_exact": lambda: sample_exact(df, "cls", ["id"], 5, seed=3),
        "spread": lambda: undersample_spread(df, "cls", ["id"], 2.0, seed=3),
        "resample": lambda: resample_uniform(df, "cls", ["id"], bias=0.7, seed=3),
    }[op]
    local = run().cache()
    local.count()
    tiny_limits()
    assert _same(local, run())


def test_smote_many_classes_path(spark, tiny_limits):
    df, _ = _vectors(spark, {"a": 30, "b": 12, "c": 7, "d": 1})
    local = smote(df, "label", "features", "id", ratio_to_max=1.0, seed=5).cache()
    local.count()
    tiny_limits()
    assert _same(local, smote(df, "label", "features", "id", ratio_to_max=1.0, seed=5))


def test_smote_percent_many_classes_path(spark, tiny_limits):
    df, _ = _vectors(spark, {"a": 30, "b": 12, "c": 7})
    local = smote_percent(df, "label", "features", "id", percent=200, k=3, seed=5).cache()
    local.count()
    tiny_limits()
    assert _same(local, smote_percent(df, "label", "features", "id", percent=200, k=3, seed=5))


def test_byte_bound_sends_wide_classes_to_the_shuffled_path(spark, monkeypatch):
    from equiclass.operators.classes import class_table
    df = _frame(spark, {"a" * 50: 4, "b" * 50: 2})
    assert class_table(df, "cls").local
    monkeypatch.setattr(config, "MAX_LOCAL_BYTES", 100)
    t = class_table(df, "cls")
    assert not t.local and t.count == 2 and t.largest == 4


@pytest.mark.parametrize("op", ["oversample", "sample_exact", "resample"])
def test_null_class_kept_on_checkpointed_path(spark, tiny_limits, op):
    df = _frame(spark, {"a": 20, "b": 7, "c": 3}, nulls=5)
    run = {
        "oversample": lambda: oversample(df, "cls", ["id"], seed=4, nulls="keep"),
        "sample_exact": lambda: sample_exact(df, "cls", ["id"], 4, seed=4, nulls="keep"),
        "resample": lambda: resample_uniform(df, "cls", ["id"], bias=0.5, seed=4, nulls="keep"),
    }[op]
    local = run().cache()
    local.count()
    assert local.filter("cls is null").count() > 0
    tiny_limits()
    assert _same(local, run())
