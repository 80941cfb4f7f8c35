"""The scale properties of the plans, checked on the physical plans themselves."""

import re

import pytest
from pyspark.sql import functions as F

from equiclass import config
from equiclass.operators.sample import sample_with_replacement
from equiclass.plans.catalog import QUERIES
from tests.test_oversample import _frame


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, sf001):
    return {name: _plan(q(spark, sf001)) for name, q in QUERIES.items()}


def test_no_pairs_or_cross_joins(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_no_python_row_udfs(plans):
    for name, plan in plans.items():
        assert "BatchEvalPython" not in plan, name          # row-at-a-time Python UDF
        if name.startswith(("knn", "smote", "resampling_report")):
            assert "FlatMapCoGroupsInPandas" in plan, name     # the kNN tiles
        else:
            assert "FlatMapCoGroupsInPandas" not in plan and "ArrowEvalPython" not in plan, name


def test_windows_are_partitioned(plans):
    # every window over data rows is partitioned (no whole-table window)
    for name, plan in plans.items():
        for spec in re.findall(r"windowspecdefinition\(([^)]*)\)", plan):
            assert not spec.lstrip().startswith(("specifiedwindowframe", "_ec_b ASC", "_ec_h ASC")), (name, spec)


def test_offset_stages_read_only_class_and_ids(spark, sf001, monkeypatch):
    from equiclass.plans.catalog import table
    monkeypatch.setattr(config, "RANK_BUCKET_ROWS", 16)     # force counted buckets
    plan = _plan(sample_with_replacement(table(spark, sf001, "documents"), "lang", ["doc_id"], 20))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    cols = [sorted(re.sub(r"#\d+L?", "", s).split(",")) for s in scans]
    assert ["doc_id", "lang"] in cols          # bucket offsets: two columns only
    assert "IsNotNull(lang)" in plan


def test_oversample_moves_no_bulk_rows(plans):
    # the cut of each class is found beforehand; the rows themselves are read once and not moved
    for name in ("oversample_users", "oversample_lineitem", "sample_exact_lineitem", "undersample_spread_lang"):
        if name in plans:
            assert plans[name].count("FileScan") == 1, name
            assert not re.search(r"(?<!Broadcast)Exchange hash", plans[name]), name


def test_draws_are_counted_before_they_meet_the_rows(spark):
    df = _frame(spark, {"a": 30, "b": 7})
    plan = _plan(sample_with_replacement(df, "cls", ["id"], 50))
    assert "partial_count" in plan                         # draws per (class, rank), with map-side sums


def test_draws_of_a_small_class_are_spread(spark, monkeypatch):
    from equiclass.operators.resample import resample_uniform
    monkeypatch.setattr(config, "ROWS_PER_TASK", 20_000)
    monkeypatch.setattr(config, "COPY_CHUNK", 1_000)
    df = _frame(spark, {"a": 100, "b": 150_000})
    out = resample_uniform(df, "cls", ["id"], bias=1.0, size_percent=100)
    per = (out.filter("cls = 'a'").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect())
    assert sum(r["count"] for r in per) == 75_050
    assert len(per) >= 4 and max(r["count"] for r in per) < 40_000
