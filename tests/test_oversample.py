from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from equiclass.operators.oversample import oversample


def _frame(spark, sizes, nulls=0):
    rows, i = [], 0
    for cls, n in sizes.items():
        for _ in range(n):
            rows.append((i, cls, f"x{i}"))
            i += 1
    for _ in range(nulls):
        rows.append((i, None, f"x{i}"))
        i += 1
    schema = StructType([StructField("id", IntegerType()), StructField("cls", StringType()),
                         StructField("payload", StringType())])
    return spark.createDataFrame(rows, schema)


def test_every_class_reaches_majority(spark):
    df = _frame(spark, {"a": 500, "b": 268, "c": 7, "d": 1})
    out = oversample(df, "cls", ["id"], seed=1)
    counts = dict(out.groupBy("cls").count().collect())
    assert counts == {"a": 500, "b": 500, "c": 500, "d": 500}
    per_row = Counter(r["id"] for r in out.select("id").collect())
    sizes = {"a": 500, "b": 268, "c": 7, "d": 1}
    cls_of = {r["id"]: r["cls"] for r in df.collect()}
    for rid, k in per_row.items():
        n = sizes[cls_of[rid]]
        assert k in (500 // n, 500 // n + 1)
    # the majority is unchanged
    assert all(per_row[r] == 1 for r, c in cls_of.items() if c == "a")


def test_two_class_counts(spark):
    out = oversample(_frame(spark, {"0": 500, "1": 268}), "cls", ["id"])
    assert out.count() == 1000


def test_many_classes_not_lost(spark):
    # 25, 26 and 50 classes: no class disappears or is doubled
    for k in (25, 26, 50):
        sizes = {f"c{i:02d}": 3 + (i % 5) for i in range(k)}
        out = oversample(_frame(spark, sizes), "cls", ["id"])
        counts = dict(out.groupBy("cls").count().collect())
        assert counts == {c: 7 for c in sizes}


def test_nulls_policy(spark):
    df = _frame(spark, {"a": 5, "b": 2}, nulls=9)
    dropped = oversample(df, "cls", ["id"], nulls="drop")
    assert dict(dropped.groupBy("cls").count().collect()) == {"a": 5, "b": 5}
    kept = oversample(df, "cls", ["id"], nulls="keep")
    assert dict(kept.groupBy("cls").count().collect()) == {"a": 9, "b": 9, None: 9}


def test_empty_and_single_class(spark):
    df = _frame(spark, {"a": 4})
    assert oversample(df.limit(0), "cls", ["id"]).count() == 0
    assert sorted(r["id"] for r in oversample(df, "cls", ["id"]).collect()) == [0, 1, 2, 3]


def test_schema_order_and_metadata_kept(spark):
    df = _frame(spark, {"a": 3, "b": 1})
    df = df.withColumn("payload", F.col("payload").alias("payload", metadata={"machine_learning": "FEATURE"}))
    out = oversample(df, "cls", ["id"])
    assert out.columns == df.columns
    assert out.schema["payload"].metadata == {"machine_learning": "FEATURE"}


def test_deterministic_under_repartition(spark):
    df = _frame(spark, {"a": 40, "b": 13, "c": 6})
    a = oversample(df, "cls", ["id"], seed=5)
    b = oversample(df.repartition(7).orderBy(F.rand(3)), "cls", ["id"], seed=5)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_spread_copies_match_plain(spark, monkeypatch):
    from equiclass import config
    df = _frame(spark, {"a": 1000, "b": 3, "c": 300})
    plain = oversample(df, "cls", ["id"], seed=2).cache()
    plain.count()
    monkeypatch.setattr(config, "ROWS_PER_TASK", 50)   # force the spread path
    chunked = oversample(df, "cls", ["id"], seed=2, chunk=16)
    assert "RoundRobinPartitioning" in chunked._jdf.queryExecution().executedPlan().toString()
    assert plain.exceptAll(chunked).count() == 0 and chunked.exceptAll(plain).count() == 0


def test_spread_draws_match_plain(spark, monkeypatch):
    from equiclass import config
    from equiclass.operators.sample import sample_with_replacement
    df = _frame(spark, {"a": 30, "b": 3})
    plain = sample_with_replacement(df, "cls", ["id"], 500, seed=4).cache()
    plain.count()
    monkeypatch.setattr(config, "ROWS_PER_TASK", 40)
    spread = sample_with_replacement(df, "cls", ["id"], 500, seed=4)
    assert plain.exceptAll(spread).count() == 0 and spread.exceptAll(plain).count() == 0


def test_tie_for_max(spark):
    out = oversample(_frame(spark, {"a": 6, "b": 6, "c": 2}), "cls", ["id"])
    assert dict(out.groupBy("cls").count().collect()) == {"a": 6, "b": 6, "c": 6}


@pytest.mark.parametrize("name", ["oversample_lang"])
def test_documents_flagship(spark, sf001, name):
    import __spark_entry__ as se
    out = se.entry(spark)
    counts = dict(out.groupBy("lang").count().collect())
    assert set(counts.values()) == {max(counts.values())}
    assert out.count() == 4 * max(counts.values())


def test_default_ids_are_all_orderable_columns(spark):
    df = _frame(spark, {"a": 9, "b": 4})
    by_all = oversample(df, "cls", seed=8)
    explicit = oversample(df, "cls", ["id", "cls", "payload"], seed=8)
    assert by_all.exceptAll(explicit).count() == 0 and explicit.exceptAll(by_all).count() == 0
    assert dict(by_all.groupBy("cls").count().collect()) == {"a": 9, "b": 9}


def test_one_wide_read_and_no_wide_shuffle(spark, sf001):
    from equiclass.plans.catalog import QUERIES
    plan = QUERIES["oversample_lang"](spark, sf001)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan.replace("BroadcastExchange", "")


def test_equal_rows_at_the_cut(spark):
    # no ids and equal rows: the cut falls among rows that nothing tells apart
    df = spark.createDataFrame([("a", 1)] * 30 + [("b", 2)] * 23 + [("b", 3)] * 2, "cls string, v int")
    out = oversample(df, "cls", seed=1)
    assert dict(out.groupBy("cls").count().collect()) == {"a": 30, "b": 30}
