"""Property tests: bucketed ranking equals the plain whole-class window for any layout."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from equiclass.functions.keys import hash_hex
from equiclass.operators.classes import N, class_table
from equiclass.operators.oversample import oversample
from equiclass.operators.ranking import RANK, TAKE, flag_first, rank_rows

sizes_st = st.lists(st.integers(min_value=1, max_value=60), min_size=1, max_size=5)


def _frame(spark, sizes):
    rows = [(i, f"k{c}") for c, n in enumerate(sizes) for i in range(sum(sizes[:c]), sum(sizes[:c]) + n)]
    return spark.createDataFrame(rows, "id long, cls string")


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(sizes=sizes_st, frac=st.floats(min_value=0.0, max_value=1.0),
       bucket_rows=st.sampled_from([1, 2, 5, 1000]), seed=st.integers(0, 10_000))
def test_flag_first_property(spark, sizes, frac, bucket_rows, seed):
    df = _frame(spark, sizes)
    t = class_table(df, "cls")
    x = t.attach(df, t.frame.select("cls", N, F.floor(F.col(N) * frac).cast("long").alias("q")))
    got = {r["id"]: r[TAKE] for r in flag_first(x, t, ["id"], "q", N, seed, keep_rest=True,
                                                 bucket_rows=bucket_rows).collect()}
    w = Window.partitionBy("cls").orderBy(hash_hex(seed, ["id"]), "id")
    want = {r["id"]: r["f"] for r in x.select("id", (F.row_number().over(w) <= F.col("q")).alias("f")).collect()}
    assert got == want


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(sizes=sizes_st, bucket_rows=st.sampled_from([1, 3, 1000]), seed=st.integers(0, 10_000))
def test_rank_rows_property(spark, sizes, bucket_rows, seed):
    df = _frame(spark, sizes)
    t = class_table(df, "cls")
    got = {r["id"]: r[RANK] for r in rank_rows(t.attach(df), t, ["id"], seed, N, bucket_rows).collect()}
    w = Window.partitionBy("cls").orderBy(hash_hex(seed, ["id"]), "id")
    want = {r["id"]: r["rk"] for r in df.select("id", F.row_number().over(w).alias("rk")).collect()}
    assert got == want


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(sizes=sizes_st)
def test_oversample_property(spark, sizes):
    out = oversample(_frame(spark, sizes), "cls", ["id"])
    counts = dict(out.groupBy("cls").count().collect())
    assert set(counts.values()) == {max(sizes)} and len(counts) == len(sizes)
