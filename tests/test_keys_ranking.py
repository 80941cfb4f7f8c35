import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from equiclass.functions.keys import hash_hex, sql_uniform01, uniform01
from equiclass.operators.classes import N, class_table
from equiclass.operators.ranking import RANK, TAKE, flag_first, rank_rows


def test_uniform01_matches_sql(spark):
    df = spark.range(0, 200).select(F.col("id"), (F.col("id") % 7).cast("string").alias("g"))
    got = {r["id"]: r["u"] for r in df.select("id", uniform01(42, ["id", "g"]).alias("u")).collect()}
    con = duckdb.connect()
    sql = (f"SELECT id, {sql_uniform01(42, ['id', 'g'])} AS u "
           f"FROM (SELECT range AS id, CAST(range % 7 AS VARCHAR) AS g FROM range(200))")
    want = dict(con.execute(sql).fetchall())
    assert got == want
    assert all(0.0 <= u < 1.0 for u in got.values())


def _skewed(spark, n=3000):
    # class "hot" holds a third or more of the rows
    return spark.range(0, n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 11).cast("string"))).alias("cls"),
    )


@pytest.mark.parametrize("bucket_rows", [4, 40, 500, 100_000])
def test_rank_rows_equals_plain_window(spark, bucket_rows):
    df = _skewed(spark)
    t = class_table(df, "cls")
    x = t.attach(df)
    got = rank_rows(x, t, ["id"], seed=7, size=N, bucket_rows=bucket_rows).select("id", "cls", RANK)
    w = Window.partitionBy("cls").orderBy(hash_hex(7, ["id"]), "id")
    want = df.select("id", "cls", F.row_number().over(w).cast("long").alias(RANK))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("keep_rest,bucket_rows", [(True, 16), (False, 16), (True, 100_000), (False, 3), (True, 500), (False, 500)])
def test_flag_first_equals_rank_cut(spark, keep_rest, bucket_rows):
    df = _skewed(spark)
    t = class_table(df, "cls")
    q = t.frame.select("cls", N, F.least(F.col(N), F.floor(F.col(N) / 3 + 5)).cast("long").alias("q"))
    x = t.attach(df, q)
    got = flag_first(x, t, ["id"], quota="q", size=N, seed=3, keep_rest=keep_rest,
                     bucket_rows=bucket_rows)
    w = Window.partitionBy("cls").orderBy(hash_hex(3, ["id"]), "id")
    ranked = x.withColumn("rk", F.row_number().over(w)).withColumn("want", F.col("rk") <= F.col("q"))
    if keep_rest:
        a = got.select("id", F.col(TAKE).alias("f"))
        b = ranked.select("id", F.col("want").alias("f"))
    else:
        a = got.select("id")
        b = ranked.filter("want").select("id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_edge_rank_marks_the_quota_th_row(spark):
    df = _skewed(spark)
    t = class_table(df, "cls")
    q = t.frame.select("cls", N, F.least(F.col(N), F.lit(37)).cast("long").alias("q"))
    x = t.attach(df, q)
    got = flag_first(x, t, ["id"], quota="q", size=N, seed=3, keep_rest=False, edge_rank="er",
                     bucket_rows=8)
    last = {r["cls"]: r["id"] for r in got.filter(F.col("er") == F.col("q")).collect()}
    w = Window.partitionBy("cls").orderBy(hash_hex(3, ["id"]), "id")
    ranked = x.withColumn("rk", F.row_number().over(w))
    want = {r["cls"]: r["id"] for r in ranked.filter(F.col("rk") == F.col("q")).collect()}
    assert last == want and len(want) == t.count
