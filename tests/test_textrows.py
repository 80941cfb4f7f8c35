import pytest
from pyspark.sql import functions as F

from equiclass.functions.vectors import sparse_interpolate
from equiclass.sources.textrows import csv_line, parse_csv, stored_lines


def test_stored_lines_keep_positions_and_drop_blank_ones(spark):
    df = spark.createDataFrame([(1, "a\n\n  \r\nb c\rd\n", 0), (2, None, 0), (None, "x", 0), (4, "", 0), (5, "\n", 0)],
                               "id long, text string, value int")
    got = stored_lines(df, "text", ["id"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, "a"), (1, 4, "b c"), (1, 5, "d"), (None, 1, "x")], key=str)


def test_csv_round_trip_with_quotes_and_nulls(spark):
    rows = [(1, 'say "hi", twice', 1.5), (2, None, None), (3, "a;b", -2.0)]
    df = spark.createDataFrame(rows, "id long, name string, x double")
    lines = df.select(csv_line("id", "name", "x").alias("value"))
    back, cls = parse_csv(lines, "id bigint, name string, x double")
    assert cls == "x" and sorted(map(tuple, back.collect())) == rows
    strings, cls = parse_csv(lines, 3)
    assert cls == "_c2" and strings.columns == ["_c0", "_c1", "_c2"]
    assert dict(strings.dtypes) == {"_c0": "string", "_c1": "string", "_c2": "string"}


def test_headers_of_several_files_go(spark):
    df = spark.createDataFrame([("f", 0, "a,b"), ("f", 1, "1,x"), ("g", 0, "a,b"), ("g", 1, "2,y"), ("g", 2, "a,b"),
                                ("g", 3, None)], "file string, at int, value string")
    got, cls = parse_csv(df, "a string, b string", header=True, position_col="at", keep=["file"])
    assert cls == "b" and sorted(map(tuple, got.collect())) == [("f", "1", "x"), ("g", "2", "y"), ("g", "a", "b")]


def test_lines_that_do_not_fit(spark):
    df = spark.createDataFrame([("1,2",), ("x,2",), ("3",)], "value string")
    got, _ = parse_csv(df, "a int, b int", corrupt_col="bad")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, 2, None), (None, 2, "x,2"), (3, None, "3")], key=str)
    with pytest.raises(Exception, match="(?i)malformed"):
        parse_csv(df, "a int, b int")[0].collect()


def test_clashing_names_and_missing_position(spark):
    df = spark.createDataFrame([("1", 1)], "value string, a int")
    with pytest.raises(ValueError):
        parse_csv(df, "a int", keep=["a"])
    with pytest.raises(ValueError):
        parse_csv(df, "b int", header=True)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert stored_lines(df, "text", ["id"]).collect() == []
    got, _ = parse_csv(df, "a int, b string", line_col="text", keep=["id"])
    assert got.collect() == [] and got.columns == ["id", "a", "b"]


def test_sparse_interpolation_equals_the_dense_one(spark):
    import random

    rng, rows = random.Random(1), []
    for i in range(40):
        one, two = ({k: rng.uniform(-5, 5) for k in sorted(rng.sample(range(20), rng.randrange(8)))} for _ in range(2))
        rows.append((i, list(one), list(one.values()), list(two), list(two.values())))
    rows.append((99, None, None, [1], [2.0]))
    df = spark.createDataFrame(rows, "id int, xi array<int>, xv array<double>, yi array<int>, yv array<double>")
    got = df.select("id", sparse_interpolate(("xi", "xv"), ("yi", "yv"), lambda i: (i + 1) / F.lit(32.0)).alias("e"))
    for r, row in zip(rows, got.orderBy("id").collect(), strict=True):
        if r[1] is None:
            assert row["e"] is None
            continue
        one, two = dict(zip(r[1], r[2], strict=True)), dict(zip(r[3], r[4], strict=True))
        want = [(i, one.get(i, 0.0) + (i + 1) / 32.0 * (two.get(i, 0.0) - one.get(i, 0.0))) for i in sorted({*one, *two})]
        assert [(e["i"], e["v"]) for e in row["e"]] == want
