"""Class columns of other types go through the class tables, joins and hashed draws."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from equiclass.operators.oversample import oversample
from equiclass.operators.profile import class_profile
from equiclass.operators.resample import resample_uniform
from equiclass.operators.sample import sample_exact, sample_with_replacement
from equiclass.operators.undersample import undersample_spread

VALUES = {
    "boolean": [True, False],
    "date": [dt.date(2020, 1, 1), dt.date(2021, 6, 30)],
    "timestamp": [dt.datetime(2020, 1, 1, 12, 0), dt.datetime(2021, 6, 30, 8, 30)],
    "double": [0.5, 2.25],
    "decimal(10,2)": [Decimal("1.50"), Decimal("7.25")],
    "bigint": [10**12, -3],
}


@pytest.mark.parametrize("type_name", sorted(VALUES))
def test_class_types(spark, type_name):
    a, b = VALUES[type_name]
    rows = [(i, a if i < 9 else b) for i in range(12)]
    df = spark.createDataFrame(rows, f"id long, cls {type_name}")
    counts = lambda d: sorted(r[1] for r in d.groupBy("cls").count().collect())
    assert counts(oversample(df, "cls", ["id"])) == [9, 9]
    assert counts(sample_exact(df, "cls", ["id"], 2)) == [2, 2]
    assert counts(undersample_spread(df, "cls", ["id"])) == [3, 3]
    assert counts(sample_with_replacement(df, "cls", ["id"], 5)) == [5, 5]
    assert counts(resample_uniform(df, "cls", ["id"], bias=1.0, size_percent=100.0)) == [6, 6]
    prof = {r["cls"]: r["n"] for r in class_profile(df, "cls").collect()}
    assert prof == {a: 9, b: 3}
    assert dict(oversample(df, "cls", ["id"]).dtypes)["cls"] == dict(df.dtypes)["cls"]
