"""Edge cases for every operator: empty input, null classes kept, schema and metadata."""

import pytest
from pyspark.sql import functions as F

from equiclass.operators.oversample import oversample
from equiclass.operators.resample import resample_uniform
from equiclass.operators.sample import sample_exact, sample_with_replacement
from equiclass.operators.smote import smote, smote_percent
from equiclass.operators.undersample import undersample_pair, undersample_spread
from tests.test_oversample import _frame
from tests.test_smote_knn import _vectors

OPS = {
    "oversample": lambda df: oversample(df, "cls", ["id"]),
    "sample_exact": lambda df: sample_exact(df, "cls", ["id"], 2),
    "with_replacement": lambda df: sample_with_replacement(df, "cls", ["id"], 3),
    "spread": lambda df: undersample_spread(df, "cls", ["id"]),
    "resample": lambda df: resample_uniform(df, "cls", ["id"]),
    "pair": lambda df: undersample_pair(df, "cls", ["id"], "a", "b"),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_empty_input_keeps_schema(spark, name):
    df = _frame(spark, {"a": 3, "b": 2}).limit(0)
    out = OPS[name](df)
    assert out.count() == 0 and out.schema == df.schema


@pytest.mark.parametrize("name", sorted(OPS))
def test_metadata_and_order_kept(spark, name):
    df = _frame(spark, {"a": 5, "b": 2})
    df = df.select(F.col("payload").alias("payload", metadata={"custom": ["test1", "test2"]}), "cls", "id")
    out = OPS[name](df)
    assert out.columns == ["payload", "cls", "id"]
    assert out.schema["payload"].metadata == {"custom": ["test1", "test2"]}


@pytest.mark.parametrize("name", ["sample_exact", "with_replacement", "spread", "resample"])
def test_null_class_kept(spark, name):
    df = _frame(spark, {"a": 8, "b": 4}, nulls=6)
    kw = {"nulls": "keep"}
    run = {
        "sample_exact": lambda: sample_exact(df, "cls", ["id"], 3, **kw),
        "with_replacement": lambda: sample_with_replacement(df, "cls", ["id"], 3, **kw),
        "spread": lambda: undersample_spread(df, "cls", ["id"], **kw),
        "resample": lambda: resample_uniform(df, "cls", ["id"], bias=1.0, size_percent=100.0, **kw),
    }[name]
    counts = dict(run().groupBy("cls").count().collect())
    assert None in counts
    dropped = dict({
        "sample_exact": lambda: sample_exact(df, "cls", ["id"], 3),
        "with_replacement": lambda: sample_with_replacement(df, "cls", ["id"], 3),
        "spread": lambda: undersample_spread(df, "cls", ["id"]),
        "resample": lambda: resample_uniform(df, "cls", ["id"]),
    }[name]().groupBy("cls").count().collect())
    assert None not in dropped


def test_smote_empty_and_zero_vectors(spark):
    df, _ = _vectors(spark, {"a": 20, "b": 6}, zero_ids={20, 21})
    assert smote(df.limit(0), "label", "features", "id").count() == 0
    out = smote(df, "label", "features", "id", ratio_to_max=1.0)
    # zero vectors have cosine 0 with everything but still act as seeds/neighbours
    assert out.filter("is_synthetic").count() == 14
    assert smote_percent(df.limit(0), "label", "features", "id").count() == 0


def test_smote_vector_output(spark):
    from pyspark.ml.linalg import VectorUDT
    df, _ = _vectors(spark, {"a": 10, "b": 4})
    out = smote(df, "label", "features", "id", ratio_to_max=1.0, vector_output=True)
    assert isinstance(out.schema["features"].dataType, VectorUDT)
    # b: n=4 -> k_c=2, r=1, need 6 but only 4 seeds: under-fill to 4 new rows
    assert out.count() == 18


def test_dotted_column_names(spark):
    from equiclass import class_counts, class_profile, class_rows, nominal_index, oversample, sample_exact
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], float(i)) for i in range(30)], "`row.id` long, `c.x` string, `a``b` double")
    out = oversample(df, "c.x", ["row.id"], seed=1)
    assert out.columns == df.columns and {r["n"] for r in class_counts(out, "c.x").collect()} == {20}
    assert sample_exact(df, "c.x", None, 4).count() == 8 and class_rows(df, "c.x", "a").count() == 20
    assert class_profile(df, "c.x").columns[0] == "c.x"
    assert nominal_index(df, "c.x").columns[-1] == "c.x_code"
