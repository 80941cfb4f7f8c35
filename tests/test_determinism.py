"""Same result whatever the partitioning and row order (so a recomputed task gives the same rows)."""

import pytest
from pyspark.sql import functions as F

from equiclass.operators.neighbors import nearest_neighbors
from equiclass.operators.resample import resample_uniform
from equiclass.operators.sample import sample_exact, sample_with_replacement
from equiclass.operators.smote import smote, smote_percent
from equiclass.operators.undersample import undersample_pair, undersample_spread
from tests.test_oversample import _frame
from tests.test_smote_knn import _vectors


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _shuffled(df):
    return df.repartition(5).orderBy(F.rand(11)).repartition(3)


ROW_OPS = {
    "sample_exact": lambda d: sample_exact(d, "cls", ["id"], 7, seed=2),
    "with_replacement": lambda d: sample_with_replacement(d, "cls", ["id"], 9, seed=2),
    "spread": lambda d: undersample_spread(d, "cls", ["id"], 1.5, seed=2),
    "pair": lambda d: undersample_pair(d, "cls", ["id"], "b", "a", 2.0, seed=2),
    "pair_exact": lambda d: undersample_pair(d, "cls", ["id"], "b", "a", 2.0, seed=2, exact=True),
    "resample": lambda d: resample_uniform(d, "cls", ["id"], bias=0.3, seed=2),
}


@pytest.mark.parametrize("name", sorted(ROW_OPS))
def test_row_operators(spark, name):
    df = _frame(spark, {"a": 60, "b": 17, "c": 5})
    assert _same(ROW_OPS[name](df), ROW_OPS[name](_shuffled(df)))


def test_vector_operators(spark):
    df, _ = _vectors(spark, {"a": 40, "b": 9, "c": 14})
    sh = _shuffled(df)
    assert _same(smote(df, "label", "features", "id", ratio_to_max=1.0),
                 smote(sh, "label", "features", "id", ratio_to_max=1.0))
    assert _same(smote_percent(df, "label", "features", "id", percent=300, k=4),
                 smote_percent(sh, "label", "features", "id", percent=300, k=4))
    assert _same(nearest_neighbors(df, df, "label", "id", "features", 3, tile=6),
                 nearest_neighbors(sh, sh, "label", "id", "features", 3, tile=6))
