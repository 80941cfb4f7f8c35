import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiclass.operators.encode import nominal_index
from equiclass.operators.profile import (class_counts, class_profile, code_counts, compare_profiles,
                                         feature_stats, vector_stats)
from equiclass.sources.readers import (format_labeled_vectors, parse_labeled_vectors, read_lines,
                                       read_table)

# Invented readings of five river gauges: level, flow, a note of the weather, state (the class).
GAUGE_ROWS = [
    "1.25,310,dry,ok",
    "4.80,1905,storm,flood",
    "1.31,322,dry,ok",
    "0.40,75,frost,low",
    "1.02,288,rain,ok",
]


@pytest.fixture(scope="module")
def files():
    d = tempfile.mkdtemp(prefix="equiclass-fixtures-")
    f1 = os.path.join(d, "f1.csv")
    with open(f1, "w") as fh:
        fh.write("\n".join(GAUGE_ROWS))
    f2 = os.path.join(d, "f2.csv")
    with open(f2, "w") as fh:
        fh.write("level,flow,weather,state\n" + "\n".join(GAUGE_ROWS) + "\n")
    f3 = os.path.join(d, "f3.csv")
    with open(f3, "w") as fh:
        fh.write("station.name,level,watch\n")
        fh.write("upper mill,1.25,no\nold bridge,4.80,yes\nweir,0.40,yes\nharbour,1.31,no\n")
    f5 = os.path.join(d, "f5.txt")
    with open(f5, "w") as fh:
        fh.write("pos 1:0.5 3:1.5\n\n   \nneg  2:2.0\tfour:1\n".replace("\tfour:1", " 4:1") + "lonely\n")
    return {"f1": f1, "f2": f2, "f3": f3, "f5": f5}


def test_headerless_csv_all_strings(spark, files):
    df, cls = read_table(spark, files["f1"])
    assert df.columns == ["_c0", "_c1", "_c2", "_c3"] and cls == "_c3"
    assert all(t == "string" for _, t in df.dtypes)
    assert dict(class_counts(df, cls).collect()) == {"ok": 3, "flood": 1, "low": 1}


def test_header_inferred_and_multi_path(spark, files):
    df, cls = read_table(spark, files["f2"], header=True, infer=True)
    assert cls == "state" and dict(df.dtypes)["level"] == "double" and dict(df.dtypes)["flow"] == "int"
    twice, _ = read_table(spark, [files["f2"], files["f2"]], header=True)
    assert twice.count() == 10
    text_cls, c = read_table(spark, files["f3"], header=True)
    assert c == "watch" and dict(class_counts(text_cls, c).collect()) == {"no": 2, "yes": 2}


def test_labeled_lines(spark, files):
    lines = read_lines(spark, files["f5"])
    assert lines.count() == 3
    p = parse_labeled_vectors(lines, size=4).orderBy("label").collect()
    got = {r["label"]: (r["indices"], r["values"], r["features"]) for r in p}
    assert got["pos"] == ([0, 2], [0.5, 1.5], [0.5, 0.0, 1.5, 0.0])
    assert got["neg"] == ([1, 3], [2.0, 1.0], [0.0, 2.0, 0.0, 1.0])
    assert got["lonely"] == ([], [], [0.0, 0.0, 0.0, 0.0])


def test_libsvm_matches_own_parser(spark):
    from equiclass.sources.readers import read_libsvm
    d = tempfile.mkdtemp(prefix="equiclass-libsvm-")
    p = os.path.join(d, "v.txt")
    with open(p, "w") as fh:
        fh.write("1 1:0.5 3:1.5\n0 2:2.0 4:1\n")
    a = read_libsvm(spark, p, num_features=4).orderBy("label").collect()
    b = parse_labeled_vectors(read_lines(spark, p), size=4).orderBy("label").collect()
    assert [(x["label"], x["features"]) for x in a] == [(float(y["label"]), y["features"]) for y in b]


BAD_LINES = {"a 1:0.5 junk": "malformed", "a 3:x": "malformed", "a :4": "malformed", "a 2:3:4": "malformed",
             "a 1:0.5 9:5": "out of range", "a 0:7 2:2": "out of range", "a 1:1 1:2": "twice"}


@pytest.mark.parametrize("line", sorted(BAD_LINES))
def test_bad_lines_fail(spark, line):
    df = spark.createDataFrame([(line,)], "value string")
    for cols in (["label", "features"], ["features"], ["indices"], ["values"]):
        with pytest.raises(Exception, match=BAD_LINES[line]):
            parse_labeled_vectors(df, size=3).select(*cols).collect()


def test_bad_lines_in_an_error_column(spark):
    lines = [(x,) for x in BAD_LINES] + [("b 2:1e-3 1:-2",), ("c",), (None,)]
    df = spark.createDataFrame(lines, "value string").withColumn("line", F.col("value"))
    rows = {r["line"]: r for r in parse_labeled_vectors(df, size=3, errors="column").collect()}
    for line, reason in BAD_LINES.items():
        r = rows[line]
        assert reason in r["parse_error"] and r["label"] == "a" and r["features"] is None and r["indices"] is None
    assert rows["b 2:1e-3 1:-2"]["features"] == [-2.0, 0.001, 0.0] and rows["b 2:1e-3 1:-2"]["parse_error"] is None
    assert rows["c"]["features"] == [0.0, 0.0, 0.0] and rows["c"]["indices"] == []
    assert rows[None]["label"] is None and rows[None]["features"] is None


def test_code_counts_report_every_code(spark):
    df = spark.createDataFrame([(0,), (1,), (9,), (-1,), (None,)], "code int")
    got = [(r["code"], r["n"]) for r in code_counts(df, "code", 3).collect()]
    assert got == [(None, 1), (-1, 1), (0, 1), (1, 1), (2, 0), (9, 1)]


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "c string")
    out = class_profile(df, "c")
    assert out.collect() == [] and len(out.columns) == 9


def test_format_parse_round_trip(spark):
    df = spark.createDataFrame([(1, "a", [0.25, 0.0, -3.5e-7]), (2, "b", [1.0, 2.0, 3.0])],
                               "id int, label string, v array<double>")
    lines = df.select("id", format_labeled_vectors("label", "v").alias("value"))
    assert lines.filter("id = 1").first()["value"] == "a 1:0.25 3:-3.5E-7"
    back = parse_labeled_vectors(lines, size=3).select("id", "features")
    assert back.exceptAll(df.select("id", F.col("v").alias("features"))).count() == 0


def test_class_profile_and_compare(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(8)], "id int, c string")
    prof = {r["c"]: r for r in class_profile(df, "c").collect()}
    assert prof["a"]["n"] == 6 and prof["a"]["n_total"] == 8 and prof["b"]["n_min"] == 2
    assert prof["a"]["share_pct"] == 75.0 and prof["a"]["majority_pct"] == 75.0
    assert prof["b"]["imbalance_ratio"] == 3.0 and prof["b"]["n_classes"] == 2
    after = df.filter("c = 'a'").union(spark.createDataFrame([(9, "z")], "id int, c string"))
    cmp = {r["c"]: (r["n_before"], r["n_after"], r["delta"]) for r in compare_profiles(df, after, "c").collect()}
    assert cmp == {"a": (6, 6, 0), "b": (2, 0, -2), "z": (0, 1, 1)}


def test_class_counts_order(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), ("w",), ("x",), (None,)], "c string")
    assert [tuple(r) for r in class_counts(df, "c").collect()] == [("x", 2), ("y", 2), (None, 1), ("w", 1)]


def test_feature_stats_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 5, size=(50, 2)).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in vals], "a double, b double")
    got = {r["feature"]: r for r in feature_stats(df, ["a", "b"]).collect()}
    for i, c in enumerate("ab"):
        assert got[c]["n"] == 50
        assert got[c]["mean"] == pytest.approx(vals[:, i].mean())
        assert got[c]["variance"] == pytest.approx(vals[:, i].var(ddof=1))
        assert got[c]["non_zeros"] == int((vals[:, i] != 0).sum())


def test_vector_stats(spark):
    from pyspark.ml.functions import array_to_vector
    df = spark.createDataFrame([([1.0, 0.0],), ([3.0, 2.0],)], "v array<double>")
    s = vector_stats(df.select(array_to_vector("v").alias("v")), "v").first()
    assert list(s["mean"]) == [2.0, 1.0] and list(s["numNonZeros"]) == [2.0, 1.0]


@pytest.mark.parametrize("max_local", [1000, 2])
def test_nominal_index_codes(spark, max_local):
    df = spark.createDataFrame([(v,) for v in [5, 3, 9, 3, None, 40, 9]], "x int")
    out = nominal_index(df, "x", max_local=max_local)
    got = sorted((r["x"], r["x_code"]) for r in out.collect() if r["x"] is not None)
    assert got == [(3, 0), (3, 0), (5, 1), (9, 2), (9, 2), (40, 3)]
    assert out.filter("x is null").first()["x_code"] is None
    counts = dict(code_counts(out.filter("x is not null"), "x_code", 6).collect())
    assert counts == {0: 2, 1: 1, 2: 2, 3: 1, 4: 0, 5: 0}
