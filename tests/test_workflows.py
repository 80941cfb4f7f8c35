import os
import tempfile

from equiclass.plans.workflows import rebalance_csv, resampling_report, smote_lines
from tests.test_sources_profile import GAUGE_ROWS


def test_rebalance_csv_headerless(spark):
    d = tempfile.mkdtemp(prefix="equiclass-wf-")
    p = os.path.join(d, "f1.csv")
    with open(p, "w") as fh:
        fh.write("\n".join(GAUGE_ROWS + GAUGE_ROWS[:1]))   # a duplicate line is a separate row
    r = rebalance_csv(spark, p)
    assert r.class_col == "_c3"
    assert dict(r.before.collect()) == {"ok": 4, "flood": 1, "low": 1}
    assert dict(r.after.collect()) == {"ok": 4, "flood": 4, "low": 4}
    assert r.frame.columns == ["_c0", "_c1", "_c2", "_c3"]


def test_smote_lines(spark):
    d = tempfile.mkdtemp(prefix="equiclass-wf-")
    p = os.path.join(d, "vec.txt")
    lines = [f"a 1:{i}.5 2:{i % 3}" for i in range(12)] + ["", f"b 1:0.5 2:1", "b 1:1.5 2:0.25", "b 2:3"]
    with open(p, "w") as fh:
        fh.write("\n".join(lines))
    out = smote_lines(spark, p, size=2, k=2, sampling_rate=0.5, ratio_to_max=1.0)
    counts = {(r["label"], r["is_synthetic"]): r["count"] for r in out.groupBy("label", "is_synthetic").count().collect()}
    # b: n=3, k_c=1, r=1, need 9 -> 3 seeds x 1 = 3 synthetic rows
    assert counts == {("a", False): 12, ("b", False): 3, ("b", True): 3}


def test_resampling_report_steps(spark):
    df = spark.createDataFrame([(i, "x" if i < 30 else ("y" if i < 40 else "z"), float(i), float(i % 4))
                                for i in range(45)], "id long, cls string, f1 double, f2 double")
    rep = {(r["step"], r["class_code"]): r["n"] for r in resampling_report(df, "cls", ["f1", "f2"], "id").collect()}
    assert rep[("original", 0)] == 30 and rep[("original", 2)] == 5
    assert {rep[("spread_subsample", c)] for c in range(3)} == {5}
    assert rep[("smote", 2)] == 10 and rep[("smote", 0)] == 30
    assert rep[("resample", 0)] == rep[("resample", 1)] == rep[("resample", 2)]
