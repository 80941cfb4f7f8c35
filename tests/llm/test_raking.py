import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from equiclass.llm import raking
from equiclass.llm.queries import KEEP_SHARE, op5_raking
from equiclass.llm.raking import ALPHA, SWEEPS, mixed, sampled, tokens_of
from tests.llm.helpers import ROWS, documents, empty


def _brute(rows, alpha=ALPHA, sweeps=SWEEPS, keep=None):
    """rows: (source, lang, topic, tokens) -> weight and probability by cell."""
    cells = defaultdict(int)
    for s, lang, t, n in rows:
        cells[s, lang, t] += n
    whole, weight, goals = sum(cells.values()), dict.fromkeys(cells, 1.0), []
    for d in range(3):
        sums = defaultdict(int)
        for c, n in cells.items():
            sums[c[d]] += n
        raised = {k: n ** alpha if n else 0.0 for k, n in sums.items()}
        goals.append({k: whole * v / (sum(raised.values()) or 1) for k, v in raised.items()})
    for _ in range(sweeps):
        for d in range(3):
            now = defaultdict(float)
            for c, n in cells.items():
                now[c[d]] += n * weight[c]
            for c in cells:
                weight[c] *= goals[d][c[d]] / now[c[d]] if now[c[d]] else 1.0
    raked = sum(n * weight[c] for c, n in cells.items()) or 1.0
    top = max([w for c, w in weight.items() if cells[c]], default=1.0)
    p = {c: (min(1.0, keep * whole / raked * w) if keep else w / top) if cells[c] else 1.0 for c, w in weight.items()}
    return weight, p


def _check(found, keep):
    rows = found.collect()
    weight, p = _brute([(r["source"], r["lang"], r["mix_topic"], r["mix_tokens"]) for r in rows], keep=keep)
    for r in rows:
        cell = r["source"], r["lang"], r["mix_topic"]
        assert r["mix_weight"] == pytest.approx(weight[cell], rel=1e-9)
        assert r["mix_probability"] == pytest.approx(p[cell], rel=1e-9)
    return rows


@pytest.mark.parametrize("keep", [None, 0.5])
def test_awkward_rows(spark, keep):
    docs = documents(spark)
    rows = _check(mixed(docs, keep_share=keep), keep)
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["mix_tokens"] == by[3]["mix_tokens"] == by[4]["mix_tokens"] == 0 and by[7]["mix_tokens"] == 1
    assert by[2]["mix_probability"] == 1.0 and by[2]["mix_kept"]          # a cell without tokens
    assert len({r["mix_kept"] for r in rows if r["doc_id"] == 9}) == 1
    kept = sampled(docs, keep_share=keep)
    assert kept.columns == docs.columns and kept.count() == sum(r["mix_kept"] for r in rows)
    assert mixed(empty(spark)).count() == 0 and sampled(empty(spark)).columns == docs.columns


def test_marginals_meet_the_targets(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    rows = _check(mixed(docs, keep_share=0.8), 0.8)
    for name in ("source", "lang", "mix_topic"):
        own, raked = defaultdict(float), defaultdict(float)
        for r in rows:
            own[r[name]] += r["mix_tokens"]
            raked[r[name]] += r["mix_tokens"] * r["mix_weight"]
        goal = {k: v ** ALPHA for k, v in own.items()}
        for k in own:
            assert raked[k] / sum(raked.values()) == pytest.approx(goal[k] / sum(goal.values()), abs=1e-6)
    # the sample's tokens follow the expected ones
    kept = sum(r["mix_tokens"] for r in rows if r["mix_kept"])
    expected = sum(r["mix_tokens"] * r["mix_probability"] for r in rows)
    assert abs(kept - expected) < 0.06 * expected


def test_given_targets(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    goal = {"en": 0.25, "de": 0.25, "fr": 0.5}
    rows = mixed(docs, targets={"lang": goal}, sweeps=12).collect()
    sums = defaultdict(float)
    for r in rows:
        sums[r["lang"]] += r["mix_tokens"] * r["mix_weight"]
    for k in ("en", "de", "fr", "es"):
        assert sums[k] / sum(sums.values()) == pytest.approx(goal.get(k, 0.0), abs=1e-4)
    assert not any(r["mix_kept"] for r in rows if r["lang"] == "es")


def test_existing_mix_columns_and_other_topics(spark):
    docs = documents(spark).withColumn("MIX_KEPT", F.lit("x")).withColumn("salt", F.lit(1)).withColumn("unit", F.lit(2))
    found = mixed(docs, topic=F.substring("text", 1, 1))
    assert found.columns.count("mix_kept") == 1 and "MIX_KEPT" not in found.columns and found.count() == len(ROWS)
    assert sampled(docs).columns == docs.columns


def test_tokens(spark):
    df = spark.createDataFrame([("a  b\n c ",), ("",), (" ",), (None,), ("x",)], "text string")
    assert [r[0] for r in df.select(tokens_of(F.col("text"))).collect()] == [3, 0, 0, 0, 1]


def test_query_is_native_and_whole(spark, sf001):
    found = op5_raking(spark, sf001)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    assert found.count() == spark.read.parquet(f"{sf001}/documents.parquet").count()
    assert 0 < KEEP_SHARE <= 1


def _shares(rows, name, by):
    sums = defaultdict(float)
    for r in rows:
        sums[r[name]] += r[by[0]] * r[by[1]]
    return {k: v / sum(sums.values()) for k, v in sums.items()}


@pytest.mark.parametrize("driver_cells", [50_000, 0])
def test_bounded_probabilities_meet_feasible_targets(spark, monkeypatch, driver_cells):
    monkeypatch.setattr(raking, "DRIVER_CELLS", driver_cells)
    sizes = {("a", "en"): 400, ("a", "de"): 300, ("b", "en"): 200, ("b", "de"): 100}
    rows = [(i, " ".join(["w"] * n), lang, s, 1) for i, ((s, lang), n) in enumerate(sizes.items())]
    goals = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "de": 0.5}}
    found = mixed(documents(spark, rows), targets=goals, keep_share=0.58, bounded=True).collect()
    assert any(r["mix_probability"] > 0.99 for r in found) and all(0 <= r["mix_probability"] <= 1 for r in found)
    assert sum(r["mix_tokens"] * r["mix_probability"] for r in found) == pytest.approx(580, rel=1e-3)
    for name, d in (("source", "source"), ("lang", "lang")):
        reached = _shares(found, name, ("mix_tokens", "mix_probability"))
        assert all(reached[k] == pytest.approx(v, abs=2e-4) for k, v in goals[d].items())


def test_bounded_keeps_the_share_and_reports_scarce_values(spark, sf01, caplog):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    with caplog.at_level("WARNING"):
        found = mixed(docs, keep_share=0.8, bounded=True).collect()
    assert "contact" in caplog.text and "can't be met" in caplog.text
    whole = sum(r["mix_tokens"] for r in found)
    assert sum(r["mix_tokens"] * r["mix_probability"] for r in found) == pytest.approx(0.8 * whole, rel=1e-3)
    for name in ("source", "lang", "mix_topic"):
        own, kept = defaultdict(float), defaultdict(float)
        for r in found:
            own[r[name]] += r["mix_tokens"]
            kept[r[name]] += r["mix_tokens"] * r["mix_probability"]
        goal = {k: v ** ALPHA for k, v in own.items()}
        scale = {k: kept[k] / goal[k] for k in own}
        free = [k for k in own if kept[k] < own[k] * 0.999]
        assert free and max(scale[k] for k in free) == pytest.approx(min(scale[k] for k in free), rel=0.02)
        assert all(scale[k] <= 1.02 * scale[free[0]] for k in own)      # whole values have less than their target
