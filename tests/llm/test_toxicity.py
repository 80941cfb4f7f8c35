import random
import zlib

import numpy as np
import pytest

from equiclass.llm.queries import op3_toxicity
from equiclass.llm.toxicity import BITS, SLICE_CHARS, buckets, fit_toxicity, present, telling, toxicity_scores, without_toxic
from tests.llm.helpers import ROWS, documents, empty, prose

LABELS = "doc_id long, quality int, toxic int, text string, score double"


def _labelled(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = prose(rng.randint(5, 200), 1000 + i).split()
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["zzscum", "qqidiotic", "zzScumbag!"]))
        rows.append((i, " ".join(words), "en", "a", 1))
        marks.append((i, 1, int(toxic), "x", 0.0))
    return rows, marks


def test_held_out_rows_are_told_apart(spark):
    rows, marks = _labelled(spark)
    got = toxicity_scores(documents(spark, rows), spark.createDataFrame(marks, LABELS)).collect()
    assert len(got) == len(rows)
    truth = {m[0]: m[2] for m in marks}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and len(held) > 40
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_held_out_labels_change_nothing(spark):
    rows, marks = _labelled(spark, 120)
    other = [m if zlib.crc32(str(m[0]).encode()) % 5 else (*m[:2], 1 - m[2], *m[3:]) for m in marks]
    docs = documents(spark, rows)
    one, two = (fit_toxicity(docs, spark.createDataFrame(m, LABELS)) for m in (marks, other))
    assert (one[0] == two[0]).all() and one[1] == two[1]


def test_awkward_rows_and_labels(spark):
    rows, marks = _labelled(spark, 100)
    marks += [(None, 1, 1, "", 0.0), (3, None, None, None, None), (1, 1, 0, "", 0.0), (999_999, 1, 1, "", 0.0)]
    labels = spark.createDataFrame(marks, LABELS)
    shifted = [(None if r[0] is None else r[0] + 5000, *r[1:]) for r in ROWS]
    got = toxicity_scores(documents(spark, shifted + rows), labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(ROWS) + 100
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[5002] == by[5003] == by[5004] and len(by[5009]) == 2 and len(set(by[5009])) == 1
    assert by[5001] == by[5006]
    kept = without_toxic(documents(spark, shifted + rows), labels)
    assert kept.columns == documents(spark, rows).columns
    assert kept.count() == got.filter("score < 0.5").count()


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_one_class_or_none(spark, toxic):
    marks = [] if toxic is None else [(i, 1, toxic, "", 0.0) for i in range(30)]
    got = toxicity_scores(documents(spark), spark.createDataFrame(marks, LABELS)).collect()
    assert {r["predicted"] for r in got} == ({1} if toxic != 0 else {0}) and len({r["score"] for r in got}) == 1
    assert toxicity_scores(empty(spark), spark.createDataFrame(marks, LABELS)).count() == 0


def test_the_bounded_sample_is_enough(spark):
    rows, marks = _labelled(spark, 600, seed=8)
    got = toxicity_scores(documents(spark, rows), spark.createDataFrame(marks, LABELS), per_class=60, selected=2000)
    truth = {m[0]: m[2] for m in marks}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got.collect()]) > 0.9


def test_slices_see_every_ngram():
    text = prose(30_000, 2) + "y" * SLICE_CHARS + " needle"
    assert np.isin(present("needle"), present(text)).sum() >= len(present("needle")) - 1
    assert max(int(b.max()) for b in buckets(text)) < 1 << BITS
    assert list(present(None)) == list(present("")) == list(present(" \n"))


def test_telling_buckets():
    table = np.array([[50, 5, 0, 20], [5, 5, 10, 20]])
    assert list(telling(table, np.array([60, 60]), 2)) == [0, 2]


def test_query_on_the_whole_table(spark, sf01):
    got = op3_toxicity(spark, sf01)
    labels = spark.read.parquet(f"{sf01}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{sf01}/documents.parquet").count()
    m = got.join(labels, "doc_id").filter("held_out").toPandas()
    ranks = m["score"].rank()
    n = int((m["toxic"] == 1).sum())
    auc = (ranks[m["toxic"] == 1].sum() - n * (n + 1) / 2) / (n * (len(m) - n))
    assert auc > 0.7
