import re

import pytest

from equiclass.llm.containment import extra_bits, leaks, without_leaks
from equiclass.llm.queries import op4_containment
from tests.llm.helpers import BASE, ROWS, documents, empty, prose

ITEMS = "item_id long, text string, doc_key long, shared long"


def _shingles(text, size=5):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _brute(rows, items, threshold=0.8):
    out = set()
    for i, text in rows:
        own = _shingles(text)
        for k, item in items:
            s = _shingles(item)
            n = min(map(len, s), default=0)
            if 0 < n < 5:
                if s <= _shingles(text, n):
                    out.add((i, k, 1, 1))
            elif s and len(s & own) / len(s) >= threshold:
                out.add((i, k, len(s & own), len(s)))
    return out


def _got(frame):
    return {(r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in frame.collect()}


def _corpus():
    passage = prose(40, 77)
    rows = list(ROWS)
    words = passage.split()
    for i, part in enumerate((passage, " ".join(words[:36]), " ".join(words[:33]), " ".join(words[20:] + words[:20]),
                              passage.upper().replace(" ", "###  "))):
        rows.append((100 + i, f"{prose(2000, i)} {part}. {prose(3000, 50 + i)}", "en", "hot", 1))
    rows += [(200 + i, f"{prose(10, 900 + i)} {passage}", "en", "hot", 1) for i in range(40)]
    items = [(1, passage), (2, None), (3, ""), (4, "!?"), (5, "word"), (6, " ".join(BASE)), (7, prose(6, 4)),
             (1, passage), (None, prose(30, 6)), (8, "below zero " + prose(40, 6)), (9, ROWS[0][1]),
             (10, "Lazy, dog"), (11, "dog lazy"), (12, "text with words and"), (13, "over the lazy"), (14, "nowhere")]
    return rows, items


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_matches_brute_force(spark, sent):
    rows, items = _corpus()
    frame = spark.createDataFrame([(*i, 1, 2) for i in items], ITEMS)
    got = leaks(documents(spark, rows), frame, sent_rows=sent)
    want = _brute([r[:2] for r in rows], items)
    assert _got(got) == want and len(want) > 40
    # items 1 are two, so their pairs come twice; the repeated document 9 comes once
    assert got.filter("item_id = 1 and doc_id = 100").count() == 2 and got.filter("item_id = 6 and doc_id = 9").count() == 1
    clean = without_leaks(documents(spark, rows), frame, sent_rows=sent)
    dirty = {i for i, *_ in want}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(r[0]) for r in rows if r[0] not in dirty)
    assert clean.columns == documents(spark, rows).columns


def test_items_shorter_than_a_shingle(spark):
    docs = documents(spark, [(1, "one two three four five six seven", "en", "a", 1), (2, "four three", "en", "a", 1),
                             (3, "three four", "en", "a", 1), (3, "three four", "en", "a", 1)])
    items = spark.createDataFrame([(7, "three FOUR five", 1, 1), (8, "three four", 1, 1), (9, "seven one", 1, 1)], ITEMS)
    assert _got(leaks(docs, items)) == {(1, 7, 1, 1), (1, 8, 1, 1), (3, 8, 1, 1)}
    assert leaks(docs, items).count() == 3
    assert [r["doc_id"] for r in without_leaks(docs, items).collect()] == [2]


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c d e f", 1, 1)], ITEMS)
    none = spark.createDataFrame([], ITEMS)
    assert leaks(empty(spark), items).count() == 0 and leaks(documents(spark), none).count() == 0
    assert without_leaks(documents(spark), none).count() == len(ROWS) and without_leaks(empty(spark), items).count() == 0


def test_bins_suit_the_smallest_item():
    assert [extra_bits(n, 0.8, 1e-6) for n in (1, 5, 11, 50)] == [19, 5, 1, 0] or extra_bits(1, 0.8, 1e-6) >= 15
    assert extra_bits(50, 0.8, 1e-6) <= extra_bits(11, 0.8, 1e-6) <= extra_bits(5, 0.8, 1e-6) <= extra_bits(1, 0.8, 1e-6)


def test_query_on_the_whole_table(spark, sf01):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf01}/benchmark.parquet").collect()]
    assert _got(op4_containment(spark, sf01)) == _brute(docs, items)


def test_main_path_is_native(spark, sf001):
    plan = op4_containment(spark, sf001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
