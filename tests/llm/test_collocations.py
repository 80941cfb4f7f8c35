import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from equiclass.llm.collocations import Automaton, Paths, collocations, collocations_sql, windows

from .helpers import documents, empty

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top, inside):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cand.items():
        if any(lang == other and len(q) > len(p) and 100 * b >= inside * a
               and any(q[i:i + len(p)] == p for i in range(len(q))) for (other, q), b in cand.items()):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own[:top])]
    return sorted(ranked)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "a", "é", "don't", "ü.b", "x,y", "stock\tmarket", "crash", "z\nz", "\x0bq"]
    return [(i, rng.choice(["en", "de", None, "und"]),
             rng.choice([None, "", " "] + [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(9)]))
            for i in range(n)]


@pytest.mark.parametrize("shard, part", [(1_000_000, 1_000_000), (150, 200)])
def test_equals_brute_force(spark, shard, part):
    rows = corpus(shard)
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    out = collocations(df, least=5, top=40, shard=shard, part=part)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect())) == brute([r[1:] for r in rows], 5, 40, 80)


def test_one_prefix_holds_most_windows(spark):
    rng = random.Random(2)
    rows = [(i, "en", " ".join(f"hot pair w{rng.randrange(30)} v{rng.randrange(5)}" for _ in range(40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    out = collocations(df, least=3, top=500, shard=300, part=100)
    assert sorted(map(tuple, out.collect())) == brute([r[1:] for r in rows], 3, 500, 80)


@pytest.mark.parametrize("least", [2, 30])
def test_sql_twin(spark, sf001, least):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf001}/documents.parquet'")
    want = con.execute(collocations_sql(least=least)).fetchall()
    assert sorted(map(tuple, collocations(docs, least=least).collect())) == sorted(want)


def test_odd_rows(spark):
    df = documents(spark)
    rows = [(r["lang"], r["text"]) for r in df.select("lang", "text").collect() if len(r["text"] or "") < 10_000]
    short = df.filter("text is null or length(text) < 10000")
    assert sorted(map(tuple, collocations(short, least=2).collect())) == brute(rows, 2, 2000, 80)
    assert collocations(df, least=2).count() > 0


def test_automata():
    rng = np.random.default_rng(3)
    words = [b"b", b"a", b"cc", "é".encode(), b"a1"]

    def random_paths(n):
        flat = rng.integers(0, 6, n)
        return Paths.of(words, windows(flat)), Counter(
            tuple(words[x - 1] for x in flat[i:i + k]) for i in range(n) for k in range(1, 5)
            if i + k <= n and (flat[i:i + k] > 0).all())

    def weights(automaton):
        return {tuple(p.split(b" ")): int(w) for d, level in enumerate(automaton.levels)
                for p, w in zip(automaton.phrases(d, np.arange(len(level[1]))), level[2], strict=True)}

    (one, n1), (two, n2) = random_paths(400), random_paths(90)
    for paths, n in ((one, n1), (two, n2)):
        again = Paths.unpack(paths.pack())
        assert again.words == paths.words and (again.rows == paths.rows).all() and (again.counts == paths.counts).all()
        assert weights(Automaton.built(paths)) == n
    a, b = Automaton.built(one), Automaton.built(two)
    assert weights(Automaton.union([a, b])) == n1 + n2
    found = {tuple(p.split(b" ")): int(w) for d, got in enumerate(a.compose(b))
             for p, w in zip(b.phrases(d, np.arange(len(got))), got, strict=True)}
    assert found == {p: n1[p] for p in n2}


def test_empty_table(spark):
    assert collocations(empty(spark)).count() == 0


def test_parts_of_six_tasks_fit_half_an_executor():
    """Memory of counting a part, measured on a smaller one: six at once take less than 1500 MB."""
    import tracemalloc

    import pyarrow as pa

    from equiclass.llm.collocations import PART, _counted
    rng, n = np.random.default_rng(1), 100_000
    names = [b"w%05d" % i for i in range(5000)]
    shards = [Paths.of(names, rng.integers(0, 5000, size=(n // 10, 4)).astype(np.int32)).pack() for _ in range(10)]
    table = pa.table({"lang": ["en"] * 10, "paths": pa.array(shards, pa.binary())})
    tracemalloc.start()
    _counted(30, [np.zeros(0, dtype=np.int64)] * 3)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 6 * PART * peak / n < 1.5e9
