import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from equiclass.llm.alignment import SPACE, Aligner, Vocabulary, alignment, gallop, units_of
from equiclass.llm.queries import piece_file, tokenizer_file

from .helpers import documents, empty


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(tokenizer_file(), piece_file())


def plain(v, text):
    """(A ids, B ids, groups, links) by whole-text encoding and a scan of all token pairs."""
    if not text:
        return [], [], [], []
    whole = (" " + text).encode()
    a, b = v.a.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text)
    if b"".join(v.a_bytes[i] for i in a) != whole or b"".join(v.b_bytes[i] for i in b) != whole:
        return [], [], [], []
    spans = []
    for ids, octets in ((a, v.a_bytes), (b, v.b_bytes)):
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(octets[i]), i))
            at += len(octets[i])
        spans.append(own)
    common = {s[1] for s in spans[0]} & {s[1] for s in spans[1]}
    sides = []
    for side in spans:
        own = [[]]
        for _, e, i in side:
            own[-1].append(i)
            if e in common:
                own.append([])
        sides.append(own[:-1])
    groups = list(zip(*sides, strict=True))
    links, first = [], 0
    for s, e, i in spans[0]:
        while spans[1][first][1] <= s:
            first += 1
        k = first
        while k < len(spans[1]) and spans[1][k][0] < e:
            links.append((i, spans[1][k][2]))
            k += 1
    return a, b, groups, links


def digest(groups):
    text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return hashlib.sha256(text.encode()).hexdigest() if groups else ""


def brute(v, texts):
    found = [plain(v, t) for t in texts]
    counts = Counter(p for f in found for p in set(f[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
             sum(counts[p] for p in links), digest(groups)) for a, b, groups, links in found]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@given(st.lists(st.integers(0, 60), unique=True), st.lists(st.integers(0, 60), unique=True))
def test_gallop_finds_all_common_values(one, two):
    one, two = sorted(one), sorted(two)
    assert [(one[i], two[j]) for i, j in gallop(one, two)] == [(x, x) for x in sorted(set(one) & set(two))]


PARTS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", " ", "\x1c", "a", "the", "The quick", "don't", "é",
         "é", "你好", "\U0001F600", "▁", "<s>", "<0x41>", "<unk>", "<|endoftext|>", "12345", "...", "ﬁ",
         "x" * 40, "\x00", "Zürich", "==>", " ,", ".\n", "​", "﻿"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_units_give_what_whole_texts_give(vocabulary, text):
    a, b, groups, links = plain(vocabulary, text)
    n_a, n_b, n_groups, n_links, sha, pairs, times = Aligner(vocabulary).documents([text])[0]
    assert (n_a, n_b, n_groups, n_links, sha) == (len(a), len(b), len(groups), len(links), digest(groups))
    assert dict(zip([(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs], times.tolist(), strict=True)) == Counter(links)


def test_small_memory_and_slices(vocabulary, monkeypatch):
    import equiclass.llm.alignment as module

    monkeypatch.setattr(module, "SLICE", 7)
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "Beta-2", "gamma\ndelta", "don't", "ßtraße"]) for _ in range(400))
    got = Aligner(vocabulary, memory=1000).documents([text])[0]
    a, b, groups, links = plain(vocabulary, text)
    assert got[:5] == (len(a), len(b), len(groups), len(links), digest(groups))
    assert got[6].sum() == len(links) and len(got[5]) == len(set(links))


def test_units_join_to_the_text():
    for text in ["a b", " a  b ", "a\nb\n\n c", "\n", " ", "a \n b", "x\ty z"]:
        assert "".join(k if k[:1] == "\n" else " " + k.lstrip(SPACE) for k in units_of(text)) == " " + text


@pytest.mark.parametrize("sent", [250_000, 20, 0])
def test_query_equals_brute_force(spark, vocabulary, sent):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    want = brute(vocabulary, [r["text"] for r in rows])
    out = alignment(docs, tokenizer_file(), piece_file(), sent_pairs=sent)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [(r["doc_id"], *(r[c] for c in COLUMNS)) for r in out.collect()]
    assert Counter(got) == Counter((r["doc_id"], *w) for r, w in zip(rows, want, strict=True))


def test_whole_table(spark, vocabulary, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute(vocabulary, [r["text"] for r in rows])
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in
           alignment(docs, tokenizer_file(), piece_file(), sent_pairs=500).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(rows, want, strict=True)}


def test_empty_table(spark):
    assert alignment(empty(spark), tokenizer_file(), piece_file()).count() == 0
