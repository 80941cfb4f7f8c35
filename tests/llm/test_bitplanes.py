import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from equiclass.llm.bitplanes import PieceEncoder, pack_block, read_index, read_tokens, unpack_block, write_tokens
from equiclass.llm.common import work_path
from equiclass.llm.queries import op1_bitplane_tokens, tokenizer_file
from tests.llm.helpers import ROWS, documents, empty


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def _expected(tokenizer, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_block_round_trip(kind, n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), rng.integers(0, 1 << 32, n), np.zeros(n)):
        ids = ids.astype(np.uint32)
        payload = pack_block(ids, kind, zstandard.ZstdCompressor().compress)
        assert (unpack_block(payload, zstandard.ZstdDecompressor().decompress) == ids).all()
    with pytest.raises(ValueError):
        unpack_block(b"XXXX" + payload[4:], None)


def test_a_small_memory_gives_the_same_ids(tokenizer, monkeypatch):
    import equiclass.llm.bitplanes as module

    monkeypatch.setattr(module, "CACHE", 2_000)
    monkeypatch.setattr(module, "SLICE", 50)
    encoder = PieceEncoder(tokenizer)
    for _, text, *_ in ROWS:
        ids = np.frombuffer(encoder.encode(text or ""), dtype="<u4").tolist()
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids


class Counting:
    """A tokenizer that counts the words it is asked for."""

    def __init__(self, tokenizer):
        self.inner, self.model, self.words = tokenizer, self, Counter()
        self.encode, self.get_added_tokens_decoder = tokenizer.encode, tokenizer.get_added_tokens_decoder

    def tokenize(self, word):
        self.words[word] += 1
        return self.inner.model.tokenize(word)


def test_frequent_pieces_stay_whatever_rare_ones_come_by(tokenizer, monkeypatch):
    import equiclass.llm.bitplanes as module

    monkeypatch.setattr(module, "CACHE", 40 * module.PIECE_BYTES)
    counting = Counting(tokenizer)
    encoder = PieceEncoder(counting)
    rare = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(1000, 1500)]
    for word in rare:
        text = f"so common, {word}, common."
        ids = np.frombuffer(encoder.encode(text), dtype="<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    assert counting.words["\u0120common"] == 1
    assert all(counting.words["\u0120" + word] == 1 for word in rare)


def test_a_mark_in_a_text_is_no_cut(tokenizer):
    encoder = PieceEncoder(tokenizer)
    for text in ("a\x01, b", "a \x01. b \x01", "\x01,", "a, b.\nc, .\x01"):
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.encode(text) == want


def test_special_strings_are_what_the_library_makes_of_them(tokenizer):
    ids = np.frombuffer(PieceEncoder(tokenizer).encode("a <|endoftext|> b"), dtype="<u4").tolist()
    assert ids == tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids and 50256 in ids


def test_pieces_are_exact(tokenizer):
    encoder = PieceEncoder(tokenizer)
    texts = [r[1] or "" for r in ROWS] + [
        "a\n\nb", "a \nb", "a\n b", " a", "\na", "a ", "a\n", "a,b. c.d ...", "don't I'll 'tis", "x  y", " z", "##. a., 3.5",
        "A.\nB", "café.\nÉté,", "a\x1cb\x1d c", "×÷ ×.", "ǅɐ."]
    for _ in range(2):      # the second time from memory
        for t in texts:
            want = np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
            assert encoder.encode(t) == want, repr(t)[:60]


@pytest.mark.parametrize("kind,block", [("byte", 65_536), ("bit", 100), ("byte", 7)])
def test_store_round_trip(spark, tokenizer, kind, block):
    rows = [r for r in ROWS if len(r[1] or "") < 5000]
    path = work_path(spark, "test-tokens")
    write_tokens(documents(spark, rows), path, tokenizer_file(), planes=kind, block_ids=block)
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in read_tokens(spark, path).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = _expected(tokenizer, sorted(((r[0], r[1]) for r in rows), key=key))
    assert sorted(got, key=lambda r: r[1]) == want
    index = read_index(spark, path).orderBy("start").collect()
    assert [r["start"] for r in index] == list(np.cumsum([0] + [r["n_ids"] for r in index[:-1]]))
    assert all(len(r["plane_bytes"]) == (4 if kind == "byte" else 32) for r in index)


def test_long_texts_cross_blocks(spark, tokenizer):
    path = work_path(spark, "test-tokens")
    write_tokens(documents(spark), path, tokenizer_file(), block_ids=1000)
    got = read_tokens(spark, path).filter("doc_id = 5").first()
    assert got["ids"] == np.array(tokenizer.encode(ROWS[4][1], add_special_tokens=False).ids + [2], "<u4").tobytes()


def test_query_on_the_whole_table(spark, sf001, tokenizer):
    rows = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in op1_bitplane_tokens(spark, sf001).collect())
    assert got == _expected(tokenizer, rows)


def test_empty_table_and_damage(spark):
    path = work_path(spark, "test-tokens")
    write_tokens(empty(spark), path, tokenizer_file())
    assert read_tokens(spark, path).count() == 0 and read_index(spark, path).count() == 0
    path, bad = work_path(spark, "test-tokens"), work_path(spark, "test-tokens")
    write_tokens(documents(spark), path, tokenizer_file())
    spark.read.parquet(f"{path}/blocks").withColumn("payload_crc32", F.lit(1).cast("long")).write.parquet(f"{bad}/blocks")
    with pytest.raises(Exception, match="damaged"):
        read_tokens(spark, bad).collect()
    with pytest.raises(ValueError):
        write_tokens(documents(spark), path, tokenizer_file(), planes="nibble")


def test_many_texts_at_once_look_up_each_distinct_piece_once(tokenizer, monkeypatch):
    import pyarrow as pa

    import equiclass.llm.bitplanes as module

    texts = ["so it is, so it was. So", None, "", "é. ×. ß, a.b.\nWord!\n\nx  y \t z.", "a  b 　 c.",
             ". , .", "don't stop's", "so <|endoftext|> so", "à la fin.", "Ünï,", "\n", " ", "\x01 \x85x", "so"] * 3
    expected = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (1, 20, 1 << 20):
        monkeypatch.setattr(module, "SLICE_BYTES", size)
        for kind in (pa.string(), pa.large_string()):
            found = PieceEncoder(tokenizer).encode_many(pa.array(["left out", *texts], kind).slice(1))
            assert [np.frombuffer(x, dtype="<u4").tolist() for x in found] == expected
    encoder, asked = PieceEncoder(tokenizer), Counter()

    class Known(dict):
        def __getitem__(self, key):
            asked[key] += 1
            return encoder.learn(key)

    encoder.known = Known()
    list(encoder.encode_many(pa.array(["one two one two", "one two two"] * 5)))
    assert asked == {b"one": 1, b" two": 1, b" one": 1}
