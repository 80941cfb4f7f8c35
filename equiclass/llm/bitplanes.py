"""Token ids in a bit-plane store.

``write_tokens`` encodes documents, appends an end id to each, strings the ids of each
range of document ids together and cuts them into blocks of a fixed number of ids. A
block is transposed into planes (plane p of ``byte`` planes holds byte p of every id,
plane p of ``bit`` planes bit p of every id, packed), and each plane is compressed with
zstandard on its own: the high planes of token ids are nearly constant.

Store (a folder; Parquet files, written by Spark so that any file system of the cluster
will do and a lost task is written again):

* ``blocks``: shard, block, first (ids of the shard before it), n_ids, plane_bytes,
  payload_crc32, payload, and the documents with ids in the block (doc_ids, doc_starts:
  first id within the shard, doc_tokens).
* ``index``: the chunk index, one row per block: shard, block, start (ids of all blocks
  before it), n_ids, plane_bytes, payload_crc32.

Payload: ``BPL1``, kind (1 byte: 0 byte planes, 1 bit planes), number of planes
(1 byte), n_ids (uint32), compressed size of each plane (uint32; 0: every byte is zero),
then the planes. Integers are little-endian.

Shards are ranges of (doc_id, text hash) in ascending order, null ids first, so that the
order of ids is the order of documents; one shard is what one task writes. Equal ids
with different texts may fall into neighbouring shards; they are ordered by the hash.
Null texts count as empty: they hold the end id alone. A text that holds the string of a
special token is encoded by the library as a whole, which gives it that token's id. A very
long text goes slice by slice; its ids are held until the blocks they fill are written. An
empty table gives an empty store. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import codecs
import re
import struct
import sys
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"BPL1"
KINDS = ("byte", "bit")
BLOCK_IDS = 65_536
#: Bytes of the pieces of text whose ids a worker remembers, and what one takes beside its ids.
CACHE = 48 << 20
PIECE_BYTES = 160
#: Pieces looked up at once, of a text that is cut on its own.
SLICE = 200_000
#: Bytes of the texts that are cut into pieces at once.
SLICE_BYTES = 2 << 20
# White space of the tokenizer's split pattern: the ASCII characters, and the others.
ASCII_WS = " \t\n\x0b\x0c\r"
OTHER_WS = "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
# Characters that are letters in every version of the Unicode tables.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
LETTERS = re.compile(f"[{LETTER}]+")
# A line end or space, letters, and marks up to the end of a piece.
WORD = re.compile(f"([ \n]?)([{LETTER}]+)([!-/:-@\\[-`{{-~]*)")


def _byte_table(characters: str) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(characters.encode())] = True
    return found


IS_WS = _byte_table(ASCII_WS)
IS_STOP = _byte_table(".,")
IS_ASCII_LETTER = _byte_table("".join(map(chr, [*range(65, 91), *range(97, 123)])))
#: Last bytes of the other white space, as one number.
WS_CODES = np.array([int.from_bytes(c.encode(), "big") for c in OTHER_WS])


def piece_starts(octets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, of the texts' UTF-8 bytes and the texts' own (distinct) starts.

    A piece begins where a text does, where a run of white space does, and at a full stop or comma
    behind a letter and before such a place. Two pieces are one where white space that isn't ASCII is
    involved: they stay whole.
    """
    begins = IS_WS[octets]
    begins[1:] &= ~begins[:-1]
    padded = np.concatenate([np.zeros(3, dtype=np.uint8), octets])  # octets[p - 1] is padded[p + 2]
    runs = np.flatnonzero(begins)
    wide = runs[padded[runs + 2] >= 0x80]
    if len(wide):
        two = (padded[wide + 1].astype(np.int64) << 8) | padded[wide + 2]
        three = (padded[wide].astype(np.int64) << 16) | two
        begins[wide[np.isin(two, WS_CODES) | np.isin(three, WS_CODES)]] = False
    begins[starts] = True
    ends = np.append(np.flatnonzero(begins), len(octets))
    stops = ends[IS_STOP[padded[ends + 2]]] - 1
    # The character before the stop: an ASCII letter, or two bytes from U+00C0 to U+024F.
    last, two = padded[stops + 2], (padded[stops + 1].astype(np.int64) << 8) | padded[stops + 2]
    letter = IS_ASCII_LETTER[last] | (((last & 0xC0) == 0x80) & (two >= 0xC380) & (two <= 0xC98F)
                                      & (two != 0xC397) & (two != 0xC3B7))
    begins[stops[letter]] = True
    return np.flatnonzero(begins)


def pack_block(ids: np.ndarray, kind: str, compress) -> bytes:
    """One block's payload from its uint32 ids."""
    n = len(ids)
    octets = ids.astype("<u4", copy=False).view(np.uint8).reshape(n, 4)
    planes = [octets[:, p] for p in range(4)]
    if kind == "bit":
        planes = [np.packbits((plane >> b) & 1) for plane in planes for b in range(8)]
    packed = [compress(p.tobytes()) if p.any() else b"" for p in planes]
    head = MAGIC + struct.pack("<BBI", KINDS.index(kind), len(packed), n)
    return head + struct.pack(f"<{len(packed)}I", *map(len, packed)) + b"".join(packed)


def plane_sizes(payload: bytes) -> list[int]:
    _, n_planes, _ = struct.unpack_from("<BBI", payload, 4)
    return list(struct.unpack_from(f"<{n_planes}I", payload, 10))


def unpack_block(payload: bytes, decompress) -> np.ndarray:
    """The uint32 ids of a payload."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token block")
    kind, n_planes, n = struct.unpack_from("<BBI", payload, 4)
    sizes = plane_sizes(payload)
    at = 10 + 4 * n_planes
    octets = np.zeros((4, n), dtype=np.uint8)
    for p, size in enumerate(sizes):
        if size:
            plane = np.frombuffer(decompress(payload[at:at + size]), dtype=np.uint8)
            if KINDS[kind] == "bit":
                octets[p // 8] |= np.unpackbits(plane, count=n) << (p % 8)
            else:
                octets[p] = plane
            at += size
    return np.ascontiguousarray(octets.T).view("<u4").reshape(n)


class Pieces(dict):
    """Ids of pieces by key, learnt when first asked for.

    Two generations: when the first is half of ``CACHE``, it becomes the second, which is dropped.
    What is asked for again moves to the first, so frequent pieces stay, whatever rare ones come by.
    """

    def __init__(self, learn):
        self.learn, self.before = learn, {}

    def __missing__(self, key: bytes) -> bytes:
        ids = self.before.get(key)
        if ids is None:
            ids = self.learn(key)
        if 2 * PIECE_BYTES * len(self) > CACHE:
            self.before = dict(self)
            self.clear()
        self[key] = ids
        return ids


class PieceEncoder:
    """Ids of whole texts from the ids of their pieces.

    A byte-level BPE with the usual split pattern never lets a token cross from a
    character that isn't white space into white space. A text is therefore the
    concatenation of independent pieces, each a run of white space and what follows up to
    the next run. Pieces repeat, so their ids are kept, by the piece's UTF-8 bytes.

    Many texts are cut at once (``piece_starts``), and each distinct piece is looked up once
    for all of them. Letters, and marks behind them up to the piece's end, are tokens apart.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.known = Pieces(self.learn)
        self.packs = [struct.Struct(f"<{n}I").pack for n in range(32)]
        ws = ASCII_WS + OTHER_WS
        self.runs = re.compile(f"[{ws}]*[^{ws}]+|[{ws}]+")
        # The byte-level alphabet: printable Latin-1 characters stand for their own byte,
        # the other bytes follow from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in own]
        alphabet = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.alphabet = "".join(alphabet[b] for b in range(256))

    def _word(self, octets: bytes) -> bytes:
        """Ids of one word for the model, which takes it in its byte-level alphabet."""
        ids = [t.id for t in self.model.tokenize(codecs.charmap_decode(octets, "strict", self.alphabet)[0])]
        return self.packs[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, piece: bytes) -> bytes:
        if piece.isalpha() or piece[:1] == b" " and piece[1:].isalpha():
            return self._word(piece)
        literal = piece.decode()
        if m := WORD.fullmatch(literal):
            ws, letters, marks = (x.encode() for x in m.groups())
            if ws != b"\n" and not marks:
                return self._word(piece)
            # A line end before letters is a token of its own, and so are marks behind them.
            head = self.known[ws] + self.known[letters] if ws == b"\n" else self.known[ws + letters]
            return head + self.known[marks] if marks else head
        ids = self.tokenizer.encode(literal, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids; a very long text goes slice by slice."""
        if any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        out, pieces, ids_of = [], (m.group().encode() for m in self.runs.finditer(text)), self.known.__getitem__
        while part := list(islice(pieces, SLICE)):
            out.append(b"".join(map(ids_of, part)))
        return b"".join(out)

    def _encode_slice(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` of each text; those of no bytes, or null, have no ids."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        octets = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0]:at[-1]]
        at -= at[0]
        cuts = piece_starts(octets, np.unique(at[:-1][np.diff(at) > 0]))
        if not len(cuts):
            yield from (b"" for _ in range(len(texts)))
            return
        offsets = np.append(cuts, len(octets)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(octets)])
        pieces = pieces.dictionary_encode()
        codes, keys = pieces.indices.to_numpy(), pieces.dictionary
        held = memoryview(keys.buffers()[2]).tobytes()
        bounds = np.frombuffer(keys.buffers()[1], dtype=np.int32, count=len(keys) + 1).tolist()
        found = [*map(self.known.__getitem__, (held[a:b] for a, b in zip(bounds, bounds[1:])))]
        counts = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        begins, n = np.cumsum(counts) - counts, counts[codes]
        ends = np.cumsum(n)
        own = ids[np.repeat(begins[codes] - (ends - n), n) + np.arange(ends[-1])].tobytes()
        # Ids before each text's first piece.
        ends = np.append(0, ends)[np.searchsorted(cuts, at)].tolist()
        yield from (own[4 * a:4 * b] for a, b in zip(ends, ends[1:]))

    def encode_many(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` of each text (null: empty), some ``SLICE_BYTES`` of them at a time."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        alone = sizes > SLICE_BYTES
        for s in self.special:
            alone = alone | pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        first = held = 0
        for i, size in enumerate(sizes.tolist()):
            if alone[i] or held + size > SLICE_BYTES:
                yield from self._encode_slice(texts.slice(first, i - first)) if i > first else ()
                first, held = i, 0
                if alone[i]:
                    yield self.encode(texts[i].as_py())
                    first = i + 1
                    continue
            held += size
        if len(texts) > first:
            yield from self._encode_slice(texts.slice(first))


def _encoder(tokenizer_path: str) -> PieceEncoder:
    from tokenizers import Tokenizer

    # One tokenizer and one memory of pieces (``CACHE``) per Python worker, kept from task to task.
    kept = sys.modules.setdefault("_equiclass_encoders", type(sys)("_equiclass_encoders")).__dict__
    if tokenizer_path not in kept:
        kept[tokenizer_path] = PieceEncoder(Tokenizer.from_file(tokenizer_path))
    return kept[tokenizer_path]


def _writer(tokenizer_path: str, end_id: int, block_ids: int, kind: str, level: int):
    """Rows (doc_id, text) of one sorted shard -> its blocks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = _encoder(tokenizer_path).encode_many
        compress = zstandard.ZstdCompressor(level=level).compress
        end = struct.pack("<I", end_id)
        ids, docs = bytearray(), []  # ids from `base` on; documents that aren't over
        base = total = block = 0

        def cut(n: int) -> pa.RecordBatch:
            nonlocal base, block, docs
            payload = pack_block(np.frombuffer(bytes(ids[:4 * n]), dtype="<u4"), kind, compress)
            del ids[:4 * n]
            held, base = docs, base + n
            docs = [d for d in docs if d[1] + d[2] > base]
            held = [d for d in held if d[1] < base]
            block += 1
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "block": block - 1, "first": base - n, "n_ids": n,
                "plane_bytes": plane_sizes(payload), "payload_crc32": zlib.crc32(payload),
                "payload": payload, "doc_ids": [d[0] for d in held], "doc_starts": [d[1] for d in held],
                "doc_tokens": [d[2] for d in held]}], schema=BLOCK_ARROW)

        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                own += end
                docs.append((doc_id, total, len(own) // 4))
                total += len(own) // 4
                ids += own
                while len(ids) >= 4 * block_ids:
                    yield cut(block_ids)
        if ids:
            yield cut(len(ids) // 4)

    return write


BLOCK_SCHEMA = ("shard int, block int, first bigint, n_ids int, plane_bytes array<bigint>,"
                " payload_crc32 bigint, payload binary, doc_ids array<bigint>,"
                " doc_starts array<bigint>, doc_tokens array<bigint>")
BLOCK_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()),
    ("plane_bytes", pa.list_(pa.int64())), ("payload_crc32", pa.int64()), ("payload", pa.binary()),
    *((c, pa.list_(pa.int64())) for c in ("doc_ids", "doc_starts", "doc_tokens"))])


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 2,
                 block_ids: int = BLOCK_IDS, planes: str = "byte", level: int = 3,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of ``docs`` to a new store at ``path`` (on storage that all tasks reach)."""
    if planes not in KINDS or block_ids < 1:
        raise ValueError(f"planes must be one of {KINDS}, block_ids at least 1")
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    # The hash only splits an id that very many rows share.
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    blocks = ranged.select("doc_id", "text").mapInArrow(
        _writer(tokenizer_path, end_id, block_ids, planes, level), BLOCK_SCHEMA)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    _placed(spark, path).select(
        "shard", "block", (F.col("shard_start") + F.col("first")).alias("start"), "n_ids", "plane_bytes",
        "payload_crc32").write.parquet(f"{path}/index")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")


def _shard_starts(blocks: DataFrame) -> DataFrame:
    """shard, shard_start: one row per writing task (small, so one window over all is fine)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with their shard's start."""
    blocks = _blocks(spark, path)
    return blocks.join(F.broadcast(_shard_starts(blocks)), "shard")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def _reader(whole: bool):
    """Blocks -> the documents that lie in one block, or the pieces of those that don't."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                lo, hi = row["first"], row["first"] + row["n_ids"]
                found = [d for d in zip(row["doc_ids"], row["doc_starts"], row["doc_tokens"], strict=True)
                         if (d[1] >= lo and d[1] + d[2] <= hi) == whole]
                if not found:
                    continue
                if zlib.crc32(row["payload"]) != row["payload_crc32"]:
                    raise ValueError(f"block {row['block']} of shard {row['shard']} is damaged")
                octets = unpack_block(row["payload"], decompress).tobytes()
                at = [(max(s, lo) - lo, min(s + n, hi) - lo) for _, s, n in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array([d[0] for d in found], pa.int64()),
                    pa.array([d[1] + row["shard_start"] for d in found], pa.int64()),
                    pa.array([d[2] for d in found], pa.int64()),
                    pa.array([row["block"]] * len(found), pa.int32()),
                    pa.array([octets[4 * a:4 * b] for a, b in at], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "block", "ids"])

    return read


def _joined(pieces: pa.Table) -> pa.Table:
    """The pieces of one document -> the document."""
    pieces = pieces.sort_by("block")
    return pieces.slice(0, 1).select(["doc_id", "start", "n_tokens"]).append_column(
        "ids", pa.array([b"".join(x.as_py() for x in pieces.column("ids"))], pa.binary()))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (uint32, little-endian).

    A document is read from its block; only documents that cross a block's end are
    regrouped, each from its own pieces.
    """
    rows = _placed(spark, path).drop("plane_bytes")
    schema = "doc_id bigint, start bigint, n_tokens bigint, block int, ids binary"
    whole = rows.mapInArrow(_reader(True), schema).drop("block")
    split = rows.mapInArrow(_reader(False), schema).groupBy("start").applyInArrow(
        _joined, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
    return whole.unionByName(split)
