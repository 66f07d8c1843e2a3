"""Token-ID output as sorted-string-table shards.

File format (all integers little-endian unless said otherwise)::

    data blocks   entries in ascending key order, about BLOCK_BYTES each; an entry is
                  varint shared | varint unshared | varint value length | key suffix | value
                  where ``shared`` counts the bytes common with the previous key of the block
    index block   u32 count, then for each data block: u16 key length | first key | u64 offset | u32 length
    bloom block   u32 bits, u8 probes, bit array
    footer        u64 index offset | u32 index length | u64 bloom offset | u32 bloom length |
                  u64 documents | u64 tokens | u8 bytes of an id | magic ``LLSST1``

A key is ``00`` for a null identifier, else ``01`` and the 64-bit identifier, big-endian with the sign bit
flipped, so that byte order is numeric order. A value holds the ids as unsigned integers of 2 or 4 bytes.
A lookup asks the Bloom filter, finds the block by binary search over the index and reads one block (more if
equal keys go on in the next).

Shards are the ranges that Spark's range partitioning makes of (identifier, hash of the text, number of the row), one partition a
shard, so shard after shard gives all documents in ascending order, and an identifier with very many rows, equal ones too, is spread
over several shards.

Results for special input: a null or empty text has only the end id; null identifiers come first; rows
with equal identifiers are all kept, ordered by the hash of their text; an empty table gives no shard.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.byte_bpe import GenerationCache
from ledgerloom.llm.textkit import slices, text_buffers, text_volume, tidy, workspace, written

BLOCK_BYTES = 64 << 10
#: Bytes of text for which one shard is made.
SHARD_TEXT_BYTES = 16 << 20
BLOOM_BITS, BLOOM_PROBES = 10, 7
MAGIC = b"LLSST1"
FOOTER = struct.Struct("<QIQIQQB6s")
WORDS_CACHED = 24 << 20
#: Small letters of ASCII and Latin-1 as UTF-8: composed, lower-case and letters under every Unicode version.
LETTERS = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"
#: The same letters in either case, and the ASCII marks behind them.
TWO_PARTS = r"^(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: Bytes of text whose distinct words are found together.
ENCODED = 16 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, probes: int):
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b + i * i * i) % bits for i in range(probes)]


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class TableWriter:
    """Streams entries in key order into one shard; holds a block, the sparse index and the keys' probes."""

    def __init__(self, path: str, width: int):
        self.system, self.path = _open(path)
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.width = self.system.open_output_stream(self.part), width
        self.block, self.at, self.first, self.last = bytearray(), 0, b"", b""
        self.index, self.keys, self.documents, self.tokens = [], [], 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must come in ascending order")
        if not self.block:
            self.first, shared = key, 0
        else:
            shared = len(os.path.commonprefix([self.last, key]))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last, self.documents, self.tokens = key, self.documents + 1, self.tokens + len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append((self.first, self.at, len(self.block)))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = struct.pack("<I", len(self.index)) + b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QI", o, n) for k, o, n in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for k in self.keys:
            for p in _probes(k, bits, BLOOM_PROBES):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom = struct.pack("<IB", bits, BLOOM_PROBES) + bytes(bloom)
        self.out.write(index + bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.documents, self.tokens, self.width, MAGIC))
        self.out.close()
        self.system.move(self.part, self.path)  # a repeated attempt replaces the file with the same bytes


class TableReader:
    """Binary-search lookup and ordered scan of one shard."""

    def __init__(self, path: str):
        system, where = _open(path)
        self.file = system.open_input_file(where)
        size = self.file.size()
        at, n, bloom_at, bloom_n, self.documents, self.tokens, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token table")
        raw, pos, self.index = self._read(at, n), 4, []
        for _ in range(struct.unpack_from("<I", raw)[0]):
            size = struct.unpack_from("<H", raw, pos)[0]
            key = raw[pos + 2 : pos + 2 + size]
            self.index.append((key, *struct.unpack_from("<QI", raw, pos + 2 + size)))
            pos += 14 + size
        raw = self._read(bloom_at, bloom_n)
        (self.bits, self.n_probes), self.bloom = struct.unpack_from("<IB", raw), raw[5:]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, at: int, n: int):
        raw, pos, key = self._read(at, n), 0, b""
        while pos < n:
            shared, pos = _read_varint(raw, pos)
            own, pos = _read_varint(raw, pos)
            size, pos = _read_varint(raw, pos)
            key = key[:shared] + raw[pos : pos + own]
            yield key, raw[pos + own : pos + own + size]
            pos += own + size

    def scan(self):
        """(identifier, ids) of all entries in order."""
        kind = np.uint16 if self.width == 2 else np.uint32
        for _, at, n in self.index:
            for key, value in self._entries(at, n):
                yield id_of(key), np.frombuffer(value, kind)

    def may_have(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id), self.bits, self.n_probes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this identifier (none: an empty list)."""
        if not self.may_have(doc_id):
            return []
        key, firsts, out = key_of(doc_id), [k for k, _, _ in self.index], []
        kind = np.uint16 if self.width == 2 else np.uint32
        for _, at, n in self.index[max(0, bisect_left(firsts, key) - 1) : bisect_right(firsts, key)]:
            out += [np.frombuffer(v, kind) for k, v in self._entries(at, n) if k == key]
        return out


# The steps before the model (normaliser, pre-tokenizer, none after) under which encoding by words is exact.
_STEPS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    None,
]


class WordEncoder:
    """Ids by the ``tokenizers`` library.

    The vocabulary drops white space, never joins characters over it and lower-cases, so texts are encoded word by word. Arrow cuts the
    texts of a batch into words and finds the distinct ones. Of a word that is letters of ``LETTERS`` in either case and then ASCII marks (no digit or
    apostrophe) both parts are encoded on their own, since the pre-tokenizer cuts between them; the ids of recurring parts come from a table
    of bounded size. All other words go to the library as they are. A tokenizer file with other steps before the model is used for whole texts instead.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        told = json.loads(Path(path).read_text())
        self.by_words = [told["normalizer"], told["pre_tokenizer"], told["post_processor"]] == _STEPS and not any(t["normalized"] for t in told["added_tokens"])
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.code, self.cache = (np.uint16, "H", GenerationCache(WORDS_CACHED)) if self.width == 2 else (np.uint32, "I", GenerationCache(WORDS_CACHED))
        self.letters, self.tokenize = re.compile(LETTERS).fullmatch, self.library.model.tokenize
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in plain]
        #: the vocabulary's character for each byte that is not its own
        self.characters = {b: 256 + i for i, b in enumerate(others)}

    def _encode_part(self, part: bytes) -> bytes:
        """Normal letters go straight to the library's model: the steps before it would leave them alone."""
        if self.letters(part):
            text = part.decode("latin-1")
            return array(self.code, [t.id for t in self.tokenize(text if part.isascii() else text.translate(self.characters))]).tobytes()
        return self._encode_whole(part)

    def _encode_whole(self, text: bytes) -> bytes:
        return array(self.code, self.library.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def _encode_distinct(self, words: pa.Array) -> pa.Array:
        """The ids of each word as bytes."""
        cut = pc.extract_regex(words, TWO_PARTS)
        own = pc.coalesce(pc.utf8_lower(pc.struct_field(cut, "letters")), words)
        parts = pa.concat_arrays([own, pc.struct_field(cut, "marks").fill_null("")]).dictionary_encode()
        data, offs = text_buffers(parts.dictionary)
        raw, offs = data.tobytes(), offs.tolist()
        ids = pa.array(self.cache.fill([raw[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)], lambda keys: list(map(self._encode_part, keys))), pa.large_binary())
        return pc.binary_join_element_wise(ids.take(parts.indices[: len(words)]), ids.take(parts.indices[len(words) :]), pa.scalar(b"", pa.large_binary()))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as bytes; null counts as empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("")
        # an added token may hold a blank or reach over one
        whole = pc.match_substring(texts, "<|") if self.by_words else pa.array(np.ones(len(texts), bool))
        lists = pc.ascii_split_whitespace(pc.if_else(whole, "", texts))
        words = lists.flatten().dictionary_encode()
        ids = self._encode_distinct(words.dictionary).take(words.indices)
        _, ends, data = ids.buffers()
        raw = memoryview(data or b"")
        cuts = np.frombuffer(ends, np.int64)[np.append(0, np.cumsum(lists.value_lengths()))].tolist()
        out = [raw[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._encode_whole(texts[i].as_py().encode())
        return out

    def encode(self, text: bytes) -> bytes:
        return self.encode_all(pa.array([text.decode()]))[0]


_LOADED: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def write_tables(df: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and write shards. Returns the manifest: one row a shard with
    (shard, path, n_docs, n_tokens, start), ``start`` being the ids of all shards before it.

    Texts are shuffled once; each partition is encoded and written in one pass, and only the manifest's rows come back.
    """
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    shards = max(1, -(-text_volume(df.select(text.alias("text")), "text") // SHARD_TEXT_BYTES))
    order = [F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("row")]
    rows = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches):
        enc, at, writer = _encoder(tokenizer_path), TaskContext.get().partitionId(), None
        path, tail = f"{folder}/shard-{at:08d}.sst", np.array([end_id], enc.kind).tobytes()
        for batch in batches:
            for part in slices(batch, "text", ENCODED):
                for key, ids in zip(part.column(0).to_pylist(), enc.encode_all(part.column(1)), strict=True):
                    writer = writer or TableWriter(path, enc.width)
                    writer.add(key_of(key), ids + tail)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([path]), pa.array([writer.documents], pa.int64()), pa.array([writer.tokens], pa.int64())], names=["shard", "path", "n_docs", "n_tokens"])

    manifest = written(rows.mapInArrow(tidy(write), "shard int, path string, n_docs long, n_tokens long"), folder, "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tables(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of all entries of the shards, read from the files; ``start`` counts the ids before."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = ([], [], []), 0
                for doc_id, ids in TableReader(path).scan():
                    for c, v in zip(rows, (doc_id, start, ids.astype(np.int32)), strict=True):
                        c.append(v)
                    start, size = start + len(ids), size + len(ids)
                    if size > 1 << 18:
                        yield _batch(rows)
                        rows, size = ([], [], []), 0
                if rows[0]:
                    yield _batch(rows)

    def _batch(rows):
        offs = np.zeros(len(rows[2]) + 1, np.int32)
        np.cumsum([len(x) for x in rows[2]], out=offs[1:])
        lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(rows[2])))
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), lists], names=["doc_id", "start", "ids"])

    n = max(1, manifest.count())
    return manifest.select("path", "start", "shard").repartitionByRange(n, "shard").select("path", "start").mapInArrow(tidy(read), "doc_id long, start long, ids array<int>")


def token_digests(tables: DataFrame) -> DataFrame:
    """Length and crc32 (over the ids as little-endian unsigned 32-bit integers) of each document's ids."""

    def digest(batches):
        for batch in batches:
            lists = batch.column(2)
            flat, offs = lists.values.to_numpy(zero_copy_only=False).astype(np.uint32).tobytes(), lists.offsets.to_numpy().astype(np.int64) * 4
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offs) // 4, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tables.mapInArrow(tidy(digest), "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_folder(df: DataFrame) -> str:
    return workspace(df.sparkSession)


__all__ = ["TableReader", "TableWriter", "default_folder", "read_tables", "slices", "token_digests", "write_tables"]
