"""Token ids in sorted-string-table shards.

A shard is a file of blocks, a block index, a Bloom filter and a footer. A block holds records in key order; each key
is stored as the length it shares with the key before it and the rest, every 16th whole; the places of the whole ones
stand at the block's end, so a search within it starts at the right one. A record's value is the document's ids as 16-
or 32-bit little-endian numbers. Blocks are compressed one by one. The sparse index names every block's first key, the
manifest every shard's first and last, so a lookup opens the shards that can hold a key and, if the filter agrees, reads
one run of blocks.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from unicodedata import is_normalized
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.bpe import ChunkMemo, byte_alphabet, file_bytes

MAGIC = b"LOOMSST2"
_FOOTER = struct.Struct("<QQQQQQB8s")  # index at and size, filter at and size, records, ids, width of an id, magic
_RESTART = 16
_CODEC = pa.Codec("zstd", compression_level=1)


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do, null last."""
    return b"\x01" if doc_id is None else b"\x00" + ((doc_id + (1 << 63)) & (1 << 64) - 1).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\x01" else int.from_bytes(key[1:], "big") - (1 << 63)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI; shared mounts come as file:."""
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


class Bloom:
    """A Bloom filter over key bytes: bits and seven probes from two halves of one 128-bit hash."""

    PROBES = 7

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def _places(key: bytes, size: int) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key)
        a, b = h >> 64, h & (1 << 64) - 1 | 1
        return [(a + i * b) % size for i in range(Bloom.PROBES)]

    @classmethod
    def of(cls, keys: list[bytes], bits_per_key: int = 10) -> Bloom:
        size = max(64, -(-len(keys) * bits_per_key // 8) * 8)
        bits = np.zeros(size, np.uint8)
        for k in keys:
            bits[cls._places(k, size)] = 1
        return cls(bits)

    def __contains__(self, key: bytes) -> bool:
        return bool(self.bits[self._places(key, len(self.bits))].all())


class ShardWriter:
    """Writes one shard; records must come in key order, equal keys next to each other."""

    def __init__(self, out, width: int, block_bytes: int = 1 << 18) -> None:
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.at = self.records = self.ids = self.count = 0
        self.block, self.index, self.keys, self.last, self.first, self.restarts = bytearray(), [], [], b"", b"", []

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key < self.last and self.records:
            raise ValueError("keys out of order")
        shared = 0 if self.count % _RESTART == 0 else len(os.path.commonprefix([self.last, key]))
        if not self.count:
            self.first = key
        if self.count % _RESTART == 0:
            self.restarts.append(len(self.block))
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(value)) + value
        self.last, self.count, self.records, self.ids = key, self.count + 1, self.records + 1, self.ids + len(ids)
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        self.block += struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        data = _CODEC.compress(bytes(self.block), asbytes=True)
        self.out.write(data)
        self.index.append((self.first, self.at, len(data), len(self.block)))
        self.at += len(data)
        self.block, self.count, self.restarts = bytearray(), 0, []

    def close(self) -> None:
        if self.block:
            self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) + _varint(raw) for k, at, n, raw in self.index)
        bloom = np.packbits(Bloom.of(self.keys).bits).tobytes()
        self.out.write(index + bloom)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.records, self.ids, self.width, MAGIC))


class Shard:
    """Reads one shard: in order block by block, or one key by Bloom filter, binary search and a single block."""

    def __init__(self, path: str) -> None:
        system, local = file_system(path)
        self.file = system.open_input_file(local)
        size = self.file.size()
        index_at, index_size, bloom_at, bloom_size, self.records, self.ids, self.width, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        raw, at, self.index = self.file.read_at(index_size, index_at), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key = raw[at : at + n]
            start, at = _read_varint(raw, at + n)
            length, at = _read_varint(raw, at)
            whole, at = _read_varint(raw, at)
            self.index.append((key, start, length, whole))
        self.bloom = Bloom(np.unpackbits(np.frombuffer(self.file.read_at(bloom_size, bloom_at), np.uint8)))

    def _read(self, start: int, length: int, whole: int) -> tuple[bytes, list[int]]:
        """A block's records and the places of its whole keys."""
        data = _CODEC.decompress(self.file.read_at(length, start), whole, asbytes=True)
        (n,) = struct.unpack_from("<I", data, len(data) - 4)
        end = len(data) - 4 * (n + 1)
        return data[:end], list(struct.unpack_from(f"<{n}I", data, end))

    def _records(self, data: bytes, at: int = 0) -> Iterator[tuple[bytes, np.ndarray]]:
        """Records from a whole key on."""
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + n]
            size, at = _read_varint(data, at + n)
            yield key, np.frombuffer(data, "<u2" if self.width == 2 else "<u4", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for _, *place in self.index:
            yield from self._records(self._read(*place)[0])

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every record with this key; none if it isn't there."""
        key, found = key_of(doc_id), []
        if key not in self.bloom:
            return found
        at = max(0, bisect_left(self.index, (key,)) - 1)
        for first, *place in self.index[at:]:
            if first > key:
                break
            data, restarts = self._read(*place)
            # the last whole key below the wanted one; equal keys may begin before the first whole one that equals it
            start = max(0, bisect_left(restarts, key, key=lambda at: next(self._records(data, at))[0]) - 1)
            for k, ids in self._records(data, restarts[start]):
                if k > key:
                    break
                if k == key:
                    found.append(ids)
        return found


@lru_cache(maxsize=2)
def _tokenizer(source: str | bytes):
    from tokenizers import Tokenizer

    made = Tokenizer.from_buffer(source) if isinstance(source, bytes) else Tokenizer.from_file(source)
    made.no_padding()
    made.no_truncation()
    return made


class WordEncoder(ChunkMemo):
    """The tokenizers library over chunks between white space.

    For byte-level tokenizers that drop white space before they split words and lower-case them, so that chunks don't
    touch each other's tokens. The library gets every distinct word once while the memo holds it: a word's ids don't
    depend on its case or on points and commas after it, which are looked up on their own. Other chunks go through
    the library's whole chain, and texts with special tokens or separators that only str.split() knows as they are.
    """

    def __init__(self, source: str | bytes, memo: int = 500_000) -> None:
        self.lib = _tokenizer(source)
        super().__init__(memo, self.lib.get_vocab_size())
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.words, self.old_words = {}, {}

    def _ids(self, ids: list[int]) -> bytes:
        return array("H" if self.kind.itemsize == 2 else "I", ids).tobytes()

    def _word(self, low: str) -> bytes:
        """Ids of lower-cased letters in composed form, from the library's model."""
        data = low if low.isascii() else low.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
        return self._ids([t.id for t in self.lib.model.tokenize(data)])

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        if len(self.words) >= self.memo:
            self.old_words, self.words = self.words, {}
        words, old_words, out, whole = self.words, self.old_words.get, {}, []
        for c in chunks:
            base = c.rstrip(".,")
            low = base.lower()
            if not low.isalpha() or not low.isascii() and ("\u03a3" in base or not is_normalized("NFC", low)):
                whole.append(c)
                continue
            if (ids := words.get(low)) is None:
                if (ids := old_words(low)) is None:
                    ids = self._word(low)
                if len(low) <= 64:
                    words[low] = ids
            if len(base) < len(c):
                signs = c[len(base) :]
                if (more := words.get(signs)) is None:
                    more = words[signs] = self._ids(self.lib.encode(signs, add_special_tokens=False).ids)
                ids += more
            out[c] = ids
        for c, e in zip(whole, self.lib.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            out[c] = self._ids(e.ids)
        return out

    def _whole(self, text: str) -> bytes:
        return self._ids(self.lib.encode(text, add_special_tokens=False).ids)


class TextEncoder:
    """The tokenizers library over whole texts, for tokenizers that WordEncoder's conditions exclude; several times slower."""

    def __init__(self, source: str | bytes) -> None:
        self.lib = _tokenizer(source)
        self.kind = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")

    def encode_batch(self, texts: Iterable[str], chars: int = 1 << 21) -> Iterator[np.ndarray]:
        for text in texts:
            yield np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind)


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", whole_texts: bool = False) -> list[dict]:
    """Encode every text, append end_id, and write shards in id order under `out`; returns the manifest's shards.

    Rows are dealt out by ranges of (id, hash of the text), one shard a range, so rows that share an id, or have none,
    spread as well; they stand in the order of these hashes, null ids come last, a null text is empty, a long one is
    encoded whole, other columns are not read. An empty table gives a manifest without shards. whole_texts sends texts
    through the library as they are instead of word by word. A task writes under a name of its own and renames the finished
    file, and manifest.json, written last, names the files that count: a lost or repeated task leaves nothing half done.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = [F.col("id").asc_nulls_last(), F.col("mark")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    held = spark.sparkContext.broadcast(file_bytes(tokenizer))  # a vocabulary file
    system, folder = file_system(out)
    system.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(out)
        part = TaskContext.get().partitionId()
        encoder = TextEncoder(held.value) if whole_texts else WordEncoder(held.value)
        end = np.array([] if end_id is None else [end_id], encoder.kind)
        name, writer, stream = f"{base}/shard-{part:06d}.sst", None, None
        for batch in batches:
            encoded = encoder.encode_batch((t.as_py() for t in batch.column(1)), 1 << 24)
            for i, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                if writer is None:
                    attempt = f"{base}/.writing-{part:06d}-{uuid.uuid4().hex}"
                    stream = store.open_output_stream(attempt)
                    writer = ShardWriter(stream, encoder.kind.itemsize)
                writer.add(key_of(i), np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            stream.close()
            store.move(attempt, name)
            columns = [[part], [os.path.basename(name)], [writer.records], [writer.ids], [writer.keys[0].hex()], [writer.last.hex()]]
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "name", "records", "ids", "first", "last"])

    # one row a shard
    made = sorted(ordered.mapInArrow(run, "part int, name string, records long, ids long, first string, last string").collect(), key=lambda r: r["part"])
    shards, start = [], 0
    for r in made:
        shards.append({"name": r["name"], "records": r["records"], "ids": r["ids"], "start": start, "first": r["first"], "last": r["last"]})
        start += r["ids"]
    with system.open_output_stream(f"{folder}/.manifest") as f:
        f.write(json.dumps({"format": MAGIC.decode(), "tokenizer": os.path.basename(tokenizer), "end_id": end_id, "shards": shards}).encode())
    system.move(f"{folder}/.manifest", f"{folder}/manifest.json")
    return shards


def read_tokens(spark: SparkSession, path: str, use: Callable[[int | None, int, np.ndarray], tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    """One row of use(id, ids before it, ids) for each record of all shards, read from the files in order."""
    system, folder = file_system(path)
    with system.open_input_stream(f"{folder}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]
    listed = spark.createDataFrame([(s["name"], s["start"]) for s in shards], "name string, start long")
    if shards:
        listed = listed.repartition(len(shards), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for key, ids in Shard(f"{path}/{name}"):
                    rows.append(use(id_of(key), start, ids))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    return listed.mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def lookup(path: str, doc_id: int | None) -> list[np.ndarray]:
    """Ids of one document from a folder of shards: only shards whose range of keys holds it are opened."""
    system, folder = file_system(path)
    with system.open_input_stream(f"{folder}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]
    key, found = key_of(doc_id).hex(), []
    for s in shards[bisect_left(shards, key, key=lambda s: s["last"]) :]:
        if s["first"] > key:
            break
        found += Shard(f"{path}/{s['name']}").get(doc_id)
    return found
