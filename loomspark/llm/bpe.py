"""Byte-pair encoding by a segment tree over adjacent pair ranks, for tokenizer files with word ends.

Words are independent once white space is dropped, so each worker keeps a bounded memo of encoded words.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.common import tidy

#: The white space that the tokenizer's patterns know; fixed by Unicode.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(rf"[{SPACE}]")
_NONE = 1 << 62


class PairRanks:
    """Ranks of symbol pairs in an open-addressed table, looked up for whole arrays."""

    def __init__(self, ranks: dict[int, int]) -> None:
        self.bits = max(8, (4 * len(ranks)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        homes = self._home(np.fromiter(ranks, np.int64, len(ranks)))
        for key, rank, at in zip(ranks, ranks.values(), homes.tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ranks[at] = key, rank

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it doesn't merge."""
        keys = first.astype(np.int64) << 32 | second.astype(np.int64)
        at = self._home(keys)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(todo):
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out


class ChunkMemo:
    """Encodes texts chunk by chunk between white space, with a memo of two generations: what is used stays, what isn't
    goes when the younger one is full. Ids are held as little-endian bytes, which keeps the memo small.

    Texts are split and their chunks made distinct by Arrow, so Python only sees each distinct chunk of a stretch of
    texts once, and NumPy puts the texts' ids together.
    """

    #: Separators that Arrow and str.split() take for white space and such tokenizers do not.
    ODD = "\x1c\x1d\x1e\x1f"

    def __init__(self, memo: int, ids: int) -> None:
        self.memo, self.chunks, self.old_chunks = memo, {}, {}
        self.kind = np.dtype("<u2" if ids <= 1 << 16 else "<u4")

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks that neither generation holds."""
        raise NotImplementedError

    def _whole(self, text: str) -> bytes:
        """Ids of a text that holds special tokens or odd separators."""
        raise NotImplementedError

    def encode_batch(self, texts: Iterable[str], chars: int = 1 << 21) -> Iterator[np.ndarray]:
        """Ids of each whole text, in order. The distinct chunks of about `chars` characters are looked up together."""
        held: list[str] = []
        size, collecting = 0, gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the collector would walk the memo again and again
        try:
            for text in texts:
                held.append(text)
                size += len(text)
                if size >= chars:
                    yield from self._encoded(held)
                    held, size = [], 0
            yield from self._encoded(held)
        finally:
            if collecting:
                gc.enable()

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        apart = {n: self._whole(t) for n, t in enumerate(texts) if "<|" in t or any(c in t for c in self.ODD)}
        lists = pc.utf8_split_whitespace(pa.array(["" if n in apart else t for n, t in enumerate(texts)], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        known = list(self.known(coded.dictionary.to_pylist()).values())
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
        pool, starts = np.frombuffer(b"".join(known), self.kind), np.cumsum(lengths) - lengths
        chunks = coded.indices.to_numpy()
        each = lengths[chunks]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(starts[chunks] - ends[:-1], each) + np.arange(ends[-1])]
        cuts = ends[lists.offsets.to_numpy()].tolist()
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            yield np.frombuffer(apart[n], self.kind) if n in apart else ids[a:b]

    def known(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks, in their order."""
        found = dict(zip(chunks, map(self.chunks.get, chunks), strict=True))
        old, fresh, missing = self.old_chunks.get, {}, []
        for c in [c for c, ids in found.items() if ids is None]:
            if not c:
                fresh[c] = b""
            elif (ids := old(c)) is None:
                missing.append(c)
            else:
                fresh[c] = ids
        if missing:
            fresh.update(self._learn(missing))
        found.update(fresh)
        if len(self.chunks) >= self.memo:
            self.old_chunks, self.chunks = self.chunks, {}
        self.chunks.update((c, ids) for c, ids in fresh.items() if len(c) <= 64)
        return found


class WordBpe(ChunkMemo):
    """A BPE model from a tokenizer file, or its bytes: lower-casing, white space dropped, byte alphabet, word-end suffix."""

    def __init__(self, source: str | bytes, memo: int = 100_000) -> None:
        spec = json.loads(source if isinstance(source, bytes) else file_bytes(source))
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.decimals = [str(i) for i in range(len(self.names))]
        super().__init__(memo, len(self.names))
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.ranks = PairRanks({vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in reversed(list(enumerate(pairs)))})
        alphabet = byte_alphabet()
        self.inner, self.last = (np.array([vocab[c + e] for c in alphabet], np.int64) for e in ("", end))
        inside = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(inside.replace(r"\s", SPACE))
        self.stop = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.tokens, self.old_tokens = {}, {}

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Ids of many words of symbols, each merged until no mergeable pair is left.

        Every word has a segment tree whose leaves hold rank and place of its adjacent pairs, so its root is the
        leftmost merge of the lowest rank; a merge rewrites three leaves and the paths above them. Words of about
        the same length are worked on side by side, a row of an array each: a word of n symbols takes n log n steps.
        """
        ends = np.cumsum(lengths)
        out: list[bytes] = [b""] * len(lengths)
        sizes = 1 << np.ceil(np.log2(np.maximum(2, lengths))).astype(np.int64)
        for size in np.unique(sizes).tolist():
            group = np.flatnonzero(sizes == size)
            step = max(1, (1 << 20) // size)
            for i in range(0, len(group), step):
                some = group[i : i + step]
                for j, ids in zip(some.tolist(), self._merge_rows(symbols, ends[some] - lengths[some], lengths[some], size), strict=True):
                    out[j] = ids
        return out

    def _merge_rows(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> list[bytes]:
        n = len(lengths)
        row, place = np.repeat(np.arange(n), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbols = np.full((n, size + 1), -1, np.int64)
        symbols[row, place] = flat[np.repeat(starts, lengths) + place]
        after, before = np.tile(np.arange(1, size + 2), (n, 1)), np.tile(np.arange(-1, size), (n, 1))
        tree = np.full((n, 2 * size), _NONE, np.int64)
        inner = place + 1 < lengths[row]
        r, p = row[inner], place[inner]
        rank = self.ranks.get(symbols[r, p], symbols[r, p + 1])
        tree[r, size + p] = np.where(rank < 0, _NONE, rank << 32 | p)
        k = size
        while k > 1:
            k //= 2
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        live = np.flatnonzero(tree[:, 1] != _NONE)
        while len(live):
            root = tree[live, 1]
            i = root & 0xFFFFFFFF
            j = after[live, i]
            k, p, made = after[live, j], before[live, i], self.made[root >> 32]
            symbols[live, i], symbols[live, j], after[live, i], before[live, k] = made, -1, k, i
            tree[live, size + j] = _NONE  # the last symbol's leaf is empty anyway
            right = k < lengths[live]
            value = np.full(len(live), _NONE, np.int64)
            rank = self.ranks.get(made[right], symbols[live[right], k[right]])
            value[right] = np.where(rank < 0, _NONE, rank << 32 | i[right])
            tree[live, size + i] = value
            left = p >= 0
            rank = self.ranks.get(symbols[live[left], p[left]], made[left])
            tree[live[left], size + p[left]] = np.where(rank < 0, _NONE, rank << 32 | p[left])
            for rows, at in ((live, size + i), (live, size + j), (live[left], size + p[left])):
                for _ in range(size.bit_length() - 1):
                    at = at >> 1
                    tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            live = live[tree[live, 1] != _NONE]
        keep = symbols >= 0
        data, width = symbols[keep].astype(self.kind).tobytes(), self.kind.itemsize
        cuts = (np.cumsum(keep.sum(axis=1)) * width).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _learn_tokens(self, tokens: list[str]) -> None:
        """Put distinct pre-tokens into the memo."""
        data = [t.encode("utf-8", "surrogatepass") for t in tokens]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        symbols, ends = self.inner[raw], np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        self.tokens.update(zip(tokens, self.merge(symbols, lengths), strict=True))

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        split = {c: self.pattern.findall(normalize("NFC", c).replace("Σ", "σ").lower()) for c in chunks}
        if len(self.tokens) >= self.memo:
            self.old_tokens, self.tokens = self.tokens, {}
        tokens, unknown = self.tokens, {}
        for pieces in split.values():
            for w in pieces:
                if w not in tokens:
                    if (ids := self.old_tokens.get(w)) is not None:
                        tokens[w] = ids
                    else:
                        unknown[w] = None
        if unknown:
            self._learn_tokens(list(unknown))
        get = tokens.__getitem__
        out = {c: get(pieces[0]) if len(pieces) == 1 else b"".join(map(get, pieces)) for c, pieces in split.items()}
        for w in unknown:
            if len(w) > 64:
                del tokens[w]
        return out

    def _whole(self, text: str) -> bytes:
        spans = [(text, None)]
        if self.stop is not None:
            spans, at = [], 0
            for m in self.stop.finditer(text):
                spans += [(text[at : m.start()], None), ("", m[0])]
                at = m.end()
            spans.append((text[at:], None))
        out = []
        for part, token in spans:
            chunks = [c for c in _SPLIT.split(part) if c]
            known = self.known(list(dict.fromkeys(chunks)))
            out += [known[c] for c in chunks] if token is None else [np.array([self.special[token]], self.kind).tobytes()]
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text])).tolist()

    def decode(self, ids: list[int]) -> str:
        """Token names joined by a space, as a tokenizer without a decoder does."""
        return " ".join(map(self.names.__getitem__, ids))


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where it is visible Latin-1, else the next one from U+0100 on."""
    seen, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            seen.append(chr(b))
        else:
            seen.append(chr(256 + extra))
            extra += 1
    return seen


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def load(source: bytes) -> WordBpe:
    """One model a worker process. The driver's file is sent out as bytes, so executors need no path to it."""
    return WordBpe(source)


def _digests(model: WordBpe, ids: np.ndarray) -> tuple[int, str, str]:
    numbers, decoded = hashlib.sha256(), hashlib.sha256()
    for i in range(0, len(ids), 1 << 18):
        some, lead = ids[i : i + (1 << 18)].tolist(), " " if i else ""
        numbers.update((lead + " ".join(map(model.decimals.__getitem__, some))).encode())
        decoded.update((lead + model.decode(some)).encode())
    return len(ids), numbers.hexdigest(), decoded.hexdigest()


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, n_tokens long, ids_sha256, decoded_sha256), one row for each input row; a null text is empty.

    Repeated rows and null ids each give their own row; texts of any length are encoded whole; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(file_bytes(path))  # a vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(held.value)
        for batch in batches:
            made = [_digests(model, ids) for ids in model.encode_batch(x.as_py() or "" for x in batch.column(1))]
            cols = list(zip(*made, strict=True)) if made else [[], [], []]
            tidy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, path: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with an array<int> column of token ids (a null text gives an empty array); a column of that name is replaced.

    Every row keeps its other columns; repeated rows each have their ids, texts of any length are encoded whole, an empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast(file_bytes(path))  # a vocabulary file

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(text: pa.Array) -> pa.Array:
        made = [x.astype(np.int32) for x in load(held.value).encode_batch((t.as_py() or "" for t in text), 1 << 20)]
        ends = np.cumsum([0, *map(len, made)])
        flat = np.concatenate([np.zeros(0, np.int32), *made])
        del made
        tidy()
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return docs.withColumn(out, ids(F.col(text_col)))
