"""Byte-level BPE from a file of ranks: the tokenizers library over Arrow batches, with character offsets and decoding.

The library sees texts through the byte alphabet: each byte of a text is one printable character, and a token is a string
of these. Offsets lead back to the characters of the text; decoding turns token characters into bytes again.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

from loomspark.llm.bpe import SPACE, byte_alphabet, file_bytes
from loomspark.llm.common import named, tidy

#: Characters of a text that are encoded at once.
STRETCH = 1 << 19
#: Separators that Python takes for white space and the pattern doesn't.
ODD = "\x1c\x1d\x1e\x1f"
_CHUNK, _EDGE = re.compile(r"\s*\S+|\s+"), re.compile(r"(?<=\S)\s")
_ODD_CHUNK, _ODD_EDGE = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"), re.compile(rf"(?<=[^{SPACE}])[{SPACE}]")
#: What an id that the file doesn't know decodes to, U+FFFD.
UNKNOWN = b"\xef\xbf\xbd"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> id, of lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that token is merged from, when only merges of lower ranks have been made."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, ranks[token]), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= ranks[token]:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def library_model(path: str, pattern: str) -> str:
    """The file of ranks as the library's own JSON, made once on the driver.

    A pair of neighbours that can become a token when all lower ranks are spent is always the pair that the token by
    itself ends with, so one merge a token gives the rank file's results. Tokens that no merge reaches count as whole matches only.
    """
    ranks = parse_ranks(file_bytes(path))
    shown = byte_alphabet()
    show = lambda token: "".join(map(shown.__getitem__, token))
    pairs = (_last_merge(t, ranks) for t in sorted(ranks, key=ranks.__getitem__) if len(t) > 1)
    made = Tokenizer(BPE({show(t): i for t, i in ranks.items()}, [(show(p[0]), show(p[1])) for p in pairs if p], ignore_merges=True))
    made.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


class Memo(dict):
    """What make(key) gives, kept in two generations: what is used stays, what isn't goes when the younger one is full."""

    def __init__(self, make: Callable, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class ByteBpe:
    """The library's BPE model on matches of the pattern, written in the byte alphabet.

    Texts are walked chunk by chunk, a run of white space and what follows up to the next run: a match never goes from
    other characters on into white space, so chunks are independent and can be remembered. Only distinct chunks are
    matched by the pattern, and only distinct matches go to the library.
    """

    def __init__(self, model: str, memo: int = 250_000) -> None:
        spec, shown = json.loads(model), byte_alphabet()
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.model, self.latin = Tokenizer.from_str(model).model, str.maketrans(dict(enumerate(shown)))
        self.chunks, self.matches, self.places = Memo(self._chunk, memo), Memo(self._match, memo), Memo(self._places, memo)
        of_char, vocab = {c: b for b, c in enumerate(shown)}, spec["model"]["vocab"]
        self.bytes = [UNKNOWN] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(of_char.__getitem__, token))
        self.decimals = [str(i) for i in range(len(self.bytes))]
        self.kind = np.dtype("<u2" if len(self.bytes) <= 1 << 16 else "<u4")

    def _match(self, match: str) -> bytes:
        """Ids of a match, as little-endian bytes."""
        shown = match.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.latin)
        return array(self.kind.char, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk[0] == " " and chunk[1:].isalpha() and chunk.isascii():
            return self._match(chunk)  # the commonest kind is one match
        return b"".join(map(self.matches.__getitem__, self.pattern.findall(chunk)))

    def _places(self, chunk: str) -> np.ndarray:
        """Ids of a chunk, and the first and next character of each, counted from the chunk's start."""
        ids = np.frombuffer(self.chunks[chunk], self.kind).astype(np.int32)
        data = np.frombuffer(chunk.encode("utf-8", "surrogatepass"), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum([len(self.bytes[i]) for i in ids])
        starts = np.concatenate([[0], ends[:-1]])
        return np.array([ids, char[starts], char[ends - 1] + 1], np.int32)

    def _stretches(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """Chunks of a text with the place of the first, in lists of about STRETCH characters.

        A chunk that is longer, as in scripts without spaces, is cut where one of its matches starts, though not after
        white space, whose matches depend on what follows.
        """
        odd = any(c in text for c in ODD)
        chunk, edges, at = (_ODD_CHUNK if odd else _CHUNK), (_ODD_EDGE if odd else _EDGE), 0
        while at < len(text):
            edge = edges.search(text, at + STRETCH) if at + STRETCH < len(text) else None
            end = edge.start() if edge else len(text)
            if end - at <= 2 * STRETCH:
                yield at, chunk.findall(text, at, end)
            else:
                starts = (m.start() for m in self.pattern.finditer(text, at, end))
                end = next((s for s in starts if s >= at + STRETCH and not text[s - 1].isspace()), end)
                yield at, [text[at:end]]
            at = end

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return np.frombuffer(b"".join(b"".join(map(self.chunks.__getitem__, chunks)) for _, chunks in self._stretches(text)), self.kind)

    def spans(self, text: str) -> np.ndarray:
        """Ids, first and next character of each token, in three rows. Tokens that share a character all span it."""
        parts, shift = [np.zeros((3, 0), np.int32)], np.array([[0], [1], [1]], np.int32)
        for at, chunks in self._stretches(text):
            for c in chunks:
                parts.append(self.places[c] + shift * at)
                at += len(c)
        return np.concatenate(parts, axis=1)

    def _token(self, i: int | None) -> bytes:
        return self.bytes[i] if i is not None and 0 <= i < len(self.bytes) else UNKNOWN

    def decode_bytes(self, ids: Iterable[int | None]) -> bytes:
        """Bytes of ids; an unknown or null id gives those of U+FFFD."""
        return b"".join(map(self._token, ids))

    def decode(self, ids: Iterable[int | None]) -> str:
        """Text of ids; bytes that are no whole character, as where a list of ids was cut, give U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_pieces(self, ids: Iterable[int | None]) -> list[str]:
        """What each id adds to the text: a split character comes whole with its last token, and what is left at the
        end as U+FFFD with the last id. Joined, the pieces are decode(ids)."""
        reader, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        for i in ids:
            out.append(reader.decode(self._token(i)))
        if out:
            out[-1] += reader.decode(b"", True)
        return out

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of their decimals and digest of what they decode to."""
        numbers, decoded = hashlib.sha256(), hashlib.sha256()
        ids = self.encode(text)
        for i in range(0, len(ids), 1 << 18):
            some = ids[i : i + (1 << 18)].tolist()
            numbers.update((" " * (i > 0) + " ".join(map(self.decimals.__getitem__, some))).encode())
            decoded.update(b"".join(map(self.bytes.__getitem__, some)))
        return len(ids), numbers.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=2)
def load(model: str) -> ByteBpe:
    """One model a worker process."""
    return ByteBpe(model)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, n_tokens long, ids_sha256, decoded_sha256), one row for each input row; a null text is empty.

    Repeated rows and null ids each give their own row; texts of any length are encoded whole; an empty table gives no
    rows; other columns are not read, so their names can't clash.
    """
    held = docs.sparkSession.sparkContext.broadcast(library_model(path, pattern))  # a vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(held.value)
        for batch in batches:
            made = [model.digests(x.as_py() or "") for x in batch.column(1)]
            cols = list(zip(*made, strict=True)) if made else [[], [], []]
            tidy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(named([id_col])[0].cast("long").alias("doc_id"), named([text_col])[0].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with an array<int> column of token ids (a null text gives an empty array); a column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(library_model(path, pattern))  # a vocabulary file

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(text: pa.Array) -> pa.Array:
        made = [load(held.value).encode(t.as_py() or "") for t in text]
        flat = np.concatenate([np.zeros(0, np.int32), *made])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.array(flat, pa.int32()))

    return docs.withColumn(out, ids(named([text_col])[0]))


def encode_spans(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """docs with an array<struct<id, start, end>> column: each token's id and the characters of the text it stands for.

    start counts code points from 0, end is the one after the last; tokens that share a character all span it. A null
    text gives an empty array; a column of that name is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(library_model(path, pattern))  # a vocabulary file
    token = T.StructType([T.StructField(n, T.IntegerType(), False) for n in ("id", "start", "end")])

    @F.arrow_udf(T.ArrayType(token, False))
    def spans(text: pa.Array) -> pa.Array:
        made = [load(held.value).spans(t.as_py() or "") for t in text]
        flat = np.concatenate([np.zeros((3, 0), np.int32), *made], axis=1)
        fields = [pa.field(n, pa.int32(), False) for n in ("id", "start", "end")]
        rows = pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=fields)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(m.shape[1] for m in made)]), pa.int32()), rows, type=pa.list_(pa.field("element", rows.type, False)))

    return docs.withColumn(out, spans(named([text_col])[0]))


def decode_column(docs: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out: str = "text") -> DataFrame:
    """docs with a string column decoded from an array<int> column; null ids arrays give null.

    A list of ids may begin or end inside a character: what is no whole character gives U+FFFD, as an id does that the
    file doesn't know. A column named `out` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(library_model(path, pattern))  # a vocabulary file

    @F.arrow_udf(T.StringType())
    def texts(ids: pa.Array) -> pa.Array:
        model = load(held.value)
        return pa.array([None if x is None else model.decode(x) for x in _lists(ids)], pa.string())

    return docs.withColumn(out, texts(named([ids_col])[0]))


def _lists(column: pa.Array) -> Iterator[list | None]:
    for i in range(0, len(column), 64):
        yield from islice(column.slice(i, 64).to_pylist(), 64)
