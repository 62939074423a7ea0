"""Line dedup over range-partitioned, sorted line hashes, answered with compressed keep bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.common import materialize, packed, tidy, unpacked

#: What a sorted partition says of a line: it goes; it waits for earlier partitions; first document of an edge run.
DROP, WAIT, EDGE = 0, 1, 2
_SPACE = b" \t\n\x0b\x0c\r"
_ROW = pa.schema([("h", pa.binary()), ("id", pa.int64()), ("mark", pa.int64()), ("pos", pa.int32())])
_SAID = pa.schema([("kind", pa.int8()), *_ROW])


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h binary, id, mark, pos): 128-bit hash of each line key of at least min_chars code points.

    mark tells texts apart that share an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            hashes, ids, marks, places = [], [], [], []
            for i, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for pos, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    key = line.strip(_SPACE)
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                        hashes.append(digest(key.lower()))
                        ids.append(i)
                        marks.append(mark)
                        places.append(pos)
                if len(hashes) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((hashes, ids, marks, places), _ROW, strict=True)], schema=_ROW)
                    hashes, ids, marks, places = [], [], [], []
            tidy()
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((hashes, ids, marks, places), _ROW, strict=True)], schema=_ROW)

    return docs.select(F.col(id_col).cast("long").alias("id"), _mark(text_col).alias("mark"), F.col(text_col).alias("text")).mapInArrow(
        run, "h binary, id long, mark long, pos int"
    )


def _mark(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition: later documents' lines of each run, with the edges that other partitions must settle."""
    run, h, first = 0, None, None
    for batch in batches:
        kinds, at = [], []
        heads = []
        for n, (key, i) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key != h:
                if run == 1:
                    heads.append((h, first))
                run, h, first = run + 1, key, i
            if run == 1:
                kinds.append(WAIT)
                at.append(n)
            elif i != first:
                kinds.append(DROP)
                at.append(n)
        if at:
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int8()), *rows.columns], schema=_SAID)
        yield from _edges(heads)
    if run:
        yield from _edges([(h, first)])


def _edges(found: list[tuple[bytes, int | None]]) -> Iterator[pa.RecordBatch]:
    if found:
        cols = [[EDGE] * len(found), [x[0] for x in found], [x[1] for x in found], [0] * len(found), [0] * len(found)]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _SAID, strict=True)], schema=_SAID)


@F.pandas_udf(T.BinaryType())
def _pack(drops: pd.Series) -> pd.Series:
    """Deflated keep bits up to the last dropped line; all lines beyond stay."""

    def one(positions: np.ndarray) -> bytes:
        keep = np.ones(int(max(positions)) + 1, np.uint8)
        keep[positions] = 0
        return len(keep).to_bytes(4, "little") + zlib.compress(np.packbits(keep).tobytes())

    return drops.map(one)


def keep_bits(bitmap: bytes) -> np.ndarray:
    """The bits of a keep bitmap, one for each line up to the last dropped one."""
    n = int.from_bytes(bitmap[:4], "little")
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap[4:]), np.uint8))[:n].astype(bool)


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t: str | None, b: bytes | None) -> str | None:
        if b is None or t is None:
            return t
        lines, keep = t.split("\n"), keep_bits(b)
        return "\n".join([x for x, k in zip(lines, keep, strict=False) if k] + lines[len(keep) :])

    return pd.Series([one(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, mark, n_dropped long, bitmap binary) of the documents that lose lines.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of min_chars code points or more
    that at least two ids hold lose all lines but those of the smallest id. Null and empty texts are one empty line.
    Rows that share an id are one document; null ids together are one document that sorts after all others.
    Keys are ranged by (hash, id, text, place), so a key held by a third of all lines spreads over many partitions, and
    so do the lines that one id, or none, repeats. The keys are written first: finding the ranges reads them again.
    """
    keys = materialize(line_keys(docs, id_col, text_col, min_chars), "line-keys")
    order = ["h", F.col("id").asc_nulls_last(), "mark", "pos"]
    said = materialize(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, "kind tinyint, h binary, id long, mark long, pos int"), "lines")
    # two edges a partition at most: bounded by the number of partitions
    edges = said.where(F.col("kind") == EDGE).groupBy("h").agg(F.min("id").alias("first"))
    late = said.where(F.col("kind") == WAIT).join(F.broadcast(edges), "h").where(~F.col("id").eqNullSafe(F.col("first")))
    drops = said.where(F.col("kind") == DROP).select("id", "mark", "pos").union(late.select("id", "mark", "pos"))
    per_doc = drops.groupBy("id", "mark").agg(F.collect_set("pos").alias("drops"))
    return per_doc.select("id", "mark", F.size("drops").cast("long").alias("n_dropped"), _pack("drops").alias("bitmap"))


def cut_rows(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, cut, n_lines, n_dropped): each row as a struct, its text's kept lines, its lines before and those dropped."""
    own = packed(docs, id=F.col(id_col).cast("long"), mark=_mark(text_col), text=F.col(text_col))
    gone = bitmaps.select(F.col("id").alias("b_id"), F.col("mark").alias("b_mark"), F.col("n_dropped").alias("n"), "bitmap")
    joined = own.join(gone, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("mark") == F.col("b_mark")), "left")
    hit, whole = F.col("bitmap").isNotNull(), F.coalesce("text", F.lit(""))
    kept = joined.withColumn("part", _kept(F.when(hit, F.col("text")), F.col("bitmap")))
    lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    return kept.select("row", F.when(hit, F.col("part")).otherwise(F.col("text")).alias("cut"), lines.cast("long").alias("n_lines"), F.coalesce("n", F.lit(0).cast("long")).alias("n_dropped"))


def apply_line_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cut to its kept lines, and __n_lines (before) and __n_dropped beside all its columns.

    Input columns named like the added ones are replaced; no other name can clash.
    """
    made = cut_rows(docs, bitmaps, id_col, text_col)
    fields = [(F.col("cut") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return unpacked(made.select(F.struct(*fields).alias("row"), "n_lines", "n_dropped"), docs.columns, "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs without repeated lines; see line_bitmaps() for the rule and apply_line_bitmaps() for the added columns."""
    return apply_line_bitmaps(docs, line_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)
