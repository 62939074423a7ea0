"""Shared helpers: written tables and their end, rows as structs, byte-level word splitting."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.scratch import fresh_path, materialize, own_paths, paths_made, release, shared_dir

__all__ = ["PIECE", "drop_table", "fresh_path", "materialize", "named", "packed", "release", "shared_dir", "small_batches", "tidy", "unpacked", "word_lists", "written"]

#: Texts longer than this are walked in pieces cut at white space, so that no list of words outgrows memory.
PIECE = 1 << 22

_WS = re.compile(rb"[\x20\x09-\x0D]")


def written(spark: SparkSession, make: Callable[[], DataFrame], tag: str, spent: list[str]) -> DataFrame:
    """Like materialize(make(), tag), and drops what is no longer needed: the tables that make() wrote for itself and,
    before them, those named in spent. The path of the new table is put into spent for the next call. Calls of other threads have tables of their own."""
    with own_paths() as made:
        out = materialize(make(), tag)
    for path in [*made[:-1], *spent]:
        drop_table(spark, path)
    spent[:] = made[-1:]
    return out


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """What is run inside the block goes to Python in batches of at most about `size` bytes and one row.

    An executor holds a batch several times over for each of its cores: as it is filled, as it is sent, as Python gets it and what it
    is made into. Spark's own limit is 64 MB; it is read when a query is planned, so results have to be written inside.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of fresh_path() before the process ends."""
    release(spark, path)
    if path in paths_made(spark):
        paths_made(spark).remove(path)


def named(columns: list[str]) -> list[Column]:
    """Columns of these very names, whatever signs they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def packed(docs: DataFrame, **own: Column) -> DataFrame:
    """docs' rows as one struct, row, beside columns of one's own, so that the two kinds of names can't meet."""
    return docs.select(F.struct(*named(docs.columns)).alias("row"), *(c.alias(n) for n, c in own.items()))


def unpacked(rows: DataFrame, columns: list[str], *made: str) -> DataFrame:
    """The fields of row and `__x` for each x of made; an input column that has such a name is replaced."""
    taken = {f"__{m}".lower() for m in made}
    kept = [F.col("row").getField(c).alias(c) for c in columns if c.lower() not in taken]
    return rows.select(*kept, *(F.col(m).alias(f"__{m}") for m in made))


def word_lists(data: bytes) -> Iterator[list[bytes]]:
    """Words `[^\\x20\\x09-\\x0D]+` of data, in lists of bounded size."""
    if len(data) <= PIECE:
        yield data.split()
        return
    at = 0
    while at < len(data):
        cut = _WS.search(data, min(at + PIECE, len(data)))
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def tidy() -> None:
    """Give memory that a batch no longer needs back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
