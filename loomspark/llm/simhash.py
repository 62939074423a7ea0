"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are made in Arrow batches; all pairs within the radius are then found through masks built from a
linear code: every bit position gets a non-zero vector of r+1 bits, and for each non-zero v one mask keeps the
positions whose vector has an odd product with v. The vectors of r or fewer differing positions never span the
whole space, so some v is orthogonal to all of them and that mask hides every difference: the pair collides there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.common import materialize, tidy, word_lists
from loomspark.llm.components import star_components

BITS = 64
#: Buckets with more fingerprints than this are dealt out again by a second covering code over the hidden bits.
DENSE = 256
SALTS = 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority fingerprint (unsigned) of the word shingles of a whole text; 0 for a null or wordless text."""
    total, ones, tail = 0, np.zeros(BITS, np.int64), []
    join, digest = b" ".join, xxhash.xxh64_intdigest
    for words in word_lists((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        if len(words) >= shingle:
            hashes = np.array([digest(x, seed) for x in map(join, zip(*(words[i:] for i in range(shingle)), strict=False))], "<u8")
            total += len(hashes)
            for i in range(0, len(hashes), 65536):
                ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            words = words[-(shingle - 1) :] if shingle > 1 else []
        tail = words
    if not total:
        if not tail:
            return 0
        return digest(join(tail), seed)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id long, fp long): the signed form of each row's fingerprint, one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            tidy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def covering_masks(radius: int, positions: list[int] | None = None) -> list[int]:
    """2^(radius+1) - 1 masks over the positions; any radius or fewer of them are all hidden by at least one mask."""
    positions = list(range(BITS)) if positions is None else positions
    size = 1 << (radius + 1)
    code = {p: 1 + i % (size - 1) for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (code[p] & v).bit_count() & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_pairs(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """nodes(fp long, distinct) -> (u, v): links whose components are those of all pairs within the radius.

    Buckets of up to DENSE fingerprints are compared whole; larger ones are dealt out once more over the bits that
    their mask hides, which leaves at most 2^(hidden bits) fingerprints a bucket whatever the input's size. Within
    a bucket a fingerprint is linked to one found before it, so links grow with the rows and not with their pairs.
    """
    masks = covering_masks(radius)
    inner = [covering_masks(radius, [p for p in range(BITS) if not m >> p & 1]) for m in masks]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    # buckets are counted, and told their count, in SALTS parts each, so a large one does not meet in a task before it is dealt out
    keyed = keyed.withColumn("c", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    counts = keyed.groupBy("t", "key", "c").agg(F.count("*").alias("m")).withColumn("n", F.sum("m").over(Window.partitionBy("t", "key"))).where("n > 1")
    held = keyed.join(counts.select("t", "key", "c", "n"), ["t", "key", "c"])
    sub = F.array(*[F.array(*[F.lit(_signed(m | w)) for w in row]) for m, row in zip(masks, inner, strict=True)])
    light = held.where(F.col("n") <= DENSE).select("t", F.lit(-1).alias("s"), "key", "fp")
    dense = (
        held.where(F.col("n") > DENSE)
        .select("t", "fp", F.posexplode(F.element_at(sub, F.col("t") + 1)).alias("s", "mask"))
        .select("t", "s", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    )
    dealt = light.union(dense).repartition("t", "s", "key").sortWithinPartitions("t", "s", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, s, key, fp in _whole_buckets(batches):
            u, v = _links(t, s, key, fp, radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Sorted batches, cut anew so that no bucket is divided."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        same = np.ones(len(cols[0]), bool)
        for c in cols[:3]:
            same &= c == c[-1:]
        cut = int(np.argmax(same)) if len(same) else 0
        if cut:
            yield [c[:cut] for c in cols]
        rest = [c[cut:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def _links(t: np.ndarray, s: np.ndarray, key: np.ndarray, fp: np.ndarray, radius: int, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    fp = fp.view(np.uint64)
    new = np.ones(len(fp), bool)
    new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (key[1:] != key[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(fp)))
    left = np.repeat(start + count, count) - np.arange(len(fp))  # rows from here to the bucket's end
    u, v = [], []
    at = np.flatnonzero(np.repeat(count <= small, count))
    lag = 1
    while len(at := at[left[at] > lag]):
        near = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= radius]
        u.append(fp[near])
        v.append(fp[near + lag])
        lag += 1
    for a, n in zip(start[count > small], count[count > small], strict=True):
        rest = fp[a : a + n]
        while len(rest) > 1:
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                here = front.pop()
                near = np.bitwise_count(rest ^ here) <= radius
                hit = rest[near]
                if len(hit):
                    u.append(np.full(len(hit), here, np.uint64))
                    v.append(hit)
                    front.extend(hit)
                    rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate(u) if u else none, np.concatenate(v) if v else none


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id long, fingerprint string, component_id long), one row for each input row.

    component_id is the smallest id reachable over links of at most `radius` differing bits. Null and wordless texts
    have fingerprint zero and link like any other; equal fingerprints always link; a null id counts only where no
    other id is reachable (component_id is then null). Extra columns are not read, so their names cannot clash.
    """
    marks = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = marks.groupBy("fp").agg(F.min("id").alias("rep"))
    stars = star_components(linked_pairs(nodes.select("fp"), radius), "simhash-links")
    rooted = nodes.join(stars.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return marks.join(classes, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
