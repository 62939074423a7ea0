"""A keyed table that is changed in place of being rewritten: ranges of key hashes as folders, versions as small manifests.

A change reads and writes only the ranges that its keys fall into; all others are carried over by name. A version stands
once its manifest does, so readers see whole changes only, and two writers never take each other's rows away.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.scratch import materialize

#: Rows of a range before it is split.
RANGE_ROWS = 2_000_000
_LEAST = -(1 << 63)


class KeyedStore:
    """Folders files/ (a folder a range and change) and versions/ (a manifest a version) under path.

    Keys are distinct; a null in a key is a value like any other. Manifests name ranges, one for RANGE_ROWS rows, and are
    all that reaches the driver. On a local disk a manifest is claimed by a hard link, elsewhere by a rename that must not
    overwrite; stores without such a rename need one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], range_rows: int = RANGE_ROWS) -> None:
        self.spark, self.path, self.keys, self.range_rows = spark, path.rstrip("/"), list(keys), range_rows
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def create(self, rows: DataFrame, order: Column | None = None) -> KeyedStore:
        """A store of rows (version 1 is empty, version 2 has them); path must be new. Of several rows of a key the last by `order` counts, ties by a hash of the row."""
        self._fs.mkdirs(self._at(f"{self.path}/versions"))
        empty = {"schema": rows.schema.json(), "ranges": [[_LEAST, None, 0]]}
        if self.versions() or not self._commit(0, empty):
            raise FileExistsError(self.path)
        self.upsert(rows, order)
        return self

    # --- changes ---

    def upsert(self, rows: DataFrame, order: Column | None = None) -> int:
        """Put rows in place of those with their keys and return the new version; of several rows of a key the last by `order`."""
        return self._change(self._last(rows, order), lambda old, new: old.join(new, self._same(old, new), "left_anti").unionByName(new))

    def insert(self, rows: DataFrame, order: Column | None = None) -> int:
        """Add rows whose keys the store lacks; a row that is there stays as it is."""
        return self._change(self._last(rows, order), lambda old, new: old.unionByName(new.join(old, self._same(new, old), "left_anti")))

    def delete(self, keys: DataFrame) -> int:
        """Take away the rows of keys; keys that the store lacks do nothing."""
        return self._change(keys.select(*self.keys).distinct(), lambda old, new: old.join(new, self._same(old, new), "left_anti"))

    def _last(self, rows: DataFrame, order: Column | None) -> DataFrame:
        names = self._schema(self._manifest(self.version())).names
        row = F.struct(*names)
        by = F.struct(*([] if order is None else [order.alias("o")]), F.xxhash64(row).alias("h"))
        best = rows.groupBy(*self.keys).agg(F.max_by(row, by).alias("row"))
        return best.select(*(F.col("row").getField(c).alias(c) for c in names))

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in self.keys])

    def _change(self, rows: DataFrame, merge) -> int:
        given = materialize(rows, "store-change")
        while True:
            version = self.version()
            manifest = self._manifest(version)
            ranges = manifest["ranges"]
            hit = self._touched(given, ranges)
            if not hit:
                return version
            old = self._rows(manifest, hit).alias("old")
            made = materialize(merge(old, given.alias("new")), "store-merged")
            put = self._written(made, ranges, hit)
            if self._landed(version, manifest, hit, put):
                return self.version()

    def _written(self, made: DataFrame, ranges: list, hit: list[int]) -> dict[int, list]:
        """Write the rows of the ranges in hit and return what each becomes: one range, or several where it has grown."""
        lows = [r[0] for r in ranges]
        sizes = {x["at"]: x["count"] for x in made.groupBy(self._range(lows).alias("at")).count().collect()}  # a row a range
        folder, parts = f"files/{uuid.uuid4().hex}", []
        for i in hit:
            low, high = lows[i], lows[i + 1] if i + 1 < len(lows) else 1 << 63
            pieces = max(1, -(-sizes.get(i, 0) // self.range_rows))
            parts += [(i, low + (high - low) * j // pieces) for j in range(pieces)]
        starts = [low for _, low in parts]
        # rows of a hit range lie at or behind its first part and before any part of the next one
        placed = made.withColumn("__range", self._range(starts))
        placed.repartitionById(len(parts), F.col("__range")).sortWithinPartitions("__range", *self.keys).write.partitionBy("__range").parquet(f"{self.path}/{folder}")
        counts = {x["at"]: x["count"] for x in made.groupBy(self._range(starts).alias("at")).count().collect()}  # a row a range
        put: dict[int, list] = {i: [] for i in hit}
        for n, (i, low) in enumerate(parts):
            put[i].append([low, f"{folder}/__range={n}" if n in counts else None, counts.get(n, 0)])
        return put

    def _landed(self, version: int, manifest: dict, hit: list[int], put: dict[int, list]) -> bool:
        """Commit on top of `version`, or of what other writers made of it, as long as they left the ranges in hit alone."""
        ranges = manifest["ranges"]
        while True:
            named = {ranges[i][0]: [ranges[i], put[i]] for i in hit}
            latest = self._manifest(version)
            if any(r not in latest["ranges"] for r, _ in named.values()):
                return False
            after = [x for r in latest["ranges"] for x in (named[r[0]][1] if r[0] in named else [r])]
            if self._commit(version, {**latest, "ranges": after}):
                return True
            version = self.version()

    # --- reading ---

    def version(self) -> int:
        """The last version."""
        return max(self.versions())

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/versions"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdecimal())

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last one by default."""
        manifest = self._manifest(self.version() if version is None else version)
        return self._rows(manifest, range(len(manifest["ranges"])))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of the last version that have one of keys; only the ranges they fall into are read."""
        asked = materialize(keys.select(*self.keys).distinct(), "store-keys")
        manifest = self._manifest(self.version())
        rows = self._rows(manifest, self._touched(asked, manifest["ranges"]))
        return rows.join(asked, self._same(rows, asked), "left_semi")

    def ranges(self, version: int | None = None) -> list[tuple[int, str | None, int]]:
        """(least hash, folder, rows) of every range of a version; an empty one has no folder."""
        return [tuple(r) for r in self._manifest(self.version() if version is None else version)["ranges"]]

    def expire(self, keep: int = 2) -> int:
        """Forget all but the last `keep` versions and delete the folders that only they named; returns how many folders went."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        live = {r[1] for v in kept for r in self._manifest(v)["ranges"]}
        gone = {r[1] for v in old for r in self._manifest(v)["ranges"]} - live - {None}
        for v in old:
            self._fs.delete(self._at(self._name(v)), False)
        for folder in gone:
            self._fs.delete(self._at(f"{self.path}/{folder}"), True)
        return len(gone)

    # --- parts ---

    def _range(self, lows: list[int]) -> Column:
        """The number of the range that a row's key falls into; lows has one entry a range."""
        sent = self.spark.sparkContext.broadcast(np.array(lows, np.int64))

        @F.arrow_udf(T.IntegerType())
        def place(h: pa.Array) -> pa.Array:
            return pa.array(np.searchsorted(sent.value, h.to_numpy(zero_copy_only=False), "right") - 1, pa.int32())

        return place(F.xxhash64(*self.keys))

    def _touched(self, rows: DataFrame, ranges: list) -> list[int]:
        return sorted(x["at"] for x in rows.select(self._range([r[0] for r in ranges]).alias("at")).distinct().collect())  # at most the ranges

    def _schema(self, manifest: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(manifest["schema"]))

    def _rows(self, manifest: dict, at) -> DataFrame:
        paths = [f"{self.path}/{manifest['ranges'][i][1]}" for i in at if manifest["ranges"][i][1]]
        schema = self._schema(manifest)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def _name(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._at(self._name(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> bool:
        """Make manifest the version after `version`; False if there is one."""
        final, scratch = self._name(version + 1), f"{self.path}/versions/_{uuid.uuid4().hex}"
        out = self._fs.create(self._at(scratch))
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                local = lambda p: self._at(p).toUri().getPath()
                try:
                    os.link(local(scratch), local(final))
                except FileExistsError:
                    return False
                return True
            return bool(not self._fs.exists(self._at(final)) and self._fs.rename(self._at(scratch), self._at(final)))
        finally:
            self._fs.delete(self._at(scratch), False)
