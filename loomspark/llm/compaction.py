"""Sharding by size-tiered compaction: immutable Parquet shards, merged by size, under versioned manifests."""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.common import named

@dataclass(frozen=True)
class TierPlan:
    """Sizes in bytes. A tier spans sizes up to `ratio` times its smallest; `fan` shards of a tier make a merge.

    parallel merges run side by side; a commit that other writers overtake is tried up to `tries` times.
    """

    target: int = 128 << 20
    smallest: int = 1 << 20
    ratio: float = 4.0
    fan: int = 4
    parallel: int = 8
    tries: int = 20


@dataclass(frozen=True)
class ShardFile:
    """A shard that a manifest names, relative to the dataset's folder."""

    name: str
    size: int


class ManifestConflict(RuntimeError):
    """Another writer committed the version first."""


class ShardSet:
    """A folder of immutable shards. manifest-N.json names the shards of version N; the largest N is current.

    Appends and merges write new files only and then commit: the next manifest is written under another name and put
    in place only if that version does not exist yet (by a hard link on a local or mounted disk, by a rename that
    refuses to overwrite elsewhere, which is atomic on HDFS; object stores without it allow one committer at a time).
    So readers see the old shards or the new ones, and of two writers one tries again on top of the other. A manifest has a
    line of some 80 bytes a shard, 60 MB for 100 TB in shards of the target size. Files that no manifest names are left
    of failed or overtaken writers; they are never read, and clean() removes them.
    """

    def __init__(self, spark: SparkSession, path: str, plan: TierPlan = TierPlan()) -> None:
        self.spark, self.path, self.plan = spark, path.rstrip("/"), plan
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = self._hadoop.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    # --- versions ---

    def versions(self) -> list[int]:
        """All versions that are still there, ascending."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def version(self) -> int:
        """The current version; 0 for a new folder."""
        return max([0, *self.versions()])

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/manifest-{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[ShardFile]:
        version = self.version() if version is None else version
        return [ShardFile(**s) for s in self._manifest(version)["shards"]] if version else []

    def commit(self, shards: list[ShardFile], seen: int, schema: str | None = None) -> int:
        """Make shards the version after `seen`, or raise ManifestConflict if there is one."""
        if self.version() > seen:
            raise ManifestConflict(f"version {seen + 1} exists")
        schema = schema or (self._manifest(seen)["schema"] if seen else None)
        scratch, final = (f"{self.path}/{n}" for n in (f".manifest-{uuid.uuid4().hex}", f"manifest-{seen + 1}.json"))
        out = self._fs.create(self._path(scratch))
        out.write(json.dumps({"version": seen + 1, "schema": schema, "shards": [asdict(s) for s in shards]}).encode())
        out.close()
        try:
            self._claim(scratch, final)
        finally:
            self._fs.delete(self._path(scratch), False)
        return seen + 1

    def _claim(self, scratch: str, final: str) -> None:
        if urlparse(self.path).scheme in ("", "file"):
            try:
                os.link(urlparse(scratch).path, urlparse(final).path)
            except FileExistsError:
                raise ManifestConflict(f"{final} exists") from None
            return
        context = self._hadoop.FileContext.getFileContext(self._path(self.path).toUri())
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._path(scratch), self._path(final), options)
        except Exception as e:
            if self._fs.exists(self._path(final)):
                raise ManifestConflict(f"{final} exists") from e
            raise

    def _change(self, gone: set[str], made: list[ShardFile], schema: str | None = None) -> int:
        """Commit the current version without `gone` and with `made`, on top of whatever others commit meanwhile."""
        for n in range(self.plan.tries):
            seen = self.version()
            now = self.shards(seen)
            if not gone <= {s.name for s in now}:
                raise ManifestConflict("another writer has replaced shards of this merge")
            if schema and seen and schema != self._manifest(seen)["schema"]:
                raise ValueError("arrivals must have the columns of the shards")
            try:
                return self.commit([s for s in now if s.name not in gone] + made, seen, schema)
            except ManifestConflict:
                time.sleep(0.01 * n)
        raise ManifestConflict(f"overtaken {self.plan.tries} times")

    # --- writing ---

    def _written(self, folder: str) -> list[ShardFile]:
        found = self._fs.listStatus(self._path(f"{self.path}/{folder}"))
        return [ShardFile(f"{folder}/{s.getPath().getName()}", s.getLen()) for s in found if s.getPath().getName().endswith(".parquet")]

    def append(self, rows: DataFrame) -> int:
        """Add arrivals as they are partitioned, a shard a task, without a shuffle; the new version. Null values, long
        texts and repeated rows are kept, whatever the columns are called; an empty table adds at most an empty shard."""
        folder = f"run-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.path}/{folder}")
        kept = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        return self._change(set(), self._written(folder), kept.json())

    def tier(self, size: int) -> int:
        return 0 if size <= self.plan.smallest else 1 + int(math.log(size / self.plan.smallest, self.plan.ratio))

    def groups(self, shards: list[ShardFile]) -> list[list[ShardFile]]:
        """Merges that are due: shards below the target, by tier and size, filled up to the target size.

        A tier waits until it has `fan` shards. No merge exceeds the target, so each makes one shard of several and
        rounds come to an end.
        """
        tiers: dict[int, list[ShardFile]] = {}
        for s in sorted(shards, key=lambda s: (s.size, s.name)):
            if s.size < self.plan.target:
                tiers.setdefault(self.tier(s.size), []).append(s)
        due = []
        for _, members in sorted(tiers.items()):
            if len(members) < self.plan.fan:
                continue
            group: list[ShardFile] = []
            size = 0
            for s in members:
                if size + s.size > self.plan.target:
                    due.append(group)
                    group, size = [], 0
                group.append(s)
                size += s.size
            due.append(group)
        return [g for g in due if len(g) > 1]

    def compact(self, keep: int = 2) -> int:
        """Merge until no tier is due; every round is one commit. The last version.

        A merge is one narrow job over its own files, without a shuffle; merges of a round run side by side. No row is
        added or lost. After each round versions before the last `keep` expire, so readers of the version that a round
        replaces go on undisturbed.
        """
        while due := self.groups(self.shards()):
            with ThreadPoolExecutor(self.plan.parallel) as pool:
                made = list(pool.map(self._merge, due))
            self._change({s.name for group in due for s in group}, [s for m in made for s in m])
            self.expire(keep)
        return self.version()

    def _merge(self, group: list[ShardFile]) -> list[ShardFile]:
        folder = f"run-{uuid.uuid4().hex[:12]}"
        self._rows(group).coalesce(1).write.parquet(f"{self.path}/{folder}")
        return self._written(folder)

    # --- upkeep ---

    def expire(self, keep: int = 2) -> int:
        """Delete manifests but the last `keep`, and the shards that only they named; how many files went."""
        found = self.versions()
        old, live = found[:-keep], {s.name for v in found[-keep:] for s in self.shards(v)}
        dead = {s.name for v in old for s in self.shards(v)} - live
        for name in [*dead, *(f"manifest-{v}.json" for v in old)]:
            self._fs.delete(self._path(f"{self.path}/{name}"), False)
        for folder in {n.split("/")[0] for n in dead} - {n.split("/")[0] for n in live}:
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
        return len(dead) + len(old)

    def clean(self, hours: float = 24.0) -> int:
        """Delete run folders that no manifest names and that nobody has touched for `hours`; how many went."""
        live = {s.name.split("/")[0] for v in self.versions() for s in self.shards(v)}
        found = self._fs.listStatus(self._path(self.path))
        old = [s.getPath() for s in found if s.getPath().getName().startswith("run-") and s.getModificationTime() < (time.time() - 3600 * hours) * 1000]
        gone = [p for p in old if p.getName() not in live]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)

    # --- reading ---

    def _rows(self, shards: list[ShardFile]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self._manifest(self.version())["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s.name}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with __shard: the name of the row's shard. A column of that name is replaced."""
        shards = self.shards(version)
        if not shards:
            raise ValueError("no version was committed")
        rows = self._rows(shards)
        own = named([c for c in rows.columns if c.lower() != "__shard"])
        return rows.select(*own, F.substring_index(F.col("_metadata.file_path"), "/", -2).alias("__shard"))
