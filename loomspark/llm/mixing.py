"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspark.llm.common import fresh_path, materialize, named, packed, unpacked


@dataclass(frozen=True)
class MixPlan:
    """Parameters. Either weights names a whole number for each source, or the weights follow counts ** temperature.

    quanta bounds the sum of derived weights, and so the length of a schedule's period; block is documents a block,
    bucket_rows what one task numbers at a time, range_rows what a file of mixed_order() holds.
    """

    weights: tuple[tuple[str | None, int], ...] | None = None
    temperature: float = 0.5
    quanta: int = 1000
    block: int = 64
    bucket_rows: int = 5_000
    range_rows: int = 20_000


@dataclass
class Phase:
    """A stretch of the schedule between two sources running out.

    had are the blocks that each active task had before it, slots the (task, its block within the period) of a period's
    first slots: all of them, or `length` if the phase is shorter than a period.
    """

    start: int
    length: int
    period: int
    had: dict[int, int]
    weights: dict[int, int]
    slots: list[tuple[int, int]] = field(repr=False)

    def taken(self) -> dict[int, int]:
        """Blocks of each task that run in this phase."""
        whole, rest = divmod(self.length, self.period)
        out = {i: whole * w for i, w in self.weights.items()}
        for i, _ in self.slots[:rest]:
            out[i] += 1
        return out


def pfair_slots(weights: list[int]) -> Iterator[tuple[int, int]]:
    """Slots of one period, in order: (task, its block's number), each task having as many blocks as its weight.

    Block k of a task of weight w in a period of H slots may run from floor(k*H/w) and has to end by
    ceil((k+1)*H/w). Earliest deadline first over the released blocks meets every deadline as long as the weights
    add up to H, so after any number of slots a task is less than one block away from its share.
    """
    period = sum(weights)
    coming = [(0, -(-period // w), i, 0) for i, w in enumerate(weights) if w]
    heapq.heapify(coming)
    ready: list[tuple[int, int, int]] = []
    for now in range(period):
        while coming and coming[0][0] <= now:
            _, due, i, k = heapq.heappop(coming)
            heapq.heappush(ready, (due, i, k))
        due, i, k = heapq.heappop(ready)
        if due <= now:
            raise AssertionError("a deadline was missed")
        yield i, k
        if (k := k + 1) < weights[i]:
            heapq.heappush(coming, (k * period // weights[i], -(-(k + 1) * period // weights[i]), i, k))


def pfair_period(weights: list[int]) -> list[tuple[int, int]]:
    """All slots of one period."""
    return list(pfair_slots(weights))


def derived_weights(counts: dict[str | None, int], plan: MixPlan) -> dict[str | None, int]:
    """Whole weights, at least 1, that add up to about plan.quanta."""
    if plan.weights is not None:
        return dict(plan.weights)
    power = {s: n**plan.temperature for s, n in counts.items()}
    total = sum(power.values())
    return {s: max(1, round(p * plan.quanta / total)) for s, p in power.items()}


def phases(blocks: list[int], weights: list[int]) -> Iterator[Phase]:
    """The schedule of `blocks` blocks a task, as phases in order.

    A task that has run out leaves, and the others share its slots by their own weights. Tasks without weight follow at
    the end, in order. No phase lists more slots than it has, so all of them together list at most sum(blocks).
    """
    at, had = 0, [0] * len(blocks)
    active = [i for i, (b, w) in enumerate(zip(blocks, weights, strict=True)) if b and w]
    while active:
        own = [weights[i] for i in active]
        whole = min((blocks[i] - had[i] - 1) // weights[i] for i in active)  # periods that all of them get through
        slots, tail = [], 0
        for j, k in pfair_slots(own):
            i = active[j]
            slots.append((i, k))
            if not tail and blocks[i] - had[i] - whole * weights[i] == k + 1:
                tail = len(slots)
                if not whole:
                    break
        phase = Phase(at, whole * sum(own) + tail, sum(own), {i: had[i] for i in active}, dict(zip(active, own, strict=True)), slots)
        yield phase
        for i, n in phase.taken().items():
            had[i] += n
        at += phase.length
        active = [i for i in active if had[i] < blocks[i]]
    for i, (b, w) in enumerate(zip(blocks, weights, strict=True)):
        if b and not w:
            yield Phase(at, b, 1, {i: 0}, {i: 1}, [(i, 0)])
            at += b


def deviation(order: list[int], weights: list[int]) -> Fraction:
    """The largest distance, in blocks, of any task from its share over the prefixes of an order."""
    total, seen, worst = sum(weights), [0] * len(weights), Fraction(0)
    for n, i in enumerate(order, 1):
        seen[i] += 1
        worst = max([worst, *(abs(Fraction(n * w, total) - c) for w, c in zip(weights, seen, strict=True))])
    return worst


def _keys(docs: DataFrame, id_col: str) -> tuple[Column, Column]:
    """Two hashes that order the rows of a source; the first has 63 bits.

    Rows read from files are hashed by id and by their file and place in it, others by all their columns, so rows
    that share an id, or have none, are spread like any others; the second hash holds all columns as well.
    """
    own = [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(named(docs.columns), docs.schema, strict=True)]
    place = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        docs.select(*place)
    except AnalysisException:
        place = []
    first = [F.col(id_col), *place] if place else own
    return F.shiftrightunsigned(F.xxhash64(*first), 1), F.xxhash64(F.lit(1), *own, *place)


def _source_counts(docs: DataFrame, source_col: str) -> list[tuple[str | None, int]]:
    """Rows of each source, in the order of tasks: one row a source reaches the driver."""
    counts = docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.count("*").alias("n")).collect()
    return sorted(((r["s"], r["n"]) for r in counts), key=lambda x: (x[0] is None, x[0]))


def _slot_table(spark: SparkSession, counts: list[tuple[str | None, int]], plan: MixPlan, held: int = 500_000) -> DataFrame:
    """(task, block, slot) of every block, at most one row for plan.block documents and each source's last ones.

    The driver schedules phase by phase and writes what it has as soon as it holds `held` numbers.
    """
    weights = derived_weights(dict(counts), plan)
    blocks, share = [-(-n // plan.block) for _, n in counts], [weights.get(s, 0) for s, _ in counts]
    paths = [fresh_path(spark, tag) for tag in ("mix-spans", "mix-slots")]
    kinds = ("task int, phase int, first long, n long, skip long, start long, period long, w long", "task int, phase int, k long, at long")
    rows: list[list[tuple]] = [[], []]

    def write(mode: str = "append") -> None:
        for part, kind, path in zip(rows, kinds, paths, strict=True):
            columns = list(zip(*part, strict=True)) or [[] for _ in kind.split(",")]
            types = [pa.int32() if c.endswith(" int") else pa.int64() for c in kind.split(", ")]
            table = pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in kind.split(", ")])
            spark.createDataFrame(table).write.mode(mode).parquet(path)
            part.clear()

    for n, p in enumerate(phases(blocks, share)):
        for i, blocks_here in p.taken().items():
            for skip in range(0, blocks_here, 1_000_000):  # pieces that one task can list
                rows[0].append((i, n, p.had[i], min(1_000_000, blocks_here - skip), skip, p.start, p.period, p.weights[i]))
        rows[1] += [(i, n, k, at) for at, (i, k) in enumerate(p.slots)]
        if len(rows[0]) + len(rows[1]) > held:
            write()
    write()
    spans, slots = (spark.read.schema(kind).parquet(path) for kind, path in zip(kinds, paths, strict=True))
    listed = spans.withColumn("j", F.explode(F.sequence(F.col("skip"), F.col("skip") + F.col("n") - 1))).withColumn("k", F.pmod("j", "w"))
    timed = listed.join(slots, ["task", "phase", "k"])
    slot = F.col("start") + F.floor(F.col("j") / F.col("w")).cast("long") * F.col("period") + F.col("at")
    return materialize(timed.select("task", (F.col("first") + F.col("j")).alias("block"), slot.alias("slot")), "mix-blocks")


def _placed(rows: DataFrame, counts: list[tuple[str | None, int]], plan: MixPlan) -> DataFrame:
    """rows(s, t, u, ...) with task, at (the row's number within its source), block, rank and slot.

    Rows are numbered through buckets of about plan.bucket_rows rows, ranges of t, so a source that holds a third of
    all rows spreads over many tasks.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame([(s, i, max(1, -(-n // plan.bucket_rows))) for i, (s, n) in enumerate(counts)], "name string, task int, buckets int")
    sent = F.broadcast if len(counts) <= _Ranges.MOST >> 4 else lambda names: names
    own = rows.join(sent(table), F.col("s").eqNullSafe(F.col("name"))).drop("name")  # a row a source
    own = own.withColumn("bucket", F.least(F.floor(F.col("t") / float(1 << 63) * F.col("buckets")).cast("int"), F.col("buckets") - 1)).drop("buckets")
    before = F.sum("n").over(Window.partitionBy("task").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = own.groupBy("task", "bucket").agg(F.count("*").alias("n"))
    offsets = materialize(sizes.select("task", "bucket", F.coalesce(before, F.lit(0)).alias("before")), "mix-buckets")
    number = F.row_number().over(Window.partitionBy("task", "bucket").orderBy("t", "u")) - 1
    numbered = own.withColumn("number", number).join(offsets, ["task", "bucket"]).withColumn("at", F.col("number") + F.col("before"))
    blocked = numbered.withColumn("block", F.floor(F.col("at") / plan.block).cast("long")).withColumn("rank", F.pmod("at", F.lit(plan.block)).cast("int"))
    return blocked.drop("number", "before", "bucket").join(_slot_table(spark, counts, plan), ["task", "block"])


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with __block (its number within the source), __slot (its place in the schedule) and __rank (in the block).

    Every row gets exactly one place and none is dropped; (__slot, __rank) is the order of the mix. Within a source
    rows are taken by a hash, see _keys(); only rows that are equal in all columns can change places when a lost task
    runs again. Null sources are one source of their own; null and repeated ids are spread like others; an empty table
    gives an empty result. Input columns named like the added ones are replaced; no other name can clash.

    What reaches the driver is one row a source; the schedule's table has one row a block and is joined by its size.
    """
    t, u = _keys(docs, id_col)
    rows = packed(docs, s=F.col(source_col).cast("string"), t=t, u=u)
    return unpacked(_placed(rows, _source_counts(docs, source_col), plan), docs.columns, "block", "slot", "rank")


class _Ranges:
    """Which range of slots a row belongs to, by its source and hashes; holds at most MOST entries."""

    MOST = 1 << 20

    def __init__(self, starts: pa.Table) -> None:
        """starts(s, t, u, range): the first row of each source in each range."""
        starts = starts.combine_chunks()
        names = starts.column("s").unique().to_pylist()
        self.code = {name: i for i, name in enumerate(names)}
        code = self._codes(starts.column("s").to_pylist())
        t, u, ranges = (starts.column(c).to_numpy() for c in ("t", "u", "range"))
        order = np.lexsort((u, t, code))
        self.t, self.u, self.ranges = t[order], u[order], ranges[order]
        self.ends = np.searchsorted(code[order], np.arange(len(names) + 1))

    def _codes(self, names: list[str | None]) -> np.ndarray:
        return np.fromiter((self.code[n] for n in names), np.int64, len(names))

    def find(self, s: list[str | None], t: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The last entry of each row's source that is not behind its hashes; all rows are halved in on at once."""
        code = self._codes(s)
        low, high = self.ends[code], self.ends[code + 1]  # the answer is in [low, high)
        while (high - low > 1).any():
            middle = (low + high) >> 1
            behind = (self.t[middle] > t) | ((self.t[middle] == t) & (self.u[middle] > u))
            # a row that is done has middle == low and an entry not behind it, or the first of its source
            low, high = np.where(behind, low, middle), np.where(behind, np.maximum(middle, low + 1), high)
        return self.ranges[low].astype(np.int32)


def mixed_order(docs: DataFrame, plan: MixPlan = MixPlan(), id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs, all columns and rows, laid out in the order of mix(): partitions in the order of slots, sorted within.

    The rows' hashes are placed first, without their texts. The first row of each source in each range of slots, if
    these are at most 2^20, tells texts which range they belong to; the first row of each block, sorted
    in among the texts of its range, tells them their slot. So texts are shuffled once. With more sources and ranges than
    that, texts are joined with their slots by a shuffle and dealt out by a second one; ranges follow the rows either way. Rows not read from files that are equal in
    all columns stand next to each other. positions() finds the order again once the rows have been written.
    """
    spark = docs.sparkSession
    counts = _source_counts(docs, source_col)
    if not counts:
        return docs
    t, u = _keys(docs, id_col)
    s = F.col(source_col).cast("string")
    placed = _placed(docs.select(s.alias("s"), t.alias("t"), u.alias("u")), counts, plan)
    slots, rows = sum(-(-n // plan.block) for _, n in counts), sum(n for _, n in counts)
    wanted = max(-(-rows // plan.range_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), slots))
    width = -(-slots // max(1, wanted))
    ranges = -(-slots // width)
    if min(len(counts) * ranges, slots) > _Ranges.MOST:
        keys = materialize(placed.groupBy("s", "t", "u").agg(F.min("slot").alias("slot")), "mix-places").toDF("s2", "t2", "u2", "slot")
        same = F.col("s").eqNullSafe(F.col("s2")) & (F.col("t") == F.col("t2")) & (F.col("u") == F.col("u2"))
        found = packed(docs, s=s, t=t, u=u).join(keys, same).withColumn("range", F.floor(F.col("slot") / width).cast("int"))
        return found.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "slot", "t", "u").select("row.*")
    slim = materialize(placed.groupBy("s", "slot").agg(F.min(F.struct("t", "u")).alias("f")), "mix-places")
    marks = slim.select(F.floor(F.col("slot") / width).cast("int").alias("range"), "s", "f.t", "f.u", "slot")
    starts = marks.groupBy("s", "range").agg(F.min(F.struct("t", "u")).alias("f")).select("s", "range", "f.*")
    held = spark.sparkContext.broadcast(_Ranges(starts.toArrow()))

    @F.arrow_udf(T.IntegerType())
    def home(s: pa.Array, t: pa.Array, u: pa.Array) -> pa.Array:
        return pa.array(held.value.find(s.to_pylist(), t.to_numpy(zero_copy_only=False), u.to_numpy(zero_copy_only=False)))

    texts = packed(docs, s=s, t=t, u=u).select(home("s", "t", "u").alias("range"), "s", "t", "u", F.lit(None).cast("long").alias("slot"), "row")
    both = texts.union(marks.withColumn("row", F.lit(None).cast(texts.schema["row"].dataType)))
    dealt = both.repartitionById(ranges, F.col("range"))
    before = Window.partitionBy("range", "s").orderBy("t", "u", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    timed = dealt.withColumn("slot", F.last("slot", True).over(before)).where(F.col("row").isNotNull())
    return timed.sortWithinPartitions("range", "slot", "t", "u").select("row.*")


def positions(docs: DataFrame, name: str = "mix_position") -> DataFrame:
    """docs with each row's place in the order its files were written in: those before it in its file and earlier files.

    Readers sort and pack files by size, so the order of mixed_order() is that of file names and of rows within a file,
    not that of the rows as read. Rows that are not read from files are numbered as they come, with gaps. A column
    that has the new one's name is replaced. What reaches the driver, and is sent out, is one row a file.
    """
    own = [c for c in docs.columns if c.lower() != name.lower()]
    place = {"file": F.col("_metadata.file_name"), "number": F.col("_metadata.row_index")}
    try:
        marked = packed(docs, **place)
    except AnalysisException:
        return docs.select(*named(own), F.monotonically_increasing_id().alias(name))
    sizes = {r["file"]: r["n"] for r in marked.groupBy("file").agg((F.max("number") + 1).alias("n")).collect()}
    before, rows = 0, []
    for file in sorted(sizes, key=_natural):
        rows.append((file, before))
        before += sizes[file]
    starts = docs.sparkSession.createDataFrame(rows, "file string, before long")
    placed = marked.join(F.broadcast(starts), "file")
    return placed.select(*(F.col("row").getField(c).alias(c) for c in own), (F.col("before") + F.col("number")).alias(name))


def _natural(file: str) -> list[tuple[int, str]]:
    """Sorts part-100000 behind part-99999."""
    return [(int(x), "") if x.isdecimal() else (-1, x) for x in re.split(r"([0-9]+)", file)]
