"""Keyed folds over ordered events, shared by a batch run and a stream.

A fold has a state schema, a start state, and a step from (state, row) to (state, output values). Rows carry `t`, the
event's time in seconds. Running the folds in batch costs one shuffle by key; a key's events then pass through in
order with only the state held, so a hot key needs time but no memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomspark import values as V


class Fold:
    """Base of the folds below."""

    state_schema = ""
    output_schema = ""
    inputs: tuple[str, ...] = ()

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, row: dict) -> tuple[tuple, tuple]:
        raise NotImplementedError


@dataclass
class TokenBucket(Fold):
    """Allows an event while its key has tokens; they come back at `rate` a second up to `burst`."""

    rate: float = V.BUCKET_PER_MINUTE / 60
    burst: float = V.BUCKET_BURST
    cost: float = 1.0
    state_schema = "tokens double, seen double"
    output_schema = "allowed boolean, remaining long, reset_at double"

    def start(self) -> tuple:
        return self.burst, -1.0

    def step(self, state: tuple, row: dict) -> tuple[tuple, tuple]:
        tokens, seen = state
        now = row["t"]
        if seen >= 0:
            tokens = min(self.burst, tokens + (now - seen) * self.rate)
        allowed = tokens >= self.cost
        tokens -= self.cost * allowed
        return (tokens, now), (allowed, max(0, int(tokens)), round(now + (self.burst - tokens) / self.rate, 6))


@dataclass
class CircuitBreaker(Fold):
    """Closed until `failures` failures, then open; half-open after `wait` seconds without one.

    Half-open lets `probes` calls through: `successes` good ones close it, one failure opens it. Successes while
    closed do not take failures back. Rows carry ok.
    """

    failures: int = V.BREAKER_FAILURES
    wait: float = V.BREAKER_SECONDS
    probes: int = V.BREAKER_PROBES
    successes: int = V.BREAKER_SUCCESSES
    state_schema = "state string, failed long, last_failure double, probing long, good long"
    output_schema = "admitted boolean, state string"
    inputs = ("ok",)

    def start(self) -> tuple:
        return "closed", 0, -1.0, 0, 0

    def step(self, state: tuple, row: dict) -> tuple[tuple, tuple]:
        name, failed, last, probing, good = state
        now = row["t"]
        if name == "open" and now - last >= self.wait:
            name, probing, good = "half_open", 0, 0
        admitted = name == "closed" or name == "half_open" and probing < self.probes
        if admitted:
            probing += name == "half_open"
            if row["ok"]:
                good += name == "half_open"
                if name == "half_open" and good >= self.successes:
                    name, failed = "closed", 0
            else:
                failed, last = failed + 1, now
                if name == "half_open" or failed >= self.failures:
                    name = "open"
        return (name, failed, last, probing, good), (admitted, name)


@dataclass
class Idempotency(Fold):
    """first for the first event of a key in `ttl` seconds, replay for later ones; replays don't prolong the time."""

    ttl: float = V.IDEMPOTENCY_SECONDS
    state_schema = "since double"
    output_schema = "outcome string"

    def start(self) -> tuple:
        return (-1.0,)

    def step(self, state: tuple, row: dict) -> tuple[tuple, tuple]:
        since, now = state[0], row["t"]
        if since >= 0 and now - since <= self.ttl:
            return (since,), ("replay",)
        return (now,), ("first",)


@dataclass
class Lifecycle(Fold):
    """Applies requested states one by one: an event whose step isn't allowed leaves the state as it is.

    Rows carry target, and expected (null for any): the state that the sender believes in.
    """

    state_schema = "state string, version long"
    output_schema = "previous string, state string, version long, outcome string"
    inputs = ("target", "expected")

    def start(self) -> tuple:
        return "registered", 0

    def step(self, state: tuple, row: dict) -> tuple[tuple, tuple]:
        name, version = state
        if row["expected"] is not None and row["expected"] != name:
            return state, (name, name, version, "conflict")
        if (name, row["target"]) not in V.TRANSITIONS:
            return state, (name, name, version, "invalid")
        return (row["target"], version + 1), (name, row["target"], version + 1, "applied")


@dataclass
class Sessions(Fold):
    """Session number of each event: a new one starts after more than `ttl` seconds without events."""

    ttl: float = V.SESSION_SECONDS
    state_schema = "number long, seen double"
    output_schema = "session long, opened boolean"

    def start(self) -> tuple:
        return 0, -1.0

    def step(self, state: tuple, row: dict) -> tuple[tuple, tuple]:
        number, seen = state
        opened = seen < 0 or row["t"] - seen > self.ttl
        return (number + opened, row["t"]), (number + opened, opened)


_KINDS = {"double": T.DoubleType(), "long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType()}


def schema_of(ddl: str) -> T.StructType:
    """A flat schema, read without a session so that workers can."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (part.split() for part in ddl.split(","))])


def run_fold(events: DataFrame, fold: Fold, key: str, time: Column, order: list[str], keep: list[str]) -> DataFrame:
    """keep columns and the fold's outputs for every event, its key's events taken in the order of time, then `order`.

    Null times come first as time 0. A key's group is streamed, not gathered.
    """
    seconds = F.coalesce((F.unix_micros(time.cast("timestamp")) / 1e6).cast("double"), F.lit(0.0))
    columns = list(dict.fromkeys([key, *keep, *fold.inputs, *order]))
    rows = events.select(*columns, seconds.alias("t")).repartition(key).sortWithinPartitions(key, "t", *order)
    kept = [rows.schema[c] for c in keep]
    out = T.StructType(kept + schema_of(fold.output_schema).fields)
    names = rows.columns
    at, held, used = names.index(key), [names.index(c) for c in keep], [(c, names.index(c)) for c in (*fold.inputs, "t")]
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, first = None, None, True
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            made = []
            for n, k in enumerate(cols[at]):
                if first or k != last:
                    last, state, first = k, fold.start(), False
                state, values = fold.step(state, {c: cols[i][n] for c, i in used})
                made.append(values)
            own = [batch.column(i) for i in held]
            new = [pa.array([m[j] for m in made], arrow.field(len(held) + j).type) for j in range(len(arrow) - len(held))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(own, arrow, strict=False)] + new, schema=arrow)

    return rows.mapInArrow(run, out)
