"""Streams of the keyed folds, queue consumption with retries, and late or unreadable events."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomspark import values as V
from loomspark.streaming.folds import Fold, schema_of

#: The state store that the processors need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FoldProcessor(StatefulProcessor):
    """Runs a fold over a key's rows in time order, its state kept between batches and dropped after `idle_ms`."""

    def __init__(self, fold: Fold, key: str, keep: list[str], order: list[str], idle_ms: int | None = None) -> None:
        self.fold, self.key, self.keep, self.order, self.idle_ms = fold, key, keep, order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("fold", schema_of(self.fold.state_schema), self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["t", *self.order], kind="stable")
        state = tuple(self.value.get()) if self.value.exists() else self.fold.start()
        made = []
        for row in batch.to_dict("records"):
            state, values = self.fold.step(state, {k: None if v is pd.NA or v is None or v != v else v for k, v in row.items()})
            made.append(values)
        self.value.update(state)
        names = [f.name for f in schema_of(self.fold.output_schema)]
        yield pd.concat([batch[self.keep].reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    def close(self) -> None:
        pass


def stream_fold(events: DataFrame, fold: Fold, key: str, time: str, keep: list[str], order: list[str] = (), idle_ms: int | None = None) -> DataFrame:
    """The stream twin of run_fold(): rows of one micro-batch are ordered among themselves, state spans batches."""
    columns = list(dict.fromkeys([key, *keep, *fold.inputs, *order]))
    rows = events.select(*columns, (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("t"))
    out = T.StructType([rows.schema[c] for c in keep] + schema_of(fold.output_schema).fields)
    return rows.groupBy(key).transformWithStateInPandas(FoldProcessor(fold, key, list(keep), list(order), idle_ms), out, outputMode="Update", timeMode="ProcessingTime" if idle_ms else "None")


def retry_delay(attempts: Column) -> Column:
    """Seconds until the next try: doubling from the base, never more than the most."""
    return F.least(F.lit(float(V.RETRY_MOST)), V.RETRY_BASE * F.pow(F.lit(2.0), attempts - 1))


MESSAGE = "document_id string, content_hash string, s3_key string"


def triage(messages: DataFrame, body: str = "body", attempts: str = "attempts", schema: str = MESSAGE, ok: Column | None = None) -> DataFrame:
    """messages with parsed, route (done, retry or dead) and delay: unreadable and worn-out ones are dead letters.

    ok tells which ones their handler managed; without it every readable one counts as managed.
    """
    parsed = F.from_json(body, schema)
    broken = parsed.getField(schema.split()[0]).isNull()
    done = F.lit(True) if ok is None else ok
    route = F.when(broken, "dead").when(done, "done").when(F.col(attempts) >= V.RETRIES, "dead").otherwise("retry")
    return messages.withColumn("parsed", parsed).withColumn("route", route).withColumn("delay", F.when(F.col("route") == "retry", retry_delay(F.col(attempts))))


def dead_letter(messages: DataFrame, error: Column, body: str = "body") -> DataFrame:
    """Dead messages as they are sent on: the original body wrapped with its error."""
    return messages.where("route = 'dead'").select(F.to_json(F.struct(F.col(body).alias("original_message"), error.alias("error"), F.col("attempts").alias("retry_count"))).alias("body"))


def consume(spark: SparkSession, path: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 10) -> None:
    """Work off a folder of JSON messages: every batch is handled, then its offsets are checkpointed, so a crash repeats
    a batch and never loses one; handle() has to be idempotent for the batch id it gets."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def once(sink: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes a batch under its id, replacing what an earlier try left."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return handle


def send_batches(messages: DataFrame, id_col: str, body: str, sender: Callable[[list[dict]], list[str]], size: int = 10) -> DataFrame:
    """(id, sent): messages handed to sender in batches of `size`, which returns the ids it accepted.

    A batch that raises counts as not sent and stops no other. A task that runs again sends again, as any queue with
    at-least-once delivery has it; use it in foreachBatch.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.to_dict("records")
            sent: set[str] = set()
            for i in range(0, len(rows), size):
                try:
                    sent |= set(sender(rows[i : i + size]))
                except Exception:  # noqa: BLE001  whatever a sender raises belongs to its batch
                    continue
            yield pd.DataFrame({"id": frame["id"], "sent": frame["id"].isin(sent)})

    return messages.select(F.col(id_col).cast("string").alias("id"), F.col(body).alias("body")).mapInPandas(run, "id string, sent boolean")


def latest(updates: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The last update of each key; for a stream use it in foreachBatch with upsert()."""
    names = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(time, tie)).alias("__last")).select(key, "__last.*")


def open_updates(updates: DataFrame, status: str = "status") -> DataFrame:
    """Updates of jobs that still run; a terminal one ends a subscription."""
    return updates.where(~F.col(status).isin("completed", "failed", "cancelled"))


def split_late(events: DataFrame, time: str, now: Column, most: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """(in time, late): what a watermark of `most` would drop goes to a quarantine sink instead."""
    late = F.col(time) < now - F.expr(f"interval {most}")
    return events.where(~late), events.where(late)


def token_events(deltas: list[str], hold: int = 50) -> Iterator[tuple[str, str]]:
    """(text, s) and (citation, n) of a streamed answer: text waits until a marker may be complete or `hold` is passed."""
    marker, held = re.compile(r"\[(\d+)\]"), ""
    for delta in deltas:
        held += delta
        if delta and (m := marker.search(held)):
            if m.start():
                yield "text", held[: m.start()]
            yield "citation", m[1]
            held = held[m.end() :]
        elif delta and len(held) > hold:
            yield "text", held
            held = ""
    if held:
        yield "text", held


def split_tokens(rows: DataFrame, id_col: str, deltas_col: str) -> DataFrame:
    """(id, seq, kind, payload) of each answer's array of deltas; the buffer makes it sequential within an answer."""
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("payload", T.StringType())]))

    @F.pandas_udf(kind)
    def split(deltas: pd.Series) -> pd.Series:
        return deltas.map(lambda d: [{"kind": k, "payload": p} for k, p in token_events(list(d))])

    return rows.select(F.col(id_col).alias("id"), F.posexplode(split(F.col(deltas_col))).alias("seq", "e")).select("id", "seq", "e.*")


def rate_key(user: Column, api_key: Column, forwarded: Column, ip: Column) -> Column:
    """Whose bucket a request draws from: user, then key, then first forwarded address, then address."""
    hop = F.trim(F.substring_index(forwarded, ",", 1))
    return F.coalesce(F.concat(F.lit("user:"), user), F.concat(F.lit("key:"), api_key), F.concat(F.lit("ip:"), F.when(F.length(hop) > 0, hop)), F.concat(F.lit("ip:"), ip), F.lit("ip:unknown"))
