"""Writers: artifacts, events, keyed tables, and a queue kept as an append-only table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_artifacts(rows: DataFrame, path: str, document_id: str = "document_id", name: str = "artifact") -> None:
    """JSON artifacts under document_id=.../artifact=..., one folder a document and kind."""
    rows.write.mode("append").partitionBy(document_id, name).json(path)


def event(kind: str, key: Column, *fields: Column) -> Column:
    """An event as a JSON string with a deterministic id."""
    return F.to_json(F.struct(F.lit(kind).alias("event_type"), F.sha2(F.concat_ws("|", F.lit(kind), key.cast("string"), *[f.cast("string") for f in fields]), 256).alias("event_id"), key.alias("document_id"), *fields))


def publish(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def vector_points(chunks: DataFrame) -> DataFrame:
    """Points of a vector index: the payload's metadata overrides its own keys, sparse parts only where there are terms."""
    return chunks.withColumn("sparse", F.when(F.size("sparse") > 0, F.col("sparse")))


def replace_table(rows: DataFrame, path: str) -> None:
    """Write a new version beside the old one and leave the swap to the caller's catalogue or manifest."""
    rows.write.mode("errorifexists").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Add rows, such as a document's chunks, to a table of Parquet files."""
    rows.write.mode("append").parquet(path)
