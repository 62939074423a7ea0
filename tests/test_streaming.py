"""Streams against their batch twins."""

from pyspark.sql import functions as F

from loomspark.streaming import folds, stateful


def test_stream_fold_equals_batch_fold(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ok", F.col("event_type") != "error").where("user_id < 12")
    ordered = events.orderBy("ts", "event_id").collect()
    schema = events.schema
    half = len(ordered) // 2
    for n, part in enumerate((ordered[:half], ordered[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{n}")
    fold = folds.CircuitBreaker(failures=2, wait=3 * 86_400.0)
    want = {x["event_id"]: (x["admitted"], x["state"]) for x in folds.run_fold(events, fold, "user_id", F.col("ts"), ["event_id"], ["event_id"]).collect()}
    got = {}
    for n in (0, 1):
        spark.read.parquet(f"{tmp_path}/in{n}").write.mode("append").parquet(f"{tmp_path}/feed")
        stream = stateful.stream_fold(spark.readStream.schema(schema).parquet(f"{tmp_path}/feed"), fold, "user_id", "ts", ["event_id"], ["event_id"])
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda b, _: got.update({x["event_id"]: (x["admitted"], x["state"]) for x in b.collect()})).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert got == want


def test_queue_is_worked_off_once(spark, tmp_path):
    spark.createDataFrame([(f"m{i}", '{"document_id":"d"}' if i else "broken", i) for i in range(4)], "id string, body string, attempts int").write.json(f"{tmp_path}/queue")
    sink = stateful.once(f"{tmp_path}/out")
    for _ in range(2):
        stateful.consume(spark, f"{tmp_path}/queue", "id string, body string, attempts int", sink, f"{tmp_path}/cp")
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() == 4
    routed = {x["id"]: x["route"] for x in stateful.triage(rows, ok=F.col("id") == "m1").collect()}
    assert routed == {"m0": "dead", "m1": "done", "m2": "retry", "m3": "dead"}


def test_watermarked_counts_agree_with_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.col("ts").cast("timestamp")).select("t", "event_type", "value")
    events.write.parquet(f"{tmp_path}/in")
    flush = events.agg((F.max("t") + F.expr("interval 3 days")).alias("t")).select("t", F.lit("flush").alias("event_type"), F.lit(0.0).alias("value"))
    windows = lambda rows: rows.groupBy(F.window("t", "1 day"), "event_type").agg(F.count("*").alias("n"))
    got: dict = {}

    def keep(batch, _):
        got.update({(x["window"]["start"], x["event_type"]): x["n"] for x in batch.collect()})

    for rows in (None, flush):
        if rows is not None:
            rows.write.mode("append").parquet(f"{tmp_path}/in")
        stream = windows(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in").withWatermark("t", "1 hour"))
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination(60)
    assert got == {(x["window"]["start"], x["event_type"]): x["n"] for x in windows(events).collect()}
