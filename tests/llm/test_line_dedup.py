import random

from pyspark.sql import functions as F

from loomspark.llm import line_dedup
from tests.llm import brute


def _run(docs):
    made = line_dedup.dedup_lines(docs)
    return {x["doc_id"]: (x["__n_lines"], x["__n_dropped"], x["text"] or "") for x in made.collect()}


def test_many_partitions_and_a_hot_line(spark):
    r = random.Random(2)
    lines = [f"line number {i} of the pool" for i in range(60)] + ["short", "", "  Padded Line Text \t"]
    rows = [(i, "\n".join(["a very common line", *(r.choice(lines) for _ in range(r.randint(0, 12)))])) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert _run(docs) == brute.line_dedup(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_length_is_in_code_points(spark):
    rows = [(1, "ééééééééé\néééééééééé"), (2, "ééééééééé\nÉÉÉ\nEéééééééééé\néééééééééé")]
    assert _run(spark.createDataFrame(rows, "doc_id long, text string")) == brute.line_dedup(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    made = line_dedup.dedup_lines(odd_docs)
    assert set(odd_docs.columns) < set(made.columns) and made.count() == odd_docs.count()
    got = {x["doc_id"]: x for x in made.collect()}
    assert got[2]["text"] == "own words here\nshort" and got[1]["__n_dropped"] == 0
    assert got[None]["text"] == "null id" and got[10]["__n_dropped"] == 1
    assert (got[3]["text"], got[3]["__n_lines"]) == (None, 1) and (got[4]["text"], got[4]["__n_lines"]) == ("", 1)
    assert got[12]["__n_dropped"] == 0 and line_dedup.dedup_lines(no_docs).count() == 0


def test_bitmaps_rebuild_the_kept_lines(spark):
    rows = [(1, "first shared line\nx"), (2, "keep me please\nfirst shared line\nlast")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bitmaps = line_dedup.line_bitmaps(docs).collect()
    assert [(b["id"], b["n_dropped"], list(line_dedup.keep_bits(bytes(b["bitmap"])))) for b in bitmaps] == [(2, 1, [True, False])]
    assert docs.where(F.lit(False)).count() == 0
