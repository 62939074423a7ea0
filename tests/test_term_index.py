import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark import scratch
from loomspark.operators import graph, sparse
from loomspark.operators.term_index import TermIndex


def _texts(n, seed=5):
    """Texts over a skewed vocabulary; a third are copies of one text, some are null or empty."""
    r = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    made = [" ".join(r.choice(words, r.integers(3, 60), p=share / share.sum())) for _ in range(n)]
    for i in range(n):
        if i % 3 == 0:
            made[i] = made[0]
    made[7], made[11], made[13] = None, "", "of the"
    return [(i, t, "ab"[i % 2]) for i, t in enumerate(made)]


def _rows(frame):
    return sorted((x["qid"], x["rank"], x["id"], x["score"]) for x in frame.collect())


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    docs = spark.createDataFrame(_texts(900), "doc_id long, text string, kind string").repartition(3)
    index = TermIndex(spark, f"{tmp_path_factory.mktemp('terms')}/a", keep=("kind",)).add(docs.where("doc_id % 4 > 0"))
    return index.add(docs.where("doc_id % 4 = 0")), docs


def _questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_answers_are_those_of_scoring_every_posting(spark, held):
    index, docs = held
    asked = _questions(spark, "word290 word3 word1", "word1", "word250 word250 word12", "nothing known", None, "")
    for k in (1, 10, 2000):
        assert _rows(index.search(asked, k)) == _rows(sparse.search(docs, asked, k))


def test_filter_and_threshold_come_before_the_count(spark, held):
    index, docs = held
    asked = _questions(spark, "word290 word3 word1", "word7 word150")
    every = sparse.search(docs, asked, 2000).join(docs.select(F.col("doc_id").alias("id"), "kind"), "id").where("kind = 'b' and score > 3")
    want = _rows(sparse.top_k(every.select("qid", "id", "score"), 5))
    assert _rows(index.search(asked, 5, where=F.col("kind") == "b", threshold=3.0)) == want


def test_slices_that_cannot_matter_are_skipped(spark, held):
    index, _ = held
    reach = index.reach(_questions(spark, "word290 word3 word1"), 1).first()
    assert reach["scored"] < reach["slices"] / 2


def test_a_segment_without_its_row_is_not_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "doc_id long, text string")
    index = TermIndex(spark, f"{tmp_path}/a").add(docs)
    before = _rows(index.search(_questions(spark, "alpha"), 5))
    left = spark.read.parquet(f"{tmp_path}/a/postings").withColumn("segment", F.lit("lost"))
    left.write.partitionBy("segment", "bucket").mode("append").parquet(f"{tmp_path}/a/postings")
    assert _rows(index.search(_questions(spark, "alpha"), 5)) == before and len(before) == 2


def test_empty_index(spark, tmp_path):
    index = TermIndex(spark, f"{tmp_path}/a").add(spark.createDataFrame([], "doc_id long, text string"))
    assert index.search(_questions(spark, "alpha"), 5).count() == 0
    index.add(spark.createDataFrame([(9, "alpha")], "doc_id long, text string"))
    assert [x[2] for x in _rows(index.search(_questions(spark, "Alpha"), 5))] == [9]


def test_nodes_by_their_labels(spark, tmp_path):
    nodes = [(1, "Solar wind", "phenomenon"), (2, "Solar Orbiter", "mission"), (3, "Wind", "mission"), (4, None, "mission"), (5, "solar-wind model", "method")]
    index = graph.node_index(spark.createDataFrame(nodes, "node_id long, label string, node_type string"), f"{tmp_path}/n")
    asked = spark.createDataFrame([(1, "the solar wind"), (2, "wind")], "qid long, text string")
    found = lambda kind: {(x["qid"], x["rank"]): x["node_id"] for x in graph.indexed_node_search(index, asked, 3, kind).collect()}
    assert found(None) == {(1, 1): 1, (1, 2): 5, (1, 3): 3, (2, 1): 3, (2, 2): 1, (2, 3): 5}
    assert found("mission") == {(1, 1): 3, (1, 2): 2, (2, 1): 3}


def test_questions_of_the_same_words_are_asked_once(spark, held):
    index, _ = held
    asked = _questions(spark, *["word290 word3 word1"] * 5, "Word1 word3, word290", *["word7"] * 4)
    _, _, bounds, _, _ = index._search(asked, 3, "item_id", "text", None, None)
    assert {x["qid"] for x in bounds.select("qid").distinct().collect()} == {0, 6}
    got = {}
    for qid, rank, i, score in _rows(index.search(asked, 3)):
        got.setdefault(qid, []).append((rank, i, score))
    assert set(got) == set(range(10)) and all(got[q] == got[0] for q in range(6)) and all(got[q] == got[6] for q in range(6, 10))


def test_scratch_tables_go_once_they_are_spent(spark, held, tmp_path):
    before = set(scratch.paths_made(spark))
    TermIndex(spark, f"{tmp_path}/a").add(spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "doc_id long, text string"))
    assert set(scratch.paths_made(spark)) == before
    found = held[0].search(_questions(spark, "word290 word3"), 5, where=F.col("kind") == "b")
    assert len(set(scratch.paths_made(spark)) - before) == 1 and found.count() == 5
