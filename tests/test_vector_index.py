import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import dense, vector_index
from loomspark.operators.vector_index import VectorIndex
from loomspark.plans import retrieval

SCHEMA = "vec_id long, embedding array<float>, kind int"


def _clustered(n, d=16, groups=12, spread=0.15, seed=1):
    r = np.random.default_rng(seed)
    base = r.normal(size=(groups, d))
    group = np.where(r.random(n) < 0.35, 0, r.integers(0, groups, n))  # one holds a third of all rows
    return [(i, [float(x) for x in base[g] + spread * r.normal(size=d)], int(g)) for i, g in enumerate(group)]


def _answers(frame):
    return sorted((x["qid"], x["rank"], x["id"], x["score"]) for x in frame.collect())


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rows = spark.createDataFrame(_clustered(3000), SCHEMA).repartition(3)
    return VectorIndex(spark, f"{tmp_path_factory.mktemp('index')}/a").create(rows), rows


def test_exact_answers_are_those_of_a_scan(clustered):
    index, rows = clustered
    asked = rows.where("vec_id % 100 = 0")
    want = _answers(dense.search(rows, asked, 7))
    assert _answers(index.search(asked, 7, probes=1, exact=True)) == want
    assert _answers(index.search(asked, 7, probes=3, exact=True, where=F.col("kind") > 4, threshold=0.3)) == _answers(dense.search(rows.where("kind > 4"), asked, 7, threshold=0.3))
    many = rows.where("kind = 1").limit(3)
    assert _answers(index.search(many, 5000, exact=True)) == _answers(dense.search(rows, many, 5000))


def test_probes_read_few_files_and_find_most(clustered):
    index, rows = clustered
    asked = rows.where("vec_id % 100 = 0")
    want = {x[:1] + x[2:3] for x in _answers(dense.search(rows, asked, 10))}
    got = {x[:1] + x[2:3] for x in _answers(index.search(asked, 10, probes=6))}
    assert len(got & want) >= 0.9 * len(want)
    one = rows.where("kind = 3").limit(1)
    plan = index.search(one, 10, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell#" in plan and index.cells().count() > 20


def test_recall_on_the_table(spark, sf_dir):
    want = {(x["qid"], x["vec_id"]) for x in retrieval.dense_topk(spark, sf_dir).collect()}
    got = {(x["qid"], x["vec_id"]) for x in retrieval.index_probed_topk(spark, sf_dir).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


def test_odd_vectors_and_later_rows(spark, tmp_path):
    rows = [(1, [0.0, 0.0], 1), (2, None, 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [-1.0, 0.1], 1), (5, [], 1)]
    index = VectorIndex(spark, f"{tmp_path}/a").create(spark.createDataFrame(rows, SCHEMA))
    later = [(6, [0.9, 0.1], 1), (7, [0.0, 0.0], 1)]
    index.add(spark.createDataFrame(later, SCHEMA))
    every = spark.createDataFrame([x for x in rows + later if x[1]], SCHEMA)
    for k in (1, 3, 50):
        assert _answers(index.search(every, k, probes=1, exact=True)) == _answers(dense.search(every, every, k))
    assert index.search(every.where("false"), 3, exact=True).count() == 0


def test_empty_index(spark, tmp_path):
    index = VectorIndex(spark, f"{tmp_path}/a").create(spark.createDataFrame([], SCHEMA))
    asked = spark.createDataFrame([(1, [1.0], 1)], SCHEMA)
    assert index.search(asked, 3).count() == 0 and index.search(asked, 3, exact=True).count() == 0
    assert vector_index.fit_cells(asked).shape == (1, 1)
