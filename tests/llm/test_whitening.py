import math

import numpy as np
import pytest

from loomspark.llm import whitening
from loomspark.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<float>, x int, id int, c0 string"


def brute(rows, most=8):
    """(id, component) -> deviation, whitened up to its sign, explained; by NumPy and Python integers."""
    rows = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(rows), len(rows[0][1])
    sums = [sum(x[j] for _, x in rows) for j in range(d)]
    centred = np.array([[float((n * x[j] - sums[j])) / n for j in range(d)] for _, x in rows])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = [k for k in np.argsort(values)[::-1][:most] if values[k] > 1e-9]
    out = []
    for (i, x), c in zip(rows, centred, strict=True):
        deviation = sum((n * x[j] - sums[j]) ** 2 for j in range(d))
        out += [(i, k + 1, n, deviation, c @ vectors[:, o] / math.sqrt(values[o]), values[o] / values.sum()) for k, o in enumerate(order)]
    return out


def check(got, want, spread=1e-6):
    got = sorted(((x["vec_id"] or 0, x["component"], x["n"], x["deviation"], x["whitened"], x["explained"]) for x in got), key=lambda x: (x[0], x[1], abs(x[4])))
    want = sorted(((x[0] or 0, *x[1:]) for x in want), key=lambda x: (x[0], x[1], abs(x[4])))
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert all(abs(abs(a[4]) - abs(b[4])) < spread and abs(a[5] / b[5] - 1) < 1e-6 for a, b in zip(got, want, strict=True))
    for k in {x[1] for x in got}:
        signs = {np.sign(a[4] * b[4]) for a, b in zip(got, want, strict=True) if a[1] == k and abs(a[4]) > 1e-3}
        assert len(signs) <= 1 or len({x[0] for x in got}) * len({x[1] for x in got}) < len(got)


def test_query_against_numpy(spark, sf_dir):
    got = op11_whitening(spark, sf_dir).collect()
    rows = [(x["vec_id"], x["embedding"]) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert {x["identity_error"] for x in got} and max(x["identity_error"] for x in got) < 1e-9
    check(got, brute(rows))


@pytest.mark.parametrize("tile", [64, 3])
def test_odd_rows_and_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(whitening, "TILE", tile)
    r = np.random.default_rng(3)
    scale = np.array([9.0, 5.0, 3.0, 2.0, 1.0, 0.5, 0.2])
    rows = [(i, [float(c) for c in r.normal(size=7) * scale + 4]) for i in range(60)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (None, rows[6][1])]
    odd = [(100, None), (101, []), (102, [1.0, None, *[0.0] * 5]), (103, [float("nan"), *[0.0] * 6]), (104, [float("-inf"), *[0.0] * 6])]
    docs = spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows + odd] + [(105, [1.0, 2.0], 1, 2, "c")], SCHEMA).repartition(3)
    got = whitening.whiten(docs, 5).collect()
    as_float = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    check(got, brute(as_float, 5))
    assert got[0]["identity_error"] < 1e-9 and whitening.whiten(docs, 5).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_no_spread_gives_no_rows(spark):
    for rows in ([], [(1, [1.0, 2.0], 1, 1, "")], [(1, [1.0, 2.0], 1, 1, ""), (2, [1.0, 2.0], 1, 1, "")], [(1, None, 1, 1, "")]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_fewer_components_than_asked(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0], 1, 1, "") for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x["component"] for x in got} == {1} and abs(got[0]["explained"] - 1) < 1e-9


def test_wide_deviations(spark):
    rows = [(i, [float(i) * 3130, 1.0], 1, 1, "") for i in range(40)]
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), brute([(x[0], x[1]) for x in rows]))
    far = [(i, [float(i) * 1e30, 1.0], 1, 1, "") for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(far, SCHEMA)).collect()
    assert len(got) == 4 and any(x["deviation"] is None for x in got)


def test_a_pair_is_summed_for_each_upper_triangle_place(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, 1, ""), (2, [2.0, 0.0, 3.0], 1, 1, "")], SCHEMA)
    found = whitening.spread(whitening.integer_vectors(rows))
    assert found.n == 2 and found.sums == [200_000 + 3 * 1024, 200_000 + 2 * 1024, 200_000 + 6 * 1024]
    assert np.allclose(found.covariance, np.array([[1, -2, 0], [-2, 4, 0], [0, 0, 0]]) * 512**2)
