"""Whitening of embeddings: every pair of dimensions is summed as a column aggregate, LAPACK decomposes the covariance.

The sums are exact or of centred doubles, so their size never eats the figures of the spread. Only sums a dimension and a
pair of dimensions reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import named

#: Dimensions of a tile of the covariance; vectors of more dimensions are summed tile by tile in the same aggregation.
TILE = 64
#: Fixed by the integer form of an entry: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Integers of entries are held to this bound, so that doubles have them exactly.
LARGEST = 1 << 52
#: Components of a smaller share of the variance have no direction of their own and are left out.
LEAST_SHARE = 1e-12


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id long, x array<long>): the integer form of each vector that holds finite entries only.

    Null and empty vectors, and those with null or infinite entries or NaN, are dropped, as are vectors of another number
    of dimensions than the most (of equally many, the larger). Integers beyond LARGEST are held to it. Null and repeated ids stay.
    """
    c = named([vec_col])[0].cast("array<double>")
    sound = rows.select(named([id_col])[0].cast("long").alias("id"), c.alias("v")).where("v is not null and size(v) > 0").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    whole = lambda x: (F.floor(F.least(F.greatest(x * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))) + SHIFT).cast("long")
    return sound.where(F.size("v") == d).select("id", F.transform("v", whole).alias("x"))


@dataclass
class Spread:
    """n vectors, their sums S, covariance V (divisor n), and the largest distance of n * x from S in any dimension."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    widest: int

    @property
    def means(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _centred(x: Column, i: int, sums: list[int], n: int) -> Column:
    """x[i] - S[i] / n; the whole part of the mean is taken off as an integer."""
    whole, rest = divmod(sums[i], n)
    return (x[i] - F.lit(whole)).cast("double") - F.lit(rest / n)


def spread(vectors: DataFrame) -> Spread | None:
    """Sums and covariance of integer_vectors(), None if there are none.

    One aggregation has the sums, a second a sum of centred products for each pair i <= j of dimensions. For more than TILE
    dimensions the second one groups by pairs of tiles, so that its code stays as large as for one.
    """
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    x = F.col("x")
    made = vectors.agg(F.count("*").alias("n"), *(f(x[i].cast("decimal(38,0)") if f is F.sum else x[i]).alias(f"{f.__name__}{i}") for i in range(d) for f in (F.sum, F.min, F.max))).first()
    n, sums = made["n"], [int(made[f"sum{i}"]) for i in range(d)]
    widest = max(max(n * made[f"max{i}"] - s, s - n * made[f"min{i}"]) for i, s in enumerate(sums))
    return Spread(n, sums, _covariance(vectors, sums, n), widest)


def _covariance(vectors: DataFrame, sums: list[int], n: int) -> np.ndarray:
    d, x = len(sums), F.col("x")
    out = np.zeros((d, d))
    if d <= TILE:
        centred = vectors.select(*(_centred(x, i, sums, n).alias(f"c{i}") for i in range(d)))
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        found = centred.agg(*(F.expr(f"sum(c{i} * c{j}) AS p{i}_{j}") for i, j in pairs)).first()
        for (i, j), value in zip(pairs, found, strict=True):
            out[i, j] = out[j, i] = value / n
        return out
    starts = list(range(0, d, TILE))
    whole, rest = F.lit([s // n for s in sums]), F.lit([s % n / n for s in sums])
    centred = F.zip_with(F.zip_with("x", whole, lambda a, b: (a - b).cast("double")), rest, lambda a, b: a - b)
    tiles = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in starts for b in starts if a <= b))
    dealt = vectors.select(centred.alias("c")).select("c", F.explode(tiles).alias("t"))
    side = lambda t, k: F.coalesce(F.get(F.col("c"), F.col(f"t.{t}") + k), F.lit(0.0))  # noqa: E731  0 beyond the last dimension
    cut = dealt.select("t", *(side(t, k).alias(f"{t}{k}") for t in "ab" for k in range(TILE)))
    pairs = [(i, j) for i in range(TILE) for j in range(TILE)]
    for row in cut.groupBy("t").agg(*(F.expr(f"sum(a{i} * b{j}) AS p{i}_{j}") for i, j in pairs)).toLocalIterator():
        a, b = row["t"]
        tile = np.array(row[1:]).reshape(TILE, TILE)[: d - a, : d - b] / n
        out[a : a + TILE, b : b + TILE] = tile
        out[b : b + TILE, a : a + TILE] = tile.T
    return out


def principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (rows) of up to `most` components that have a share of the variance."""
    values, vectors = np.linalg.eigh(covariance)  # LAPACK's symmetric driver
    order = np.argsort(values)[::-1][:most]
    order = order[values[order] > LEAST_SHARE * max(np.trace(covariance), 0)]
    return values[order], vectors[:, order].T


def _dot(x: Column, weights: np.ndarray, sums: list[int], n: int) -> Column:
    """Sum of weights[i] * (x[i] - S[i] / n), as a balanced tree of sums."""
    terms = [_centred(x, i, sums, n) * F.lit(float(w)) for i, w in enumerate(weights)]
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) // 2 * 2 :]
    return terms[0]


def _deviation(found: Spread) -> Column:
    """Sum of (n * x - S)^2 over the dimensions, exact: in longs where the widest distance allows it, else in decimals.

    A sum beyond 64 bits gives null.
    """
    s = F.lit(found.sums)
    if len(found.sums) * found.widest**2 < 1 << 63:
        gaps = F.zip_with("x", s, lambda a, b: a * F.lit(found.n) - b)
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g * g)
    wide = "decimal(38,0)"
    gaps = F.zip_with("x", F.lit([str(v) for v in found.sums]), lambda a, b: (a.cast(wide) * F.lit(str(found.n)).cast(wide)).cast(wide) - b.cast(wide))
    return F.aggregate(gaps, F.lit("0").cast(wide), lambda acc, g: F.try_add(acc, F.try_multiply(g, g).try_cast(wide)).try_cast(wide)).try_cast("long")


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double),
    a row for each vector of integer_vectors(rows) and each of the first `components` components, by falling eigenvalue from 1.

    The vectors are fitted on all of them. whitened is a vector's place on a component over the root of its eigenvalue;
    explained the eigenvalue's share of the trace; identity_error, one value, the largest entry in which the covariance of
    all whitened columns differs from the identity. Components that hold none of the variance are left out, so equal
    vectors, one vector or an empty table give no rows. Null and repeated ids and repeated vectors each give their own rows;
    ties of eigenvalues go to LAPACK's order; other columns of rows are not read.
    """
    vectors = integer_vectors(rows, id_col, vec_col)
    found = spread(vectors)
    values, axes = principal(found.covariance, components) if found else (np.zeros(0), np.zeros((0, 0)))
    fields = ("component int", "whitened double", "explained double")
    if not len(values):
        return rows.sparkSession.createDataFrame([], f"vec_id long, n long, deviation long, {', '.join(fields)}, identity_error double").select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    trace = float(np.trace(found.covariance))
    placed = vectors.select("id", "x", *((_dot(F.col("x"), a / np.sqrt(e), found.sums, found.n)).alias(f"w{k}") for k, (e, a) in enumerate(zip(values, axes, strict=True))))
    error = _identity_error(placed, len(values), found.n)
    each = F.array(*(F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k}").alias("whitened"), F.lit(float(e / trace)).alias("explained")) for k, e in enumerate(values)))
    rows = placed.select(F.col("id").alias("vec_id"), F.lit(found.n).cast("long").alias("n"), _deviation(found).alias("deviation"), F.explode(each).alias("c"))
    return rows.select("vec_id", "c.component", "n", "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))


def _identity_error(placed: DataFrame, k: int, n: int) -> float:
    means = placed.agg(*(F.avg(f"w{i}").alias(f"m{i}") for i in range(k))).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    made = placed.agg(*(F.sum((F.col(f"w{i}") - F.lit(means[i])) * (F.col(f"w{j}") - F.lit(means[j]))).alias(f"p{i}_{j}") for i, j in pairs)).first()
    return max(abs(s / n - (i == j)) for (i, j), s in zip(pairs, made, strict=True))
