"""A stored vector index: cells of a coarse quantiser as table partitions, probed by the nearest cells of each query.

Cells are fitted on a bounded sample, every vector is in one. A cell's radius bounds how near any of its vectors can be
to a query, so that a search can go on until its answers are those of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.dense import answers, matrix, unit
from loomspark.operators.sparse import top_k
from loomspark.scratch import materialize

#: Vectors the cells are fitted on (those with the least hashes of their ids), a cell's share of them at least, most cells.
FIT_ROWS, ROWS_A_CELL, MOST_CELLS, ROUNDS = 65_536, 64, 1024, 12
#: Vectors of a block, and bytes of query blocks that are sent to the cells; more meet them in a join.
BLOCK, SENT_BYTES = 2048, 64 << 20
#: Rounding of scores, which a bound has to allow for.
SLACK = 1e-6


def fit_cells(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """Unit centres (a row each) of spherical k-means over at most FIT_ROWS vectors, the same in every run.

    Their number is the root of the sample's size, with ROWS_A_CELL vectors a cell or more; no vectors give one zero centre of no length.
    """
    live = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).select(F.col(vec_col).cast("array<double>").alias("v"), F.xxhash64(id_col).alias("h"))
    rows = live.orderBy("h", F.xxhash64("v")).limit(FIT_ROWS).select("v").toArrow()  # a bounded sample
    points = unit(matrix(rows.column("v"))) if rows.num_rows else np.zeros((1, 0))
    cells = max(1, min(MOST_CELLS, int(len(points) ** 0.5), len(points) // ROWS_A_CELL))
    random = np.random.default_rng(0)
    centres = points[random.choice(len(points), cells, replace=False)]
    for _ in range(ROUNDS):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), centres)
    return centres


def _placed(rows: DataFrame, centres: np.ndarray, id_col: str, vec_col: str) -> DataFrame:
    """rows with cell int and angle double, from the centre of the cell; null vectors are left out."""
    held = rows.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS rows

    @F.arrow_udf("struct<cell: int, angle: double>")
    def place(vectors: pa.Array) -> pa.Array:
        likeness = np.clip(unit(matrix(vectors)) @ held.value.T, -1, 1) if len(vectors) else np.zeros((0, 1))
        cell = likeness.argmax(axis=1)
        angle = np.arccos(likeness[np.arange(len(cell)), cell])
        return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], ["cell", "angle"])

    live = rows.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0))
    return live.withColumn("__place", place(F.col(vec_col).cast("array<double>"))).select("*", "__place.cell", "__place.angle").drop("__place")


class VectorIndex:
    """Folders vectors/ (a partition a cell, with the columns that came along), cells/ (rows and radius of a cell by
    writing), centres/ and shape/ (the columns) under path. `add` may be called again and again; null vectors are left out."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        self.spark, self.path, self.id_col, self.vec_col = spark, path.rstrip("/"), id_col, vec_col

    def create(self, vectors: DataFrame) -> VectorIndex:
        """Fit cells on a sample of vectors and store all of them; path must be new."""
        centres = fit_cells(vectors, self.id_col, self.vec_col)
        rows = [(n, c) for n, c in enumerate(centres.tolist())]
        self.spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/centres")
        vectors.limit(0).withColumns({"angle": F.lit(0.0), "cell": F.lit(0)}).coalesce(1).write.parquet(f"{self.path}/shape")
        return self.add(vectors)

    def add(self, vectors: DataFrame) -> VectorIndex:
        """Store more vectors in the cells there are. Rows are dealt by (cell, id), so a cell of any size is written by many tasks."""
        placed = _placed(vectors, self._centres(), self.id_col, self.vec_col)
        placed.repartitionByRange("cell", self.id_col).write.partitionBy("cell").mode("append").parquet(f"{self.path}/vectors")
        made = self._vectors().groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"))
        made.coalesce(1).write.mode("append").parquet(f"{self.path}/cells")  # a row a cell
        return self

    def _centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").toArrow()  # at most MOST_CELLS
        return matrix(rows.column("centre")) if rows.num_rows else np.zeros((1, 0))

    def _vectors(self) -> DataFrame:
        shape = self.spark.read.parquet(f"{self.path}/shape").schema  # an index without vectors has no file to tell it
        return self.spark.read.schema(shape).parquet(f"{self.path}/vectors")

    def cells(self) -> DataFrame:
        """(cell, rows, radius) of the cells that hold vectors."""
        return self.spark.read.parquet(f"{self.path}/cells").groupBy("cell").agg(F.max("rows").alias("rows"), F.max("radius").alias("radius"))

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, where: Column | None = None, threshold: float | None = None) -> DataFrame:
        """(qid, id, score, rank): the k most similar of the vectors in each query's `probes` nearest cells, by cosine.

        With exact, each query goes on to every other cell whose radius leaves room for a vector as good as its k-th, or
        for any if it has fewer, and the answers are those of dense.search(). `where` filters vectors before they count.
        Only files of cells that some query asks for are read.
        """
        asked = queries.select(F.col(self.id_col).cast("long").alias("qid"), F.col(self.vec_col).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
        floor = -np.inf if threshold is None else threshold
        found = self._answered(self._probing(asked.withColumn("least", F.lit(None).cast("double")), probes, False), k, where, floor)
        if not exact:
            return top_k(found, k)
        first = materialize(top_k(found, k), "probed")
        worst = first.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        rest = self._answered(self._probing(asked.join(worst, "qid", "left").select("qid", "v", F.coalesce("least", F.lit(float(floor))).alias("least")), probes, True), k, where, floor)
        return top_k(first.select("qid", "id", "score").union(rest), k)

    def _probing(self, asked: DataFrame, probes: int, others: bool) -> DataFrame:
        """(cell, qids, q): blocks of query vectors for each cell, the nearest cells or those of the others that may hold better vectors."""
        centres = self._centres()
        held = {x["cell"]: x["radius"] for x in self.cells().collect()}  # at most MOST_CELLS
        radius = np.array([held.get(n, -1.0) for n in range(len(centres))])
        sent = asked.sparkSession.sparkContext.broadcast((centres, radius))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, radius = sent.value
            live = np.flatnonzero(radius >= 0)
            for batch in batches:
                if not batch.num_rows or not len(live):
                    continue
                qids, q = batch.column(0).to_numpy(), unit(matrix(batch.column(1)))
                likeness = np.clip(q @ centres[live].T, -1, 1)
                near = np.zeros(likeness.shape, bool)
                np.put_along_axis(near, np.argsort(-likeness, axis=1, kind="stable")[:, :probes], True, axis=1)
                if others:
                    best = np.cos(np.maximum(0, np.arccos(likeness) - radius[live]))
                    near = ~near & (best + SLACK >= batch.column(2).to_numpy()[:, None])
                for j in np.flatnonzero(near.any(axis=0)):
                    at = np.flatnonzero(near[:, j])
                    yield pa.RecordBatch.from_arrays([pa.array([live[j]], pa.int32()), pa.array([qids[at]], pa.list_(pa.int64())), pa.array([q[at].tobytes()], pa.binary())], ["cell", "qids", "q"])

        return asked.mapInArrow(run, "cell int, qids array<long>, q binary")

    def _answered(self, probing: DataFrame, k: int, where: Column | None, floor: float) -> DataFrame:
        blocks = materialize(probing, "probes")
        wanted = [x["cell"] for x in blocks.select("cell").distinct().collect()]  # at most MOST_CELLS
        size = blocks.agg(F.sum(F.length("q") + 8 * F.size("qids"))).first()[0] or 0
        vectors = self._vectors()
        vectors = (vectors if where is None else vectors.where(where)).where(F.col("cell").isin(wanted))
        id_col, vec_col = self.id_col, self.vec_col

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                v = unit(matrix(batch.column(2)))
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    for i in range(0, len(at), BLOCK):
                        some = at[i : i + BLOCK]
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([ids[some]], pa.list_(pa.int64())), pa.array([v[some].tobytes()], pa.binary())], ["cell", "ids", "v"])

        rows = vectors.select(F.col("cell").cast("int").alias("cell"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        held = rows.mapInArrow(pack, "cell int, ids array<long>, v binary")
        met = held.join(F.broadcast(blocks) if size <= SENT_BYTES else blocks, "cell")
        return met.select("ids", "v", "qids", "q").mapInArrow(answers(k, floor), "qid long, id long, score double")
