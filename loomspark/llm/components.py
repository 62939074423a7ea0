"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import written


def star_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """edges(u long, v long) -> (node long, root long), one row per node that has an edge, itself as root included.

    root is the smallest node reachable. Each round is a bounded number of shuffles on node keys whose groups are
    only ever reduced by min(), so a hub never has to fit into a task; every round is written to the shared folder, and
    the one before it deleted.
    Null endpoints and self-loops are ignored; an empty edge table gives an empty result.
    """
    spark, spent = edges.sparkSession, []
    pairs = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    links = written(spark, lambda: pairs, tag, spent)
    mark = _mark(links)
    while mark[0]:
        links = written(spark, lambda links=links: _small_star(_large_star(links)), tag, spent)
        seen, mark = mark, _mark(links)
        if seen == mark:
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its smallest neighbour."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    return up.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
