"""Connected components of a graph whose edges lie in a table, by alternating large and small stars.

Every step is a minimum for each node and a join back, both narrow; nothing about nodes,
edges or components is gathered by the driver but whether a step changed anything. A node
with very many edges is combined on the map side and split by adaptive execution.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written


def _least(edges: DataFrame) -> DataFrame:
    """For each a its edges' least end, under the complement of a: so that the join deals both sides anew and can split a common a."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.bitwise_not("a").alias("na"), F.least("m", "a").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), F.col("a") == F.bitwise_not("na")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(_least(down), F.col("a") == F.bitwise_not("na"))
    return joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.groupBy("a").agg(F.min("b").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b long. (node, component) of every node with an edge to another; component is the smallest node reachable."""
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", narrow=True)
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = print_of(edges)
    while before[0]:
        edges = written(_small_star(_large_star(edges)), "edges", narrow=True)
        now = print_of(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def smallest_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Within a task: the smallest index that each of n can reach over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new
