"""Connected components of a large graph, by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venturelens.session import discard, written

#: Rows of one key that a task joins; the rows of a key beyond are dealt to more tasks.
SPLIT = 2000
#: Edges that a task contracts at a time.
CONTRACT = 1 << 20


def split_join(rows: DataFrame, side: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``side`` on ``key``; the rows of a key held by many are dealt by ``by`` over several tasks.

    Only the side's rows of such keys are repeated, once per SPLIT rows.
    """
    many = written(rows.groupBy(key).count().where(F.col("count") > SPLIT)
                   .select(key, F.ceil(F.col("count") / SPLIT).alias("_ways")), "join-many")
    left = rows.join(many, key, "left").withColumn(
        "_way", F.when(F.col("_ways").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_ways"))).cast("long")).drop("_ways")
    right = side.join(many, key, "left").withColumn(
        "_way", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_ways", F.lit(1).cast("long")) - 1))).drop("_ways")
    return left.join(right, [key, "_way"]).drop("_way")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the given edges, for nodes that are not the smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        if (low == np.maximum(root[x], root[y])).all():
            break
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root != (jump := root[root])).any():
            root = jump
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def _contracted(edges: DataFrame, tasks: int, bound: int) -> DataFrame:
    """The edges, each ``bound`` of a task replaced by a forest that connects the same nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
            if sum(map(len, a)) >= 2 * bound:
                a, b = ([x] for x in forest(np.concatenate(a), np.concatenate(b)))
                if len(a[0]) >= bound:      # it no longer shrinks: pass it on
                    yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(b[0])], names=["a", "b"])
                    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(np.concatenate(a), np.concatenate(b))], names=["a", "b"])

    return edges.coalesce(tasks).mapInArrow(run, "a bigint, b bigint")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return split_join(both.where("b > a"), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    other = split_join(down, least, "a", "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return other.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, contract: int = CONTRACT) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: two long columns).

    The component is its smallest node.  Tasks first contract ``contract`` edges
    each to forests; where one task's forest is all that is left, it is the result.
    Otherwise each round connects the larger
    neighbours, then the smaller ones, of every node to the smallest, and
    contracts again; it ends when a round changes nothing.  Minima are aggregated map-side,
    no neighbourhood is gathered, and rows of a hub are dealt over several tasks.  Rounds grow with
    the logarithm of the nodes; each is written to the shared folder, the one before is removed.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark, before, tasks = now, edges, max(1, -(-now[0] // contract))
        forests = _contracted(edges, tasks, contract)
        if tasks == 1:
            edges = written(forests, "edges")
            discard(before)
            break
        forests = written(forests, "edges")
        edges = written(_small_star(_large_star(forests)), "edges")
        discard(before, forests)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
