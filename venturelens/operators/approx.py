"""Approximate k nearest neighbours when ideas and catalog are both large.

A locality-sensitive index with several tables.  In each table a vector's bucket is the
signs of its products with a few random directions, taken from the catalog's
mean.  Catalog rows are in one bucket per table.  An idea looks
into ``probes`` buckets per table: its own, and those whose signs differ where its
products are nearest to zero (least sum of squares first).  Ideas meet only the catalog rows of their buckets, by an
equi-join, and distances there are exact.

How many probes reach the asked recall depends on the data, so it is measured: a
bounded sample of the ideas is searched exactly, and the least number of
probes that finds the asked share of their neighbours is taken.
Ideas that found fewer than k rows are searched exactly, so every idea is answered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venturelens.operators.cells import group_topk
from venturelens.operators.vectors import _arrow_matrix, _as_matrix, _final_topk, top_k_similar
from venturelens.schema import DEFAULT_K
from venturelens.session import written

#: Ideas whose neighbours are searched exactly to choose the number of probes.
SAMPLE_IDEAS = 256
#: Signs that a probe may differ in: those of the products nearest to zero.
FLIPPED = 10
_CODED = "tbl int, bucket long, {id} long, embedding array<float>"


@dataclass(frozen=True)
class HashTables:
    """Directions (tables x dimensions x bits) and the point that they are taken from."""

    planes: np.ndarray
    centre: np.ndarray

    @property
    def bits(self) -> int:
        return self.planes.shape[2]

    def products(self, x: np.ndarray) -> np.ndarray:
        """vectors x tables x bits."""
        return np.einsum("nd,tdb->ntb", x - self.centre, self.planes)

    def buckets(self, products: np.ndarray) -> np.ndarray:
        return (products > 0) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))

    def probes(self, products: np.ndarray, most: int) -> np.ndarray:
        """vectors x tables x probes: buckets in the order in which they are looked into."""
        m = min(self.bits, FLIPPED)
        subsets = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
        margin = products ** 2
        near = np.argsort(margin, axis=2, kind="stable")[:, :, :m]
        cost = np.take_along_axis(margin, near, 2) @ subsets.T
        best = np.argsort(cost, axis=2, kind="stable")[:, :, :most]
        flips = (subsets[best] * (np.int64(1) << near.astype(np.int64))[:, :, None, :]).sum(3)
        return self.buckets(products)[:, :, None] ^ flips


def hash_tables(catalog: DataFrame, tables: int = 8, bucket_rows: int = 1024, seed: int = 7) -> HashTables | None:
    """Tables for (id, embedding) rows: as many signs as bring an average bucket to ``bucket_rows``; None for no rows."""
    mean = catalog.select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centre = np.array([r["m"] for r in mean.orderBy("i").collect()])     # a row per dimension
    n = catalog.count()
    if not n:
        return None
    bits = min(40, max(1, math.ceil(math.log2(max(2.0, n / bucket_rows)))))
    planes = np.random.default_rng(seed).normal(size=(tables, len(centre), bits))
    return HashTables(planes, centre)


def _coded(rows: DataFrame, index: HashTables, id_col: str, probes: int) -> DataFrame:
    """(tbl, bucket, id, embedding): a row per table and probe."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 22) // (index.planes.shape[0] * (1 << min(index.bits, FLIPPED))))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                products = index.products(_arrow_matrix(part.column("embedding")))
                found = index.probes(products, probes) if probes > 1 else index.buckets(products)[:, :, None]
                n, t, p = found.shape
                take = pa.array(np.repeat(np.arange(n), t * p))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n)), pa.array(found.ravel()),
                     part.column(id_col).take(take), part.column("embedding").take(take)], names=["tbl", "bucket", id_col, "embedding"])

    return rows.select(id_col, "embedding").mapInArrow(run, _CODED.format(id=id_col))


def needed_probes(index: HashTables, ideas: np.ndarray, neighbours: np.ndarray, recall: float) -> int:
    """Least number of probes with which the asked share of the pairs (idea, neighbour) share a bucket."""
    most = 1 << min(index.bits, FLIPPED)
    probes = index.probes(index.products(ideas), most)
    own = index.buckets(index.products(neighbours))
    hit = probes == own[:, :, None]
    first = np.where(hit.any(2), hit.argmax(2) + 1, most + 1).min(1)     # over the tables
    order = np.sort(first)
    return int(min(most, order[min(len(order) - 1, math.ceil(recall * len(order)) - 1)]))


def approx_top_k(ideas: DataFrame, catalog: DataFrame, k: int = DEFAULT_K, exclude_self: bool = False, recall: float = 0.95,
                 tables: int = 8, bucket_rows: int = 1024, idea_rows: int = 4096, catalog_rows: int = 32768) -> DataFrame:
    """idea_id, rank, id, dist2 as ``top_k_similar``, with about the asked ``recall`` of its rows.

    ``ideas``: idea_id, embedding; ``catalog``: id, embedding.  Distances are exact; every idea has as many rows as it has there.
    """
    q = written(ideas.select("idea_id", "embedding"), "ideas")
    c = written(catalog.select("id", "embedding"), "catalog")
    index = hash_tables(c, tables, bucket_rows)
    if index is None:
        return top_k_similar(q, c, k, exclude_self)
    sample = written(q.orderBy(F.xxhash64("idea_id"), "idea_id").limit(SAMPLE_IDEAS), "sample")
    truth = top_k_similar(sample, c, k, exclude_self)
    pairs = (truth.join(sample.withColumnRenamed("embedding", "x"), "idea_id")
             .join(c.withColumnRenamed("embedding", "y"), "id").select("x", "y").toPandas())     # SAMPLE_IDEAS * k rows
    if len(pairs) == 0:
        return top_k_similar(q, c, k, exclude_self)
    probes = needed_probes(index, _as_matrix(pairs["x"]), _as_matrix(pairs["y"]), recall)
    found = group_topk(_coded(q, index, "idea_id", probes), _coded(c, index, "id", 1), ["tbl", "bucket"], k, exclude_self,
                       idea_rows, catalog_rows)
    best = written(_final_topk(found.distinct(), k), "nearest")
    full = best.groupBy("idea_id").count().where(F.col("count") >= k).select("idea_id")
    short = written(q.join(full, "idea_id", "left_anti"), "short")
    if short.isEmpty():
        return best
    rest = top_k_similar(short, c, k, exclude_self)
    return best.join(full, "idea_id", "left_semi").unionByName(rest)


def recall_at(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: share of the rows of ``truth`` (idea_id, id) that ``found`` has."""
    hits = truth.select("idea_id", "id").join(found.select("idea_id", "id", F.lit(1.0).alias("hit")), ["idea_id", "id"], "left")
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
