"""Exact k nearest neighbours with ball bounds: far blocks of the catalog are never read.

A bounded sample of catalog vectors are pivots; every catalog row belongs to the block of its
nearest pivot, and a block is inside the ball of its largest distance.
Each idea first searches the block of its nearest pivot, which bounds its k-th
distance from above.  By the triangle inequality no row of a block is nearer than
the pivot's distance less the ball's radius, so a second pass searches only
the blocks whose bound does not exceed that k-th distance (ties included).
The result equals ``top_k_similar``; on data without clusters most blocks stay open, and that operator is the better choice.
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
from venturelens.operators.vectors import _arrow_matrix, _final_topk
from venturelens.schema import DEFAULT_K
from venturelens.session import written

#: Most pivots: their vectors are what the driver holds and broadcasts.
MOST_PIVOTS = 4096
#: Room for the six decimals to which squared distances are rounded, and for float error.
SLACK = 1e-5


@dataclass(frozen=True)
class Balls:
    """Pivots and the radius of each one's block (negative: no rows)."""

    pivots: np.ndarray
    radius: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None] - 2.0 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(square, 0.0))

    def open(self, x: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """vectors x blocks: whether the block may hold a row within the squared distance ``kth``."""
        bound = self.distances(x) - self.radius[None] - SLACK
        return (self.radius >= 0)[None] & (np.maximum(bound, 0.0) ** 2 <= kth[:, None] + SLACK)


def _placed(rows: DataFrame, id_col: str, balls: Balls) -> DataFrame:
    """(block, id, embedding, far): the nearest pivot's block and the distance to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                d = balls.distances(_arrow_matrix(part.column("embedding")))
                block = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.astype(np.int32)), part.column(id_col), part.column("embedding"),
                     pa.array(d[np.arange(len(d)), block])], names=["block", id_col, "embedding", "far"])

    return rows.select(id_col, "embedding").mapInArrow(run, f"block int, {id_col} long, embedding array<float>, far double")


def open_cells(ideas: DataFrame, balls: Balls) -> DataFrame:
    """(block, idea_id, embedding) of the blocks still open for each idea (idea_id, embedding, home, kth)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                kth = part.column("kth").to_numpy(zero_copy_only=False)
                still = balls.open(_arrow_matrix(part.column("embedding")), kth)
                still[np.arange(len(kth)), part.column("home").to_numpy()] = False
                row, block = np.nonzero(still)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.astype(np.int32)), part.column("idea_id").take(take), part.column("embedding").take(take)],
                    names=["block", "idea_id", "embedding"])

    return ideas.select("idea_id", "embedding", "home", "kth").mapInArrow(run, "block int, idea_id long, embedding array<float>")


def choose_pivots(catalog: DataFrame, block_rows: int) -> np.ndarray:
    """A bounded sample of the catalog's vectors, by the hash of their ids."""
    n = catalog.count()
    count = min(MOST_PIVOTS, max(1, math.ceil(n / block_rows)))
    rows = catalog.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(count).select("embedding").collect()
    return np.unique(np.array([r["embedding"] for r in rows], np.float64), axis=0) if rows else np.zeros((0, 0))


def pruned_top_k(ideas: DataFrame, catalog: DataFrame, k: int = DEFAULT_K, exclude_self: bool = False,
                 block_rows: int = 8192, idea_rows: int = 4096, catalog_rows: int = 32768,
                 report: dict | None = None) -> DataFrame:
    """idea_id, rank, id, dist2: equal to ``top_k_similar``.  ``report`` gets the cells searched and all there are."""
    q = written(ideas.select("idea_id", F.col("embedding").cast("array<float>").alias("embedding")), "ideas")
    c = catalog.select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    pivots = choose_pivots(c, block_rows)
    if not len(pivots):
        return q.sparkSession.createDataFrame([], "idea_id long, rank int, id long, dist2 double")
    placed = written(_placed(c, "id", Balls(pivots, np.zeros(len(pivots)))), "blocks")
    radius = np.full(len(pivots), -1.0)
    for r in placed.groupBy("block").agg(F.max("far").alias("far")).collect():      # a row per pivot
        radius[r["block"]] = r["far"]
    # ideas go home to a block that has rows
    live = np.flatnonzero(radius >= 0)
    homes = Balls(pivots[live], radius[live])
    back = F.array(*[F.lit(int(b)) for b in live])
    home = written(_placed(q, "idea_id", homes).withColumn("block", F.get(back, F.col("block"))), "homes")
    rows = placed.select("block", "id", "embedding")
    near = written(group_topk(home.select("block", "idea_id", "embedding"), rows, ["block"], k, exclude_self, idea_rows, catalog_rows), "near")
    kth = _final_topk(near, k).where(F.col("rank") == k).select("idea_id", F.col("dist2").alias("kth"))
    asked = home.join(kth, "idea_id", "left").select("idea_id", "embedding", F.col("block").alias("home"),
                                                     F.coalesce("kth", F.lit(float("inf"))).alias("kth"))
    cells = written(open_cells(asked, Balls(pivots, radius)), "open")
    if report is not None:
        n = q.count()
        report.update(searched=n + cells.count(), all=n * len(live))
    far = group_topk(cells, rows, ["block"], k, exclude_self, idea_rows, catalog_rows)
    return _final_topk(near.unionByName(far), k)
