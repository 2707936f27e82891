"""Exact top-k inside matching groups of ideas and catalog rows, however large a group is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venturelens.operators.vectors import _CAND_SCHEMA, _arrow_matrix, _block_topk
from venturelens.session import written


def _solve(k: int, exclude_self: bool):
    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        if q.num_rows and c.num_rows:
            found = _block_topk(q.column("idea_id").to_numpy(), _arrow_matrix(q.column("embedding")),
                                c.column("id").to_numpy(), _arrow_matrix(c.column("embedding")), k, exclude_self)
        else:
            none = np.array([], np.int64)
            found = _block_topk(none, np.zeros((0, 0)), none, np.zeros((0, 0)), k, exclude_self)
        return pa.Table.from_pandas(found, preserve_index=False)
    return cell


def group_topk(ideas: DataFrame, catalog: DataFrame, keys: list[str], k: int, exclude_self: bool,
               idea_rows: int = 4096, catalog_rows: int = 32768) -> DataFrame:
    """Candidates (idea_id, id, dist2): the k nearest rows of its groups for every idea.

    ``ideas`` (keys, idea_id, embedding) and ``catalog`` (keys, id, embedding) are grouped by ``keys``.  Only groups
    that both sides have are shuffled, and a group larger than ``idea_rows`` x ``catalog_rows`` is
    cut into several cells, so no task holds more than that.
    """
    n_q = ideas.groupBy(*keys).agg(F.count(F.lit(1)).alias("_q"))
    n_c = catalog.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    # written: Spark knows its bytes, and broadcasts it only while it is small
    parts = written(n_q.join(n_c, keys).select(*keys, F.ceil(F.col("_q") / idea_rows).cast("int").alias("_iw"),
                                               F.ceil(F.col("_c") / catalog_rows).cast("int").alias("_cw")), "cells")
    q = (ideas.join(parts, keys).withColumn("_i", F.pmod(F.xxhash64("idea_id"), F.col("_iw")).cast("int"))
         .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_cw") - 1))))
    c = (catalog.join(parts, keys).withColumn("_j", F.pmod(F.xxhash64("id"), F.col("_cw")).cast("int"))
         .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_iw") - 1))))
    cell = [*keys, "_i", "_j"]
    return (q.select(*cell, "idea_id", "embedding").groupBy(*cell)
            .cogroup(c.select(*cell, "id", "embedding").groupBy(*cell)).applyInArrow(_solve(k, exclude_self), _CAND_SCHEMA))
