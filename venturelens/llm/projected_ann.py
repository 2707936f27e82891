"""Approximate nearest neighbours by stable projections under a kd-tree.

Unit vectors are projected to ``DIMS`` dimensions by a Gaussian (2-stable)
matrix: the squared projected distance of two rows, over their squared
distance, is chi-square distributed with DIMS degrees of freedom.

*Index.*  A kd-tree over the projections of a bounded sample (``SAMPLE`` rows)
cuts space into cells; every row is indexed in its cell, and a cell with many
rows (a much copied vector) is divided by hash into parts of bounded size; rows
of one id and unit vector are indexed once, with their number.  The
index is a Parquet table in the shared folder; the driver keeps one box per
cell (at most ``MOST_CELLS``).

*Search.*  Within a part, a kd-tree gives the rows by leaf in order of
projected distance, and their true distances are computed, until the
chi-square test holds: a row at the k-th best distance found so far would, with
probability ``confidence``, have shown up by now.  Queries first search their own cell;
with the k-th distance found there, the same test tells which other cells may
hold nearer rows, and only those are searched.

Nearness is the cosine in double precision; ties go to the smaller id.  Vectors
that are null, zero, of another length than most rows, or that hold a null or
non-finite component take no part, nor do rows without id.  Repeated rows are
candidates of their own, an id is searched once, and never finds itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venturelens.session import written

DIMS, SAMPLE, MOST_CELLS = 8, 20_000, 4096
ROWS, QUERIES, LEAF = 8192, 2048, 64


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    def cdf(x):
        term, total = 1.0, 0.0
        for i in range(dims // 2):
            total += term
            term *= x / 2 / (i + 1)
        return 1 - math.exp(-x / 2) * total
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def _matrix(dim: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, DIMS))


class Cells:
    """kd-tree of median cuts over a sample of projections; the leaves are the cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.levels = max(0, int(math.log2(max(1, min(cells, MOST_CELLS, max(1, len(sample) // 16))))))
        self.axis = np.zeros((1 << self.levels) - 1, np.int64)
        self.cut = np.zeros((1 << self.levels) - 1)
        groups = [sample]
        for level in range(self.levels):
            nxt = []
            for i, g in enumerate(groups):
                at = (1 << level) - 1 + i
                axis = int(np.argmax(g.max(0) - g.min(0))) if len(g) else 0
                cut = float(np.median(g[:, axis])) if len(g) else 0.0
                self.axis[at], self.cut[at] = axis, cut
                nxt += [g[g[:, axis] <= cut], g[g[:, axis] > cut]]
            groups = nxt

    def of(self, p: np.ndarray) -> np.ndarray:
        at = np.zeros(len(p), np.int64)
        rows = np.arange(len(p))
        for _ in range(self.levels):
            at = 2 * at + 1 + (p[rows, self.axis[at]] > self.cut[at])
        return at - ((1 << self.levels) - 1)


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return (vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                   & F.exists("v", lambda x: x != 0)))


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _project(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return np.einsum("ij,jk->ik", x, matrix)


class Index:
    """Rows by cell, and the boxes of the cells."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding"):
        rows = _usable(vectors, key, vector)
        dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        self.dim, self.n = (dims["d"], dims["count"]) if dims else (1, 0)
        rows = rows.where(F.size("v") == self.dim)
        share = min(1.0, SAMPLE / max(1, self.n))
        picked = (rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(share * (1 << 30)))
                  .dropDuplicates(["vec_id", "v"]).orderBy("vec_id", "v").select("v").toArrow().combine_chunks())
        matrix = _matrix(self.dim)
        sample = _project(_units(pa.chunked_array(picked.column("v")).combine_chunks(), self.dim), matrix) if picked.num_rows else np.zeros((0, DIMS))
        tree = Cells(sample, -(-self.n // ROWS))
        dim = self.dim
        ps = [f"p{i}" for i in range(DIMS)]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _units(batch.column("v"), dim)
                    p = _project(x, matrix)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id"), pa.array(tree.of(p), pa.int64()), pa.array([r.tobytes() for r in x], pa.binary()),
                         *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(DIMS))], names=["vec_id", "cell", "unit", *ps])

        def placed(some: DataFrame) -> DataFrame:
            return some.mapInArrow(place, "vec_id bigint, cell bigint, unit binary, " + ", ".join(f"{p} double" for p in ps))

        # only rows of repeated ids are shuffled to be counted
        again = written(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "ann-repeated")
        if again.isEmpty():
            indexed = placed(rows).withColumn("copies", F.lit(1).cast("long"))
        else:
            indexed = (placed(rows.join(again, "vec_id", "left_anti")).withColumn("copies", F.lit(1).cast("long"))
                       .unionByName(placed(rows.join(again, "vec_id", "left_semi")).groupBy("vec_id", "unit")
                                    .agg(*(F.min(c).alias(c) for c in ("cell", *ps)), F.count(F.lit(1)).alias("copies"))))
        self.rows = written(indexed, "ann-index")
        boxes = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *(F.min(p).alias(f"lo{p}") for p in ps),
                                              *(F.max(p).alias(f"hi{p}") for p in ps)).orderBy("cell").toPandas()
        self.cell = boxes["cell"].to_numpy(np.int64)
        self.lo, self.hi = boxes[[f"lo{p}" for p in ps]].to_numpy(float), boxes[[f"hi{p}" for p in ps]].to_numpy(float)
        self.parts = self.rows.sparkSession.createDataFrame(
            [(int(c), int(-(-n // ROWS))) for c, n in zip(boxes["cell"], boxes["n"])], "cell long, parts int")

    def search(self, queries: DataFrame, k: int = 5, confidence: float = 0.97) -> DataFrame:
        """query_id, rank, vec_id and score: the k nearest found of every row of ``queries`` (a subset of self.rows)."""
        reach = chi_square_quantile(confidence)
        q = (queries.drop("copies").dropDuplicates(["vec_id"]).withColumnRenamed("vec_id", "query_id")
             .withColumn("known", F.lit(None).cast("double")))
        home = self._search(q, k, reach)
        top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        home = written(home.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).drop("rank"), "ann-home")
        kth = home.groupBy("query_id").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("m"))
        q = (q.drop("known").join(kth, "query_id", "left")
             .withColumn("known", F.when(F.col("m") >= k, F.col("worst"))).drop("worst", "m"))
        rest = self._search(q.mapInArrow(self._elsewhere(reach), q.schema), k, reach)
        return (home.unionByName(rest).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))

    def _elsewhere(self, reach: float):
        """Sends each query to the other cells that the chi-square test leaves open."""
        lo, hi, cell, ps = self.lo, self.hi, self.cell, [f"p{i}" for i in range(DIMS)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = np.stack([batch.column(c).to_numpy() for c in ps], 1)
                known = batch.column("known").to_numpy(zero_copy_only=False)
                radius = np.where(np.isnan(known), np.inf, reach * np.maximum(0, 2 - 2 * known) * (1 + 1e-9) + 1e-9)
                own = batch.column("cell").to_numpy()
                for c in range(len(cell)):
                    gap = np.maximum(0, np.maximum(lo[c] - p, p - hi[c]))
                    go = ((gap * gap).sum(1) <= radius) & (own != cell[c])
                    if go.any():
                        part = batch.filter(pa.array(go))
                        yield part.set_column(part.schema.get_field_index("cell"), "cell", pa.array(np.full(part.num_rows, cell[c]), pa.int64()))

        return run

    def _search(self, q: DataFrame, k: int, reach: float) -> DataFrame:
        """The k best of every query in every part of its cell."""
        ps = [f"p{i}" for i in range(DIMS)]
        q = written(q, "ann-queries")
        # queries of a cell in blocks; the cell's parts are read once for each block
        blocks = q.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).cast("int").alias("blocks")).join(self.parts, "cell")
        ask = (q.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
               .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("blocks", "parts"))
        have = (self.rows.join(blocks, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "unit"), F.col("parts")).cast("int"))
                .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "parts"))
        dim = self.dim

        def find(rows: pa.Table, asked: pa.Table) -> pa.Table:
            out = [[], [], []]
            if rows.num_rows and asked.num_rows:
                ids = rows.column("vec_id").to_numpy()
                x = np.frombuffer(b"".join(rows.column("unit").to_pylist()), float).reshape(-1, dim)
                p = np.stack([rows.column(c).to_numpy() for c in ps], 1)
                leaves = _leaves(p)
                order = np.concatenate(leaves)
                ids, x, p = ids[order], x[order], p[order]
                copies = np.minimum(rows.column("copies").to_numpy()[order], k)
                ends = np.cumsum([len(leaf) for leaf in leaves])
                starts = np.concatenate([[0], ends[:-1]])
                lo = np.minimum.reduceat(p, starts, axis=0)
                hi = np.maximum.reduceat(p, starts, axis=0)
                known = asked.column("known").to_numpy()
                qp = np.stack([asked.column(c).to_numpy() for c in ps], 1)
                for i, (qid, unit) in enumerate(zip(asked.column("query_id").to_pylist(), asked.column("unit").to_pylist())):
                    v = np.frombuffer(unit, float)
                    gap = np.maximum(0, np.maximum(lo - qp[i], qp[i] - hi))
                    near = (gap * gap).sum(1)
                    turn = np.argsort(near, kind="stable")
                    bound = -np.inf if np.isnan(known[i]) else known[i]
                    got_id, got = np.zeros(0, np.int64), np.zeros(0)
                    at, step = 0, 2
                    # leaf after leaf in projected order, until the chi-square test holds
                    while at < len(turn) and near[turn[at]] <= reach * max(0.0, 2 - 2 * bound) * (1 + 1e-9) + 1e-9:
                        pick = turn[at:at + step]
                        pick = pick[near[pick] <= reach * max(0.0, 2 - 2 * bound) * (1 + 1e-9) + 1e-9]
                        member = np.concatenate([np.arange(starts[j], ends[j]) for j in pick])
                        member = member[ids[member] != qid]
                        s = np.einsum("ij,j->i", x[member], v)
                        ok = s >= bound
                        times = copies[member][ok]
                        got_id, got = np.concatenate([got_id, np.repeat(ids[member][ok], times)]), np.concatenate([got, np.repeat(s[ok], times)])
                        best = np.lexsort((got_id, -got))[:k]
                        got_id, got = got_id[best], got[best]
                        if len(got) == k:
                            bound = max(bound, got[-1])
                        at, step = at + step, min(2 * step, 32)
                    out[0] += [qid] * len(got)
                    out[1] += got_id.tolist()
                    out[2] += got.tolist()
            return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

        key = ["cell", "part", "block"]
        return (have.select(*key, "vec_id", "unit", "copies", *ps).groupBy(*key)
                .cogroup(ask.select(*key, "query_id", "unit", "known", *ps).groupBy(*key))
                .applyInArrow(find, "query_id bigint, vec_id bigint, score double"))


def _leaves(p: np.ndarray) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree: halves along the widest axis, ties split anywhere."""
    done, todo = [], [np.arange(len(p))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            done.append(rows)
            continue
        axis = int(np.argmax(np.ptp(p[rows], axis=0)))
        half = len(rows) // 2
        rows = rows[np.argpartition(p[rows, axis], half)]
        todo += [rows[:half], rows[half:]]
    return done
