"""Vectors and similarity: V1-V5.

Exact k-nearest neighbours by squared L2 (V3) never emits one row per
(idea, catalog) pair.  Each task compares a block of ideas with a block of
catalog vectors in NumPy and emits at most ``k`` candidates per idea; a final
``row_number() <= k`` per idea (planned as a partial + final
``WindowGroupLimit`` around one shuffle on ``idea_id``) merges the candidates.

Two physical layouts, both exact:

* **broadcast scan** (ideas fit a checked byte budget): the idea matrix is
  shipped once to every executor and the catalog is scanned in place with
  ``mapInArrow``; the catalog is never shuffled.
* **block grid** (ideas above the budget): ideas are hashed into ``IB`` blocks
  and the catalog into ``CB`` blocks, each bounded in rows; every idea block is
  paired with every catalog block by an equi-join on the grid cell and the cell
  is solved by a co-grouped ``applyInArrow``.  Bytes moved are
  ``|ideas| x CB + |catalog| x IB``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venturelens.functions.text import hash_bucket, raw_tokens, token_hash
from venturelens.session import discard, written
from venturelens.schema import DEFAULT_K, ENCODER_DIM, TOKEN_SPLIT_PATTERN

# ---------------------------------------------------------------------------
# V1 embed_text
# ---------------------------------------------------------------------------

#: Text and rows that a task tokenises at a time, and words whose bucket it remembers.
RUN_BYTES, RUN_ROWS, CACHED_WORDS = 4 << 20, 4096, 400_000


def embed_text(df: DataFrame, text_col: str, id_col: str, out_col: str = "embedding",
               dim: int = ENCODER_DIM,
               encoder: Callable[[pd.Series], list] | None = None,
               method: str = "rows") -> DataFrame:
    """Text -> fixed-length float vector, as (``id_col``, ``out_col``).

    Default encoder: count the md5 bucket of every word of the whole text, then
    L2-normalise; a text without words gives the zero vector.

    * ``method="rows"`` (default): row-local, Arrow-batched - no shuffle and no
      join back to the rows; measured faster than the SQL form at sf0.1.
    * ``method="sql"``: the same definition in pure Spark SQL (explode, hash,
      partial aggregation per (document, bucket)); it mirrors the DuckDB oracle
      statement and needs no Python worker.

    ``encoder`` plugs in any batch function (for example a neural sentence
    encoder) through an Arrow-batched iterator pandas UDF.
    """
    if encoder is not None or method == "rows":
        return with_embedding(df.select(id_col, text_col), text_col, out_col, dim, encoder) \
            .select(id_col, out_col)
    toks = df.select(F.col(id_col).alias("_id"),
                     F.explode_outer(raw_tokens(text_col)).alias("_t"))
    # md5 in its own projection: it is computed once per token even though the
    # bucket expression reads two of its digits.
    hashed = toks.select("_id", token_hash(F.col("_t")).alias("_h"))
    buckets = hashed.select("_id", hash_bucket(F.col("_h"), dim).alias("_b"))
    counts = buckets.groupBy("_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    present = F.col("_b").isNotNull()
    per_doc = counts.groupBy("_id").agg(
        F.map_from_entries(F.collect_list(F.when(present, F.struct("_b", "_n")))).alias("_m"),
        F.sum(F.when(present, F.col("_n") * F.col("_n"))).alias("_ss"))
    norm = F.sqrt(F.col("_ss").cast("double"))
    vec = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.when(F.col("_ss") > 0, F.coalesce(F.col("_m")[i], F.lit(0)).cast("double") / norm)
        .otherwise(F.lit(0.0)).cast("float"))
    return per_doc.select(F.col("_id").alias(id_col), vec.alias(out_col))


def _hashed_words_batches(dim: int):
    """Arrow-batched, row-local form of the default encoder (no shuffle, no join).

    Same definition as the SQL form: ASCII word runs, md5 of the lower-cased
    word, first 32 bits modulo ``dim``, counts divided by their L2 norm in
    double, then rounded to float.

    Tokenising, distinct-word lookup and counting run in Arrow / NumPy kernels
    over runs of rows of bounded bytes (``_text_runs``); Python only hashes each
    distinct word once while a cache of CACHED_WORDS holds it.  So a task's memory
    depends neither on its rows nor on how many distinct words they have.
    """
    import hashlib

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def _encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[str, int] = {}

        def vectors(texts: pa.Array) -> np.ndarray:
            n = len(texts)
            words = pc.split_pattern_regex(pc.ascii_lower(texts), TOKEN_SPLIT_PATTERN)
            per_row = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            coded = pc.dictionary_encode(pc.list_flatten(words))
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.combine_chunks()
            vocab = coded.dictionary.to_pylist()
            bucket = np.empty(len(vocab), dtype=np.int64)
            for j, w in enumerate(vocab):
                b = cache.get(w)
                if b is None:
                    b = int(hashlib.md5(w.encode("ascii")).hexdigest()[:8], 16) % dim if w else -1
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[w] = b
                bucket[j] = b
            tok_bucket = bucket[coded.indices.to_numpy(zero_copy_only=False)]
            tok_row = np.repeat(np.arange(n, dtype=np.int64), per_row)
            keep = tok_bucket >= 0
            counts = np.bincount(tok_row[keep] * dim + tok_bucket[keep],
                                 minlength=n * dim).reshape(n, dim).astype(np.float64)
            norm = np.sqrt(np.einsum("ij,ij->i", counts, counts))
            return np.divide(counts, norm[:, None], out=np.zeros_like(counts),
                             where=norm[:, None] > 0).astype(np.float32)

        for texts in batches:
            n = len(texts)
            vec = np.empty((n, dim), np.float32)
            for at, to in _text_runs(texts):
                vec[at:to] = vectors(pc.fill_null(texts.slice(at, to - at), ""))
            offsets = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32))
            yield pa.ListArray.from_arrays(offsets, pa.array(vec.ravel()))

    return _encode


def _text_runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First and last place (exclusive) of runs of rows with at most RUN_BYTES of text and RUN_ROWS rows; one row at least."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < len(texts):
        to = min(at + RUN_ROWS, int(np.searchsorted(size, size[at] + RUN_BYTES, side="right")) - 1)
        to = max(at + 1, to)
        yield at, to
        at = to


def with_embedding(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = ENCODER_DIM,
                   encoder: Callable[[pd.Series], list] | None = None) -> DataFrame:
    """Add the vector of ``text_col`` as a column, row by row (map only)."""
    fn = pandas_encoder(encoder) if encoder is not None else _hashed_words_batches(dim)
    return df.withColumn(out_col, fn(F.col(text_col)))


def pandas_encoder(encode: Callable[[pd.Series], list]):
    """Wrap a batch encoder ``Series[str] -> list[vector]`` as an iterator UDF.

    The callable is built once per Python worker, so a model it loads lazily is
    loaded once, not per batch.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vecs = encode(texts.fillna(""))
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in vecs])

    return _encode


# ---------------------------------------------------------------------------
# V2 l2_distance (column expression, used for single pairs and checks)
# ---------------------------------------------------------------------------


def l2_distance(a: Column | str, b: Column | str) -> Column:
    """Squared L2 between two equal-length arrays, in double."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    diffs = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


# ---------------------------------------------------------------------------
# V3 top_k_similar
# ---------------------------------------------------------------------------

_CAND_SCHEMA = "idea_id long, id long, dist2 double"

#: Distances that a task holds at a time.
PRODUCT = 1 << 20
#: Bounds of the block grid: cells a core before blocks grow, and the rows up to which they do.
CELLS_PER_CORE, MOST_IDEA_ROWS, MOST_CATALOG_ROWS = 16, 4096, 32768


def _as_matrix(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.to_numpy()])


def _arrow_matrix(col: pa.Array) -> np.ndarray:
    """A list<float> column of equal-length vectors as an (n, d) float64 matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, 0))
    if col.null_count:
        raise ValueError("null vector in the catalog")
    lengths = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths in the catalog")
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, int(lengths[0]))


def _exact_rows(qv: np.ndarray, qid: int, cand: np.ndarray, c_ids: np.ndarray, c: np.ndarray,
                k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact top-k of one query row over a candidate index set (slow path)."""
    diff = c[cand] - qv
    exact = np.round(np.einsum("ij,ij->i", diff, diff), 6)
    ids = c_ids[cand]
    order = np.lexsort((ids, exact))[:k]
    return np.full(len(order), qid, dtype=np.int64), ids[order], exact[order]


def _block_topk(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray,
                k: int, exclude_self: bool, chunk: int = 512, pad: int = 8) -> pd.DataFrame:
    """Exact top-k (by round(dist2, 6), then id) of every query row in ``c``.

    A matrix product preselects; every row within a tolerance of the k-th
    preselected distance is then re-scored exactly as sum((q - c)^2), so ties
    and rounding are resolved on exact values, never on the approximation.

    Vectorised over query rows: the ``k + pad`` best approximate candidates of
    every row are re-scored and ordered at once.  Only a row whose near-tie set
    is larger than that window (for example many copies of one vector) takes the
    per-row path over its whole near-tie set, so the answer stays exact.
    """
    out_q, out_c, out_d = [], [], []
    if len(q_ids) == 0 or len(c_ids) == 0:
        return pd.DataFrame({"idea_id": np.array([], np.int64), "id": np.array([], np.int64),
                             "dist2": np.array([], np.float64)})
    cn = (c * c).sum(axis=1)
    cmax = float(cn.max())
    n = len(c_ids)
    kk = min(k, n)
    m = min(n, k + pad)
    chunk = max(1, min(chunk, PRODUCT // n))
    for s in range(0, len(q_ids), chunk):
        qb, qid = q[s:s + chunk], q_ids[s:s + chunk]
        rows = np.arange(len(qid))[:, None]
        qn = (qb * qb).sum(axis=1)
        approx = qn[:, None] + cn[None, :] - 2.0 * (qb @ c.T)
        if exclude_self:
            approx[qid[:, None] == c_ids[None, :]] = np.inf
        finite = np.isfinite(approx)
        kth = np.partition(approx, kk - 1, axis=1)[:, kk - 1]
        thr = kth + 1e-5 + 1e-9 * (qn + cmax)  # inf when fewer than k finite rows
        n_near = ((approx <= thr[:, None]) & finite).sum(axis=1)
        win = np.argpartition(approx, m - 1, axis=1)[:, :m] if m < n else np.broadcast_to(
            np.arange(n), (len(qid), n))
        diff = c[win] - qb[:, None, :]
        exact = np.round(np.einsum("rmd,rmd->rm", diff, diff), 6)
        exact[~finite[rows, win]] = np.inf
        ids = c_ids[win]
        order = np.lexsort((ids, exact), axis=1)[:, :kk]
        top_d = exact[rows, order]
        top_i = ids[rows, order]
        fast = n_near <= m
        keep = np.isfinite(top_d) & fast[:, None]
        out_q.append(np.broadcast_to(qid[:, None], top_d.shape)[keep])
        out_c.append(top_i[keep])
        out_d.append(top_d[keep])
        for r in np.nonzero(~fast)[0]:
            cand = np.nonzero((approx[r] <= thr[r]) & finite[r])[0]
            a, b, d = _exact_rows(qb[r], qid[r], cand, c_ids, c, k)
            out_q.append(a)
            out_c.append(b)
            out_d.append(d)
    return pd.DataFrame({"idea_id": np.concatenate(out_q).astype(np.int64),
                         "id": np.concatenate(out_c).astype(np.int64),
                         "dist2": np.concatenate(out_d).astype(np.float64)})


def _merge_topk(frames: list[pd.DataFrame], k: int) -> pd.DataFrame:
    df = pd.concat(frames, ignore_index=True)
    df = df.sort_values(["idea_id", "dist2", "id"], kind="mergesort")
    return df.groupby("idea_id", sort=False).head(k)


def _final_topk(cands: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("idea_id").orderBy(F.col("dist2"), F.col("id"))
    return (cands.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .select("idea_id", F.col("rank").cast("int").alias("rank"), "id", "dist2"))


def top_k_similar(ideas: DataFrame, catalog: DataFrame, k: int = DEFAULT_K,
                  exclude_self: bool = False, idea_id: str = "idea_id", cat_id: str = "id",
                  vec_col: str = "embedding", broadcast_budget_bytes: int = 64 << 20,
                  idea_block_rows: int = 4096, catalog_block_rows: int = 32768,
                  min_catalog_blocks: int | None = None) -> DataFrame:
    """V3: exact k nearest catalog rows per idea, as (idea_id, rank, id, dist2).

    Distances are squared L2 in double, rounded to 6 decimals; ties go to the
    smaller id.  Fewer than ``k`` catalog rows give the rows there are.
    """
    spark = ideas.sparkSession
    q = ideas.select(F.col(idea_id).alias("idea_id"), F.col(vec_col).alias("embedding"))
    cat = catalog.select(F.col(cat_id).alias("id"), F.col(vec_col).alias("embedding"))
    # stored once: encoded one time, and sized before anything reaches the driver
    q = written(q, "ideas")
    size = q.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).alias("floats")).first()
    if (size["floats"] or 0) * 8 + size["n"] * 8 <= broadcast_budget_bytes:
        local = q.toPandas()
        discard(q)
        return _final_topk(_broadcast_scan(spark, local, cat, k, exclude_self), k)
    cands = _block_grid(q, cat, k, exclude_self, idea_block_rows, catalog_block_rows,
                        min_catalog_blocks)
    return _final_topk(cands, k)


def _broadcast_scan(spark, local: pd.DataFrame, cat: DataFrame, k: int,
                    exclude_self: bool) -> DataFrame:
    q_ids = local["idea_id"].to_numpy(dtype=np.int64)
    q_mat = _as_matrix(local["embedding"]) if len(local) else np.zeros((0, 0))
    bq = spark.sparkContext.broadcast((q_ids, q_mat))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mat = bq.value
        parts = []
        for b in batches:
            if b.num_rows == 0 or len(ids) == 0:
                continue
            parts.append(_block_topk(ids, mat, b.column("id").to_numpy(zero_copy_only=False),
                                     _arrow_matrix(b.column("embedding")), k, exclude_self))
            if len(parts) >= 8:
                parts = [_merge_topk(parts, k)]
        if parts:
            yield pa.RecordBatch.from_pandas(_merge_topk(parts, k), preserve_index=False)

    # Arrow in and out: the catalog vectors go from the Arrow batch's flat value
    # buffer to one NumPy matrix, with no per-row Python objects
    return cat.mapInArrow(scan, _CAND_SCHEMA)


def grid_shape(n_q: int, n_c: int, idea_block_rows: int, catalog_block_rows: int, cores: int) -> tuple[int, int]:
    """Blocks of ideas and of catalog rows, about as many rows each as asked for.

    A grid of very many cells costs more in copies of the rows and in cells than in comparisons.  Beyond CELLS_PER_CORE
    cells a core, blocks are doubled, the smaller side first, up to the rows of the default blocks
    (MOST_IDEA_ROWS, MOST_CATALOG_ROWS), which bound a task's memory.
    """
    while (math.ceil(n_q / idea_block_rows) * math.ceil(n_c / catalog_block_rows) > CELLS_PER_CORE * cores
           and (idea_block_rows < MOST_IDEA_ROWS or catalog_block_rows < MOST_CATALOG_ROWS)):
        if idea_block_rows < MOST_IDEA_ROWS and (idea_block_rows <= catalog_block_rows or catalog_block_rows >= MOST_CATALOG_ROWS):
            idea_block_rows = min(2 * idea_block_rows, MOST_IDEA_ROWS)
        else:
            catalog_block_rows = min(2 * catalog_block_rows, MOST_CATALOG_ROWS)
    return max(1, math.ceil(n_q / idea_block_rows)), max(1, math.ceil(n_c / catalog_block_rows), cores)


def _block_grid(q: DataFrame, cat: DataFrame, k: int, exclude_self: bool,
                idea_block_rows: int, catalog_block_rows: int,
                min_catalog_blocks: int | None) -> DataFrame:
    spark = q.sparkSession
    n_q = q.count()
    n_c = cat.count()
    ib, cb = grid_shape(n_q, n_c, idea_block_rows, catalog_block_rows,
                        min_catalog_blocks or spark.sparkContext.defaultParallelism)
    qg = (q.withColumn("ib", F.pmod(F.xxhash64("idea_id"), F.lit(ib)).cast("int"))
          .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1)))))
    cg = (cat.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(cb)).cast("int"))
          .withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(ib - 1)))))

    def cell(qt: pa.Table, ct: pa.Table) -> pa.Table:
        if qt.num_rows == 0 or ct.num_rows == 0:
            empty = np.array([], np.int64)
            out = _block_topk(empty, np.zeros((0, 0)), empty, np.zeros((0, 0)), k, exclude_self)
        else:
            out = _block_topk(qt.column("idea_id").to_numpy(), _arrow_matrix(qt.column("embedding")),
                              ct.column("id").to_numpy(), _arrow_matrix(ct.column("embedding")),
                              k, exclude_self)
        return pa.Table.from_pandas(out, preserve_index=False)

    return (qg.groupBy("ib", "cb").cogroup(cg.groupBy("ib", "cb"))
            .applyInArrow(cell, _CAND_SCHEMA))


# ---------------------------------------------------------------------------
# V4 top_match and V5 hstack_features
# ---------------------------------------------------------------------------


def top_match(neighbours: DataFrame) -> DataFrame:
    """V4: the nearest row per idea (rank 1)."""
    return neighbours.where(F.col("rank") == 1)


def hstack_features(df: DataFrame, vec_col: str, numeric_cols: list[str],
                    out_col: str = "features") -> DataFrame:
    """V5: vector then numeric columns, in order, as one ML vector."""
    from pyspark.ml.functions import array_to_vector

    arr = F.concat(F.col(vec_col).cast("array<double>"),
                   F.array(*[F.col(c).cast("double") for c in numeric_cols]))
    return df.withColumn(out_col, array_to_vector(arr))
