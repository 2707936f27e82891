"""Exact top-k: brute force agreement, both layouts, ties, partition independence."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from venturelens.operators.vectors import embed_text, l2_distance, top_k_similar


def brute(q, c, k, exclude_self=False):
    out = []
    for i, qv in q:
        cands = []
        for j, cv in c:
            if exclude_self and i == j:
                continue
            d = round(float(sum((np.float64(a) - np.float64(b)) ** 2 for a, b in zip(qv, cv))), 6)
            cands.append((d, j))
        cands.sort()
        out += [(i, r + 1, j, d) for r, (d, j) in enumerate(cands[:k])]
    return sorted(out)


def frames(spark, n_q=23, n_c=211, dim=8, dup=True, seed=3):
    rng = np.random.default_rng(seed)
    cvecs = rng.normal(size=(n_c, dim)).astype(np.float32)
    if dup:  # a third of the catalog is one copied vector: ties everywhere
        cvecs[: n_c // 3] = cvecs[0]
    qvecs = rng.normal(size=(n_q, dim)).astype(np.float32)
    q = [(int(i), [float(x) for x in v]) for i, v in enumerate(qvecs)]
    c = [(int(1000 + i), [float(x) for x in v]) for i, v in enumerate(cvecs)]
    qdf = spark.createDataFrame(q, "idea_id long, embedding array<float>")
    cdf = spark.createDataFrame(c, "id long, embedding array<float>")
    # round-trip through float32 exactly as Spark stores it
    qf = [(r.idea_id, list(r.embedding)) for r in qdf.collect()]
    cf = [(r.id, list(r.embedding)) for r in cdf.collect()]
    return qdf, cdf, qf, cf


def rows(df):
    return sorted((r.idea_id, r.rank, r.id, r.dist2) for r in df.collect())


@pytest.mark.parametrize("layout", ["broadcast", "grid"])
@pytest.mark.parametrize("parts", [1, 4, 17])
def test_topk_matches_brute_force(spark, layout, parts):
    qdf, cdf, qf, cf = frames(spark)
    kw = {} if layout == "broadcast" else dict(broadcast_budget_bytes=0, idea_block_rows=5,
                                                catalog_block_rows=40)
    got = rows(top_k_similar(qdf.repartition(parts), cdf.repartition(parts), k=5, **kw))
    assert got == brute(qf, cf, 5)


def test_fewer_rows_than_k_and_exclude_self(spark):
    qdf, cdf, qf, cf = frames(spark, n_q=4, n_c=3, dup=False)
    assert rows(top_k_similar(qdf, cdf, k=5)) == brute(qf, cf, 5)
    same = cdf.withColumnRenamed("id", "idea_id")
    got = rows(top_k_similar(same, cdf, k=2, exclude_self=True))
    assert got == brute([(i, v) for i, v in cf], cf, 2, exclude_self=True)


def test_l2_expression(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<float>, b array<float>")
    assert df.select(l2_distance("a", "b")).first()[0] == 25.0


def test_encoder_unit_length_and_empty(spark):
    df = spark.createDataFrame([(1, "Alpha beta beta"), (2, None), (3, "!!!"), (4, "alpha BETA beta")],
                               "doc_id long, text string")
    v = {r.doc_id: np.array(r.embedding, dtype=np.float64) for r in embed_text(df, "text", "doc_id").collect()}
    assert set(v) == {1, 2, 3, 4}
    assert abs(np.linalg.norm(v[1]) - 1.0) < 1e-6
    assert not v[2].any() and not v[3].any()
    assert np.array_equal(v[1], v[4])  # case-insensitive words


def test_row_encoder_equals_sql_encoder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = embed_text(docs, "text", "doc_id", method="sql")
    b = embed_text(docs, "text", "doc_id", method="rows").withColumnRenamed("embedding", "e2")
    j = a.join(b, "doc_id")
    assert j.count() == docs.count()
    assert j.where(F.col("embedding") != F.col("e2")).count() == 0


def test_block_kernel_vs_brute_force_randomised():
    """The vectorised block kernel on random grids full of exact ties and hot copies."""
    from venturelens.operators.vectors import _block_topk

    rng = np.random.default_rng(0)
    for _ in range(200):
        nq, nc, d, k = rng.integers(1, 30), rng.integers(1, 50), rng.integers(1, 7), int(rng.integers(1, 8))
        c = rng.integers(-2, 3, size=(nc, d)).astype(np.float64) / 2
        if rng.random() < 0.5:
            c[: nc // 3] = c[0]  # one vector holds a third of the rows
        ci = rng.permutation(nc * 3)[:nc].astype(np.int64)
        q = rng.integers(-2, 3, size=(nq, d)).astype(np.float64) / 2
        qi = np.arange(nq, dtype=np.int64) if rng.random() < 0.5 else rng.choice(ci, size=nq)
        ex = bool(rng.random() < 0.5)
        got = _block_topk(qi, q, ci, c, k, ex, chunk=int(rng.integers(1, 40)), pad=int(rng.integers(0, 5)))
        g = sorted(zip(got.idea_id.tolist(), got.id.tolist(), got.dist2.tolist()))
        want = []
        for r in range(nq):
            d2 = np.round(((c - q[r]) ** 2).sum(1), 6)
            idx = sorted((j for j in range(nc) if not (ex and ci[j] == qi[r])), key=lambda j: (d2[j], ci[j]))
            want += [(int(qi[r]), int(ci[j]), float(d2[j])) for j in idx[:k]]
        assert g == sorted(want)


def test_encoder_runs_once_in_the_embed_text_plan(spark):
    """posexplode of the vector must not infer a filter that re-runs the encoder."""
    from conftest import SMOKE
    from venturelens.plans.queries import q_embed_text

    plan = q_embed_text(spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_encoder_matches_python_definition_on_random_text(spark):
    """ASCII word runs only: non-ASCII letters (Kelvin sign, dotted I, accents) split words."""
    import hashlib
    import re

    rng = np.random.default_rng(7)
    alphabet = list("abcXYZ019 _-,.\n\t") + ["K", "İ", "é", "ß", "中", "\U0001f600"]
    texts = ["".join(rng.choice(alphabet, size=int(rng.integers(0, 60)))) for _ in range(300)]
    texts += [None, "", "   ", "KKK", "İstanbul ISTANBUL"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.array(r.embedding, dtype=np.float32) for r in embed_text(df, "text", "doc_id").collect()}

    def reference(text, dim=64):
        counts = np.zeros(dim)
        for w in re.findall("[A-Za-z0-9]+", text or ""):
            counts[int(hashlib.md5(w.lower().encode("ascii")).hexdigest()[:8], 16) % dim] += 1
        norm = np.sqrt((counts * counts).sum())
        return (counts / norm if norm > 0 else counts).astype(np.float32)

    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert np.array_equal(got[i], reference(t)), (i, t)


def test_broadcast_layout_does_not_shuffle_the_catalog(spark):
    """One kNN scan in place over the catalog; the only shuffle is on idea_id for the final top-k."""
    from conftest import SMOKE

    e = spark.read.parquet(f"{SMOKE}/embeddings.parquet")
    nb = top_k_similar(e.select(F.col("vec_id").alias("idea_id"), "embedding"),
                       e.select(F.col("vec_id").alias("id"), "embedding"), k=5, exclude_self=True)
    plan = nb._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(idea_id" in plan
