"""Operator 13 against brute force, by its own parts and on awkward tables."""
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from common import AZ, edge_docs
from venturelens.llm import impact_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall((text or "").translate(AZ))


def brute(items, docs, k=10):
    docs = [(i, split(t)) for i, t in docs if split(t)]
    n_docs, total = len(docs), sum(len(t) for _, t in docs)
    df = Counter(t for _, ts in docs for t in set(ts))
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, ts in docs:
            tf, m = Counter(ts), 100 - 75 + (75 * len(ts) * n_docs) // total
            s = sum(w[t] * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in split(text) if tf[t])
            if s > 0:
                found.append((-s, math.inf if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:k])]
    return out


def rows(df):
    return [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]


def test_terms_are_the_matches_of_the_pattern():
    texts = ["A1-b_c é\x00Ü\tİ", "", None, "x" * 100_000 + "\x7f\x80~y", "日本 語!"]
    flat, to = impact_search.terms(pa.array(texts))
    assert flat.to_pylist() == sum(map(split, texts), []) and np.diff(to).tolist() == [len(split(t)) for t in texts]


@pytest.mark.parametrize("postings,docs_per_shard,block", [(2_000_000, 100_000, 8 << 20), (40, 7, 60), (1, 1, 1)])
def test_search_against_brute_force(spark, postings, docs_per_shard, block):
    docs = edge_docs(spark, [(20 + i, f"alpha {'beta ' * (i % 4)} word{i % 5} tie", "en", "a") for i in range(40)])
    items = [(1, "alpha beta BETA word3"), (2, None), (3, ""), (4, "zzz never"), (5, "tie tie-tie straße"), (None, "one word1")]
    got = impact_search.search(spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, score string"), docs,
                               bounds=impact_search.Bounds(postings, docs_per_shard, block))
    want = brute(items, [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(rows(got), key=str) == sorted(want, key=str) and dict(got.dtypes) == {
        "item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_repeated_items_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "b")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "b"), (7, "a"), (7, "a")], "item_id long, text string")
    assert [r[:3] for r in rows(impact_search.search(items, docs))] == [(7, 1, 1), (7, 2, 1)]
    assert rows(impact_search.search(items.limit(0), docs)) == [] == rows(impact_search.search(items, docs.limit(0)))
    assert rows(impact_search.search(items, docs.selectExpr("doc_id", "cast(null as string) text"))) == []


def random_shard(seed, n=600, n_terms=12):
    rng = np.random.default_rng(seed)
    per = [np.flatnonzero(rng.random(n_terms) < rng.random()) for _ in range(n)]
    to = np.concatenate([[0], np.cumsum([len(p) for p in per])]).astype(np.int64)
    term = np.concatenate(per).astype(np.int64)
    tf = rng.geometric(0.3, len(term))
    length = np.array([tf[a:b].sum() + rng.integers(1, 40) for a, b in zip(to, to[1:])])
    return impact_search.Shard(rng.permutation(n), length, to, term, tf, n_terms, n, int(length.sum())), to, term


def test_shard_search_stops_early_and_is_exact():
    saved = 0
    for seed in range(40):
        shard, to, term = random_shard(seed)
        rng = np.random.default_rng(seed)
        for k in (1, 3, 10):
            ids = np.sort(rng.choice(12, rng.integers(1, 5), replace=False))
            w = rng.integers(0, 50, len(ids)) ** 2
            weight = np.zeros(12, np.int64)
            weight[ids] = w
            score = np.array([(weight[term[a:b]] * shard.impact[a:b]).sum() for a, b in zip(to, to[1:])])
            want = [i for i in np.lexsort((shard.tie, -score))[:k] if score[i] > 0]
            docs, scores = shard.search(ids, w, k)
            assert docs.tolist() == want and scores.tolist() == score[want].tolist()
            saved += shard.accesses < sum(shard.start[i + 1] - shard.start[i] for i in ids[w > 0])
            assert not shard.seen.any() and not shard.known.any() and not shard.weights.any()
    assert saved > 60


def test_ties_at_the_last_rank_are_all_seen():
    n = 300
    to = np.arange(n + 1, dtype=np.int64)
    shard = impact_search.Shard(np.arange(n)[::-1].copy(), np.full(n, 5), to, np.zeros(n, np.int64), np.ones(n, np.int64), 1, n, 5 * n)
    docs, _ = shard.search(np.array([0]), np.array([3]), 10)
    assert docs.tolist() == list(range(n - 1, n - 11, -1)) and shard.accesses == n
