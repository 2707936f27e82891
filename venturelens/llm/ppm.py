"""Language identification by prediction by partial matching.

Per language, a byte context tree of bounded order counts which byte followed
which context in the training rows.  The statistics are then frozen, and the
code length of every byte in every context is tabled: a byte not seen in a
context costs an escape (method C, with exclusion of the bytes that the longer
contexts had seen) and is coded in the next shorter one, at last uniformly.
The exact code length of a text is the sum over its bytes; the language with
the shortest code is predicted, and the score is its posterior probability
under equal priors.

Training rows are bounded: ``per_lang`` whole texts of each language (smallest
key hashes).  The trees are merged into one with counts per language, built on
the driver and broadcast; its size is bounded by the training rows and by
``NODES_PER_LANG`` contexts for each language (never fewer than ``NODES``), the
most frequent of an order first; a warning tells how many did not find room.
Every text is scored whole, in place, without a shuffle.

Letter case is folded.  A null text or one without a letter is ``und`` with
score 0, and so is every text when there is nothing to learn from.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venturelens.llm.textkit import bounded_sample, compact, raw_bytes, slices
from venturelens.session import written

ORDER = 3
NODES, NODES_PER_LANG = 30_000, 7_500
_LOG = logging.getLogger(__name__)
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ContextTrees:
    """The merged tree: children, and the code length (nats) of each symbol per language."""

    langs: list[str]
    symbol: np.ndarray     # byte -> symbol; the last symbol stands for all unseen bytes
    child: np.ndarray      # node, symbol -> the context longer by this symbol, or the dead node
    cost: np.ndarray       # node, symbol, language


def _sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.lower().encode() for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.frombuffer(b"".join(raw), np.uint8), within


def fit_trees(by_lang: dict[str, list[str]], order: int = ORDER, max_nodes: int | None = None) -> ContextTrees | None:
    langs = sorted(lang for lang, texts in by_lang.items() if any(texts))
    if not langs:
        return None
    max_nodes = max(NODES, NODES_PER_LANG * len(langs)) if max_nodes is None else max_nodes
    data = {lang: _sequences(by_lang[lang]) for lang in langs}
    alphabet = np.unique(np.concatenate([np.unique(raw) for raw, _ in data.values()]))
    symbol = np.full(256, len(alphabet), np.uint8 if len(alphabet) < 256 else np.int16)
    symbol[alphabet] = np.arange(len(alphabet))
    width = len(alphabet) + 1
    # contexts of each order as numbers, most recent byte first, with their counts
    levels = [(np.zeros(1, np.int64), None)]
    streams = {}
    for lang, (raw, within) in data.items():
        s = symbol[raw].astype(np.int64)
        ctx = [np.zeros(len(s), np.int64)]
        for k in range(1, order + 1):
            c = np.zeros(len(s), np.int64)
            for back in range(1, k + 1):
                c[back:] = c[back:] * width + s[:-back]
            ctx.append(np.where(within >= k, c, -1))
        streams[lang] = (s, ctx)
    for k in range(1, order + 1):
        seen, n = np.unique(np.concatenate([ctx[k][ctx[k] >= 0] for _, ctx in streams.values()]), return_counts=True)
        keep = n >= 2
        room = max_nodes - sum(len(lv[0]) for lv in levels)
        if keep.sum() > room:                              # the most frequent contexts of this order
            asked = int(keep.sum())
            keep &= n > np.partition(n, len(n) - room)[len(n) - room] if room > 0 else False
            _LOG.warning("%d of %d contexts of order %d left out: %d contexts for %d languages", asked - keep.sum(), asked, k, max_nodes, len(langs))
        levels.append((seen[keep], None))
    base = np.cumsum([0, *(len(lv[0]) for lv in levels)])
    nodes, dead = int(base[-1]), int(base[-1])
    child = np.full((nodes + 1, width), dead, np.int32)
    counts = np.zeros((nodes, width, len(langs)), np.float32)
    parent = np.zeros(nodes, np.int64)
    for k in range(1, order + 1):
        here, shorter = levels[k][0], levels[k - 1][0]
        up = np.searchsorted(shorter, here // width)
        ok = (up < len(shorter)) & (shorter[np.minimum(up, len(shorter) - 1)] == here // width) if len(shorter) else np.zeros(len(here), bool)
        ids = base[k] + np.arange(len(here))
        parent[ids[ok]] = base[k - 1] + up[ok]
        child[parent[ids[ok]], (here % width)[ok]] = ids[ok]
    for li, lang in enumerate(langs):
        s, ctx = streams[lang]
        for k in range(order + 1):
            here = levels[k][0]
            if not len(here):
                continue
            at = np.minimum(np.searchsorted(here, ctx[k]), len(here) - 1)
            hit = (here[at] == ctx[k]) & (ctx[k] >= 0)
            np.add.at(counts, (base[k] + at[hit], s[hit], li), 1)
    cost = np.zeros((nodes + 1, width, len(langs)), np.float32)
    for k in range(order + 1):
        ids = np.arange(base[k], base[k + 1])
        for li in range(len(langs)):
            total = np.zeros((len(ids), width))
            done = np.zeros((len(ids), width), bool)
            barred = np.zeros((len(ids), width), bool)
            at = ids.copy()
            for _ in range(k + 1):
                c = np.where(barred, 0, counts[at, :, li])
                n, q = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                coded = (c > 0) & ~done
                some = n > 0
                total = np.where(coded, total - np.log(np.maximum(c, 1) / np.maximum(n + q, 1)), total)
                total = np.where(~done & ~coded & some, total - np.log(np.maximum(q, 1) / np.maximum(n + q, 1)), total)
                done |= coded
                barred |= c > 0
                at = parent[at]
            left = np.maximum(256 - barred.sum(1, keepdims=True), 1)
            cost[ids, :, li] = np.where(done, total, total + np.log(left))
    return ContextTrees(langs, symbol, child, cost)


def code_lengths(texts: pa.Array, trees: ContextTrees) -> np.ndarray:
    """Exact code length in nats of every text (null: empty) under every language."""
    raw, size = raw_bytes(pc.utf8_lower(compact(texts)))
    out = np.zeros((len(size), len(trees.langs)))
    total = len(raw)
    if not total:
        return out
    s = trees.symbol[raw].astype(np.int32)
    width, dead = trees.child.shape[1], len(trees.child) - 1
    start = (np.cumsum(size) - size)[size > 0]
    child = trees.child.ravel()
    node, walk = np.zeros(total, np.int32), np.zeros(total, np.int32)
    for k in range(1, ORDER + 1):
        walk[k:] = child[walk[k:] * width + s[:-k]]
        walk[:k] = dead
        for j in range(k):                                # contexts do not reach into the text before
            at = start + j
            walk[at[at < total]] = np.where(np.minimum(size[size > 0], k)[at < total] > j, dead, walk[at[at < total]])
        node = np.where(walk != dead, walk, node)
    per_byte = trees.cost.reshape(-1, len(trees.langs))[node * width + s]
    out[size > 0] = np.add.reduceat(per_byte, start, axis=0, dtype=np.float64)
    return out


def fit(rows: DataFrame, per_lang: int = 300) -> ContextTrees | None:
    """Learns from (doc_id, text, lang) rows with a language; at most ``per_lang`` whole texts of each."""
    # written: Spark then knows how few they are, and joins them to the texts without a shuffle
    ids = written(bounded_sample(rows.where("doc_id IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang").distinct(), "lang", per_lang)
                  .select("doc_id", "lang"), "sample")
    # one text of an id that stands in several rows
    got = (rows.select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"], "left_semi")
           .groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toArrow().to_pydict())
    by_lang: dict[str, list[str]] = {}
    for _, lang, text in sorted(zip(got["doc_id"], got["lang"], got["text"]), key=lambda r: (r[0], r[1], r[2] or "")):
        by_lang.setdefault(lang, []).append(text or "")
    return fit_trees(by_lang)


def predict(docs: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = part.column("text")
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                if model:
                    bits = code_lengths(texts, model)
                    best = bits.argmin(1)
                    odds = np.exp(np.maximum(bits.min(1, keepdims=True) - bits, -700))
                    for i, t in enumerate(texts):
                        if t.is_valid and _LETTER.search(t.as_py()):
                            lang[i], score[i] = model.langs[best[i]], 1 / odds[i].sum()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")
