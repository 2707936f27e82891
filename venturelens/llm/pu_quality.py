"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; all other evidence is
unlabelled web text, of which an unknown share is good.  A small network is
trained in numpy on the non-negative unbiased risk

    prior * E_pos[loss(+)]  +  max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

and steps back up that second term's slope whenever a mini-batch makes it negative.
The class prior is estimated from the same two samples: a classifier of
positives against unlabelled text is fitted first, and the prior is the least
ratio, over its score thresholds, of the unlabelled to the positive share above
the threshold.  Rows labelled 0 are never read as negatives.

Inputs of a score are the text alone: frequencies of pairs of adjacent byte
classes, and word statistics.  Both samples are bounded (``per_class`` rows of
smallest key hash) and reach the driver as features only; every document is
scored whole, in place, without a shuffle.

A null text counts as empty; an empty text has all-zero statistics and gets the
score that the network gives them.  Without any positive row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venturelens.llm.textkit import bounded_sample, raw_bytes, slices, words

CLASSES = 13


def _byte_classes() -> np.ndarray:
    c = np.full(256, 9, np.uint8)                       # other symbols
    for k, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\v\f\r",
                               ".", ",;:", "!?", "'\"()-"]):
        c[list(chars.encode())] = k
    c[0x80:0xC0] = 10
    c[0xC0:] = 11
    c[0] = 12
    return c


_CLASS = _byte_classes()
N_FEATURES = CLASSES * CLASSES + 7


def features(texts: pa.Array) -> np.ndarray:
    """float32 matrix, a row per text."""
    raw, sizes = raw_bytes(texts)
    c = _CLASS[raw].astype(np.int32)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    pair = doc[1:] * (CLASSES * CLASSES) + c[:-1] * CLASSES + c[1:]
    pair = pair[doc[1:] == doc[:-1]]
    hist = np.bincount(pair, minlength=len(sizes) * CLASSES * CLASSES).reshape(len(sizes), -1)
    flat, to = words(texts)
    idx = flat.dictionary_encode().indices.to_numpy() if len(flat) else np.zeros(0, np.int32)
    count = np.diff(to)
    owner = np.repeat(np.arange(len(sizes)), count)
    again = np.zeros((2, len(sizes)))
    for lag in (1, 2):
        if len(idx) > lag:
            same = (idx[lag:] == idx[:-lag]) & (owner[lag:] == owner[:-lag])
            again[lag - 1] = np.bincount(owner[lag:][same], minlength=len(sizes))
    distinct = np.bincount(np.unique(owner * np.int64(len(idx) + 1) + idx) // (len(idx) + 1), minlength=len(sizes))
    length = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(float) if len(flat) else np.zeros(0)
    n = np.maximum(count, 1)
    out = np.zeros((len(sizes), N_FEATURES), np.float32)
    out[:, :CLASSES * CLASSES] = np.log1p(1000.0 * hist / np.maximum(sizes, 1)[:, None])
    out[:, -7:] = np.stack([
        np.log1p(count), np.log1p(sizes), again[0] / n, again[1] / n, distinct / n,
        np.bincount(owner, length, len(sizes)) / n,
        np.sqrt(np.bincount(owner, length ** 2, len(sizes)) / n)], 1)
    return out


@dataclass
class Net:
    """One hidden layer over standardised features; ``margin`` is the log-odds of quality 1."""

    mean: np.ndarray
    scale: np.ndarray
    w: list[np.ndarray]

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w[0] + self.w[1])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(np.float64), -30, 30)))


def _net(x: np.ndarray, width: int, rng) -> Net:
    return Net(x.mean(0), x.std(0) + 0.05, [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], width)).astype(np.float32), np.zeros(width, np.float32),
        rng.normal(0, 1 / np.sqrt(width), width).astype(np.float32), np.zeros(1, np.float32)])


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, width: int = 24, epochs: int = 20, seed: int = 7) -> Net:
    """Adam on the non-negative risk; with ``prior`` None on plain positives against unlabelled rows."""
    rng = np.random.default_rng(seed)
    net = _net(np.concatenate([pos, unl]), width, rng)
    m, v, t = [np.zeros_like(a) for a in net.w], [np.zeros_like(a) for a in net.w], 0
    batches = max(1, len(unl) // 512)
    for _ in range(max(epochs, 12 * epochs // batches)):            # small samples: as many steps
        for p, u in zip(np.array_split(rng.permutation(len(pos)), batches), np.array_split(rng.permutation(len(unl)), batches)):
            if not len(p) or not len(u):
                continue
            x = np.concatenate([pos[p], unl[u]])
            z = np.clip((x - net.mean) / net.scale, -6, 6)
            h = np.tanh(z @ net.w[0] + net.w[1])
            g = h @ net.w[2] + net.w[3][0]
            gp, gu = g[:len(p)], g[len(p):]
            up = 1 / (1 + np.exp(-g))                     # slope of the loss on label 0; label 1: up - 1
            if prior is None:
                d = np.concatenate([(up[:len(p)] - 1) / len(p), up[len(p):] / len(u)])
            else:
                negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
                slope = np.concatenate([-prior * up[:len(p)] / len(p), up[len(p):] / len(u)])
                d = np.concatenate([prior * (up[:len(p)] - 1) / len(p), np.zeros(len(u))]) + slope if negative >= 0 else -slope
            back = (d[:, None] * net.w[2]) * (1 - h * h)
            grad = [z.T @ back + 1e-4 * net.w[0], back.sum(0), h.T @ d + 1e-4 * net.w[2], np.array([d.sum()])]
            t += 1
            for k, gk in enumerate(grad):
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                net.w[k] = (net.w[k] - 2e-3 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    return net


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled rows, from scores of rows that the scorer did not learn from."""
    got = []
    for fold in (0, 1):
        net = _train(pos[fold::2], unl[fold::2], None, width=12, epochs=12, seed=11)
        p, u = np.sort(net.margin(pos[1 - fold::2])), net.margin(unl[1 - fold::2])
        if len(p) and len(u):
            cut = p[[int(q * len(p)) for q in (0.02, 0.05, 0.1, 0.2, 0.3, 0.5)]]
            got.append(min(np.mean(u >= c) / np.mean(p >= c) for c in cut))
    return float(np.clip(np.mean(got), 0.05, 0.98)) if got else 0.5


@dataclass
class QualityModel:
    net: Net | None
    prior: float


def fit(docs: DataFrame, positives: DataFrame, per_class: int = 6000, prior: float | None = None) -> QualityModel:
    """Learns from the texts of ``docs``: ``positives`` has the doc_ids of trusted rows."""
    def rows(df: DataFrame) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    yield pa.RecordBatch.from_arrays([pa.array(list(features(part.column("text"))), pa.list_(pa.float32()))], names=["x"])
        got = df.select("text").mapInArrow(run, "x array<float>").toArrow().column("x").combine_chunks()
        return np.asarray(got.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, N_FEATURES)

    ids = bounded_sample(positives.select("doc_id").where("doc_id IS NOT NULL").distinct(), None, per_class)
    # one text of an id that stands in several rows
    pos = rows(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    web = bounded_sample(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), None, per_class)
    unl = rows(docs.select("doc_id", "text").join(web, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    if not len(pos) or not len(unl):
        return QualityModel(None, 0.5)
    prior = estimate_prior(pos, unl) if prior is None else prior
    return QualityModel(_train(pos, unl, prior), prior)


def score(docs: DataFrame, model: QualityModel, name: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1) at the end; rows stay where they are."""
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"))
                s = model.net.score(x) if model.net else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=names)

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).cast("double").alias(name)).schema)


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score below ``least``; all columns stay."""
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, name).where(F.col(name) >= least).drop(name)
