"""Toxicity by a bidirectional gated recurrent network with attention pooling.

*Inputs.*  A text is folded to lower case, punctuation becomes white space.  A
word enters as a word embedding (hashed) joined to the mean embedding of its
characters (hashed character trigrams and its first six bytes), so unseen forms
of a known stem are recognised by their spelling.

*Network.*  Windows of 32 words (``WINDOW``), each 16 (``STEP``) after the one
before: every passage of up to 17 words is whole in one of them, a longer one
may be seen only in parts.  A gated
recurrent unit reads a window in each direction; attention pools the states;
one output gives the margin.  A document's margin is the largest of all its
windows, and Platt scaling of it is the score.

*Training* is written in numpy.  Only documents are labelled, so each round
scores all windows, and the network learns from the largest window of every
training document (multiple-instance learning).  The first embedding dimension
starts from how telling words and spellings are in the training rows.  A fifth
of the training rows is kept back for the calibration, which weighs the rows by
the true frequency of the labels.  Training rows are bounded (``per_label``
whole documents of each label, by smallest key hash).

*Scoring* runs in place, without a shuffle.  Per slice, the gate inputs are
computed once for each distinct word, then looked up by the windows.

A null text counts as empty; an empty text is one empty window.  When a label
has no training rows, every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venturelens.llm.textkit import bounded_sample, compact, mix64, ranges, raw_bytes, slices, words
from venturelens.session import written

WINDOW, STEP, HIDDEN, DIM, BUCKETS, ATTEND = 32, 16, 8, 8, 1 << 17, 8
LANES = 4096

_FOLD = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not chr(_b).isalnum():
        _FOLD[_b] = 0x20
_FOLD[65:91] += 32


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as places in them, and where each text's begin."""
    folded = compact(pc.utf8_lower(compact(texts)), _FOLD)
    flat, to = words(folded, lower=False)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), to


def _spellings(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; buckets of its spellings, joined, and where each word's begin."""
    raw, size = raw_bytes(vocab)
    size = size.astype(np.int64)
    start = np.cumsum(size) - size
    pad = np.concatenate([raw.astype(np.uint64), np.zeros(8, np.uint64)])
    # trigrams over the word between two marks
    take = size
    at = ranges(start, take) if len(size) else np.zeros(0, np.int64)
    first = at == np.repeat(start, take)
    last = at == np.repeat(start + size - 1, take)
    before = np.where(first, 1, pad[at - 1])
    after = np.where(last, 2, pad[at + 1])
    gram = mix64((before << np.uint64(16)) | (pad[at] << np.uint64(8)) | after) % np.uint64(BUCKETS)
    whole = np.zeros(len(size), np.uint64)
    stem = np.zeros(len(size), np.uint64)
    if len(size):
        power = mix64(np.arange(int(size.max()), dtype=np.uint64) + np.uint64(99)) | np.uint64(1)
        within = at - np.repeat(start, take)
        weighed = (pad[at] + np.uint64(1)) * power[within]
        whole = mix64(np.add.reduceat(weighed, start)) % np.uint64(BUCKETS)
        stem = mix64(np.add.reduceat(np.where(within < 6, weighed, np.uint64(0)), start) + np.uint64(7)) % np.uint64(BUCKETS)
    flat = np.empty(len(gram) + len(size), np.int64)
    to = np.concatenate([[0], np.cumsum(size + 1)])
    flat[ranges(to[:-1], size)] = gram
    flat[to[1:] - 1] = stem
    return whole.astype(np.int64), flat, to


def _windows(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and document of every window."""
    n = np.diff(to)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STEP))
    doc = np.repeat(np.arange(len(n)), count)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    return to[:-1][doc] + first, np.minimum(n[doc] - first, WINDOW), doc


def _sum_by(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices and the sum of the rows of ``values`` at each."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    at = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[at], np.add.reduceat(values[order], at, axis=0)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class GruNet:
    p: dict[str, np.ndarray]
    platt: tuple[float, float] = (1.0, 0.0)
    state: dict = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 1) -> "GruNet":
        rng = np.random.default_rng(seed)
        p = {"word": np.zeros((BUCKETS, DIM)), "char": np.zeros((BUCKETS, DIM))}
        for d in "fb":
            for g in "zrn":
                p[f"{d}W{g}"] = rng.normal(0, 0.4, (2 * DIM, HIDDEN))
                p[f"{d}U{g}"] = rng.normal(0, 0.3, (HIDDEN, HIDDEN))
                p[f"{d}b{g}"] = np.zeros(HIDDEN)
        p |= {"A": rng.normal(0, 0.3, (2 * HIDDEN, ATTEND)), "a": np.zeros(ATTEND), "v": rng.normal(0, 0.5, ATTEND),
              "o": rng.normal(0, 0.5, 2 * HIDDEN), "c": np.zeros(1)}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, vocab: pa.Array) -> np.ndarray:
        """The embedding of each distinct word."""
        word, spell, to = _spellings(vocab)
        out = np.zeros((len(word), 2 * DIM), np.float32)
        if len(word):
            out[:, :DIM] = self.p["word"][word]
            out[:, DIM:] = np.add.reduceat(self.p["char"][spell], to[:-1], axis=0) / np.diff(to)[:, None]
        return out

    def margins(self, x: np.ndarray, idx: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Margin of every window; ``x`` from inputs(), ``idx`` the words of all texts."""
        p = self.p
        gates = {d + g: np.concatenate([x @ p[f"{d}W{g}"] + p[f"{d}b{g}"], np.zeros((1, HIDDEN), np.float32)]) for d in "fb" for g in "zrn"}
        none, out = len(x), np.zeros(len(first), np.float32)
        idx = np.append(idx, none)
        order = np.argsort(size, kind="stable")                # like lengths together: short windows end early
        for lo in range(0, len(order), LANES):
            rows = order[lo:lo + LANES]
            n, width = size[rows], int(size[rows].max(initial=0))
            if width == 0:
                out[rows] = p["c"][0]
                continue
            t = np.arange(width)[:, None]
            live = t < n
            ids = np.where(live, idx[np.minimum(first[rows] + t, len(idx) - 1)], none)
            h = np.empty((width, len(rows), 2 * HIDDEN), np.float32)
            for d, steps, side in (("f", range(width), 0), ("b", range(width - 1, -1, -1), HIDDEN)):
                s = np.zeros((len(rows), HIDDEN), np.float32)
                uz, ur, un = p[d + "Uz"], p[d + "Ur"], p[d + "Un"]
                ragged = d == "b" and not live.all()
                for k in steps:
                    i = ids[k]
                    z = _sigmoid(gates[d + "z"].take(i, 0) + s @ uz)
                    r = _sigmoid(gates[d + "r"].take(i, 0) + s @ ur)
                    r *= s @ un
                    r += gates[d + "n"].take(i, 0)
                    new = np.tanh(r, out=r)
                    s -= new
                    s *= z
                    s += new
                    if ragged:
                        s *= live[k][:, None]
                    h[k, :, side:side + HIDDEN] = s
            e = np.tanh(h @ p["A"] + p["a"]) @ p["v"]
            e = np.where(live, e, -np.inf)
            w = np.exp(e - np.maximum(e.max(0), -1e9))
            total = np.maximum(w.sum(0), 1e-9)
            out[rows] = (w * (h @ p["o"])).sum(0) / total + p["c"][0]
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        vocab, idx, to = _words(texts)
        first, size, doc = _windows(to)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, doc, self.margins(self.inputs(vocab), idx, first, size))
        return 1 / (1 + np.exp(-np.clip(self.platt[0] * best + self.platt[1], -30, 30)))

    def learn(self, x_word, x_spell, x_to, ids, live, y, weight, rate: float) -> None:
        """One Adam step on windows ``ids`` (rows, steps) of words given by bucket and spellings."""
        p, n, width = self.p, *ids.shape
        used, place = np.unique(ids, return_inverse=True)
        place = place.reshape(ids.shape)
        counts = np.diff(x_to)[used]
        spell = x_spell[ranges(x_to[used], counts)]
        owner = np.repeat(np.arange(len(used)), counts)
        table = np.zeros((len(used), 2 * DIM), np.float32)
        table[:, :DIM] = p["word"][x_word[used]]
        table[:, DIM:] = np.add.reduceat(p["char"][spell], np.cumsum(counts) - counts, axis=0) / counts[:, None]
        x = table[place] * live[:, :, None]
        h = np.zeros((width, n, 2 * HIDDEN), np.float32)
        tape = {}
        for d, steps, side in (("f", range(width), 0), ("b", range(width - 1, -1, -1), HIDDEN)):
            s = np.zeros((n, HIDDEN), np.float32)
            for k in steps:
                xk = x[:, k]
                z = _sigmoid(xk @ p[d + "Wz"] + p[d + "bz"] + s @ p[d + "Uz"])
                r = _sigmoid(xk @ p[d + "Wr"] + p[d + "br"] + s @ p[d + "Ur"])
                c = s @ p[d + "Un"]
                new = np.tanh(xk @ p[d + "Wn"] + p[d + "bn"] + r * c)
                tape[d, k] = (s, z, r, c, new)
                s = (new + z * (s - new)) * live[:, k, None]
                h[k, :, side:side + HIDDEN] = s
        u = np.tanh(h @ p["A"] + p["a"])
        e = np.where(live.T, u @ p["v"], -np.inf)
        w = np.exp(e - np.maximum(e.max(0), -1e9))
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = (w[:, :, None] * h).sum(0)
        margin = pooled @ p["o"] + p["c"][0]
        dm = (weight * (_sigmoid(margin) - y) / n).astype(np.float32)
        g = {k: 1e-5 * v for k, v in p.items() if k not in ("word", "char")}
        g["o"] = g["o"] + pooled.T @ dm
        g["c"] = np.array([dm.sum()], np.float32)
        dpool = dm[:, None] * p["o"]
        dw = (dpool[None] * h).sum(2)
        de = w * (dw - (w * dw).sum(0))
        du = de[:, :, None] * p["v"] * (1 - u * u)
        g["v"] = g["v"] + np.einsum("tn,tna->a", de, u)
        g["A"] = g["A"] + np.einsum("tnh,tna->ha", h, du)
        g["a"] = g["a"] + du.sum((0, 1))
        dh = w[:, :, None] * dpool[None] + du @ p["A"].T
        dx = np.zeros_like(x)
        for d, steps, side in (("f", range(width - 1, -1, -1), 0), ("b", range(width), HIDDEN)):
            back = np.zeros((n, HIDDEN), np.float32)
            for k in steps:
                s, z, r, c, new = tape[d, k]
                ds = (dh[k, :, side:side + HIDDEN] + back) * live[:, k, None]
                an = ds * (1 - z) * (1 - new * new)
                az = ds * (s - new) * z * (1 - z)
                ar = an * c * r * (1 - r)
                ac = an * r
                back = ds * z + az @ p[d + "Uz"].T + ar @ p[d + "Ur"].T + ac @ p[d + "Un"].T
                xk = x[:, k]
                for q, a, inner in (("z", az, az), ("r", ar, ar), ("n", an, ac)):
                    g[f"{d}W{q}"] = g[f"{d}W{q}"] + xk.T @ a
                    g[f"{d}b{q}"] = g[f"{d}b{q}"] + a.sum(0)
                    g[f"{d}U{q}"] = g[f"{d}U{q}"] + s.T @ inner
                    dx[:, k] += a @ p[f"{d}W{q}"].T
        _, per = _sum_by(place.ravel(), (dx * live[:, :, None]).reshape(-1, 2 * DIM))
        for name, rows, grad in (("word", x_word[used], per[:, :DIM]), ("char", spell, (per[:, DIM:] / counts[:, None])[owner])):
            # buckets without support in the training rows stay at zero; the others move along the gradient
            rows, grad = _sum_by(rows, grad)
            p[name][rows] -= rate * 20 * np.where(self.state[name][rows, None], grad, 0)
        self._adam(g, rate)

    def _adam(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.state["t"] = t = self.state.get("t", 0) + 1
        for k, gk in g.items():
            m, v = self.state.get(k, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * gk, 0.999 * v + 0.001 * gk * gk
            self.state[k] = (m, v)
            self.p[k] = (self.p[k] - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)


def _telling(idx: np.ndarray, to: np.ndarray, docs: np.ndarray, y: np.ndarray, of, support: int) -> tuple[np.ndarray, np.ndarray]:
    """How much more often than by chance the documents that hold a bucket have label 1 (0: no evidence).

    ``of`` gives the buckets of vocabulary places and how many each has.  The
    second result tells which buckets at least ``support`` of the documents hold.
    """
    n1, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for some in np.array_split(docs, max(1, len(docs) // 64)):           # few documents at a time: bounded memory
        each = [np.unique(idx[to[d]:to[d + 1]]) for d in some]
        buckets, counts = of(np.concatenate(each))
        holder = np.repeat(np.repeat(np.arange(len(some)), [len(e) for e in each]), counts)
        pair = np.unique(holder * np.int64(BUCKETS) + buckets)
        n1 += np.bincount(pair % BUCKETS, y[some][pair // BUCKETS] == 1, BUCKETS)
        n += np.bincount(pair % BUCKETS, minlength=BUCKETS)
    rate = max((y[docs] == 1).mean(), 1e-6)
    return np.clip(np.log((n1 + 12 * rate) / (n * rate + 12 * rate)) - 0.7, 0, 2), n >= support


def train(texts: pa.Array, y: np.ndarray, frequency: tuple[float, float] = (0.5, 0.5), rounds: int = 6, seed: int = 1) -> GruNet:
    """``frequency``: the labels' shares among all rows, for the calibration."""
    rng = np.random.default_rng(seed)
    net = GruNet.new(seed)
    vocab, idx, to = _words(texts)
    word, spell, spell_to = _spellings(vocab)
    first, size, doc = _windows(to)
    fitted = rng.random(len(y)) >= 0.2
    for name, of, support in (
            ("word", lambda w: (word[w], np.ones(len(w), np.int64)), 3),
            ("char", lambda w: (spell[ranges(spell_to[w], np.diff(spell_to)[w])], np.diff(spell_to)[w]), 5)):
        told, known = _telling(idx, to, np.flatnonzero(fitted), y, of, support)
        net.p[name][known] = rng.normal(0, 0.05, (int(known.sum()), DIM))
        net.p[name][:, 0] = np.where(known, told, 0)
        net.state[name] = known
    weigh = np.where(y == 1, 0.5 / max(1, (y[fitted] == 1).sum()), 0.5 / max(1, (y[fitted] == 0).sum())) * max(1, fitted.sum())
    idx_end = np.append(idx, 0)

    def tops(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.lexsort((m, doc))
        best = by[np.flatnonzero(np.append(np.diff(doc[by]) > 0, True))]
        return best, m[best]

    # the first choice of windows: the most telling words and spellings
    x = net.inputs(vocab)
    word_sum = np.concatenate([[0], np.cumsum((x[:, 0] + x[:, DIM])[idx])])
    best, _ = tops(word_sum[first + size] - word_sum[first])
    for turn in range(rounds):
        clean = np.flatnonzero((y[doc] == 0) & fitted[doc])
        full = np.unique(np.concatenate([best, rng.choice(clean, min(len(clean), len(best)), replace=False)]))
        full = full[(size[full] > 0) & fitted[doc[full]]]
        batches = max(1, len(full) // 192)
        for _ in range(max(2, 40 // batches)):                     # forty steps at least
            rng.shuffle(full)
            for b in np.array_split(full, batches):
                t = np.arange(int(size[b].max()))
                live = (t < size[b][:, None])
                ids = np.where(live, idx_end[np.minimum(first[b][:, None] + t, len(idx_end) - 1)], 0)
                live &= rng.random(live.shape) >= 0.1
                net.learn(word, spell, spell_to, ids, live, y[doc[b]], weigh[doc[b]], 6e-3 if turn < 4 else 2e-3)
        best, margin = tops(net.margins(net.inputs(vocab), idx, first, size))
    back = ~fitted
    s, yb = margin[back], y[back]
    share = [max(1, (yb == k).sum()) for k in (0, 1)]
    w = np.where(yb == 1, frequency[1] / share[1], frequency[0] / share[0])
    w = w / w.sum()
    a, c = 1.0, 0.0
    for _ in range(3000):
        q = 1 / (1 + np.exp(-np.clip(a * s + c, -30, 30)))
        a -= 0.3 * (np.sum(w * (q - yb) * s) + 1e-4 * (a - 1))
        c -= 0.3 * np.sum(w * (q - yb))
    net.platt, net.state = (float(max(a, 0.05)), float(c)), {}
    return net


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 2000) -> GruNet | None:
    """Learns from (doc_id, label) rows and the texts of ``docs``; at most ``per_label`` documents of each label."""
    # one label and one text of an id that stands in several rows: the greatest label, the least text
    labels = (labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label")))
    counts = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    if set(counts) != {0, 1}:
        return None
    # written: Spark then knows how few they are, and joins them to the texts without a shuffle
    ids = written(bounded_sample(labels, "label", per_label).select("doc_id", "label"), "sample")
    got = (docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
           .orderBy("doc_id").select("text", "label").toArrow().combine_chunks())
    y = got.column("label").to_numpy().astype(float)
    if not {0.0, 1.0} <= set(y):
        return None
    total = sum(counts.values())
    return train(pa.chunked_array(got.column("text")).combine_chunks(), y, (counts[0] / total, counts[1] / total))


def score(docs: DataFrame, net: GruNet | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                s = model.scores(part.column("text")) if model else np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s.astype(float), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
