"""Ranked lexical search with the Best Position Algorithm over impact lists.

A term's impact in a document is the integer (1000000000*tf) div (1000*tf + 8*m),
m = 25 + (75*n*N) div L; a document's score for an item sums weight times
impact over the item's terms, repeats included.

1. One pass over all documents keeps, per document, its number of terms and the
   (term, tf) pairs of the items' vocabulary.  N, L and the df of those terms
   are aggregates of that narrow table.
2. Its rows are split into shards of at most ``Bounds.postings`` pairs (whole
   documents), so a frequent term is split with the documents that hold it.  A
   shard sorts each term's list by falling impact and runs every item on it:
   sorted accesses go down all lists of the item in blocks of growing depth; each
   document seen is scored by direct accesses to its entries in the item's other
   lists, which marks their positions as seen too.  The best position of a list
   is the end of its unbroken run of seen positions, often far beyond the last
   one read.  The weighted impacts at the best positions bound every unseen
   document (a list seen to its end adds nothing).  The shard stops
   when that bound is strictly below its k-th score, so ties at rank k are
   all seen.
3. Per shard and item k rows remain; a window per item merges them (Spark
   limits each partition to k rows per item before the shuffle).

Items are taken in blocks of at most ``Bounds.item_bytes`` of text on average, each
block a search of its own: the vocabulary of one block is what the driver holds
and broadcasts.

Terms are maximal runs of ASCII letters and digits and of characters from U+0080 on, only
A-Z lower-cased.  A null or empty text has no terms; such items have no rows and such
documents do not count in N.  Repeated document rows are documents of their own
with equal scores.  Rows of one item_id are one item, with the least of their
texts.  Equal scores are ordered by doc_id, null last.  Empty tables give an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from venturelens.llm.textkit import ranges, slices, words
from venturelens.session import written

@dataclass(frozen=True)
class Bounds:
    """(term, tf) pairs and documents of one shard; text of one block of items on average."""

    postings: int = 2_000_000
    docs: int = 100_000
    item_bytes: int = 8 << 20


#: Depth of the first block of sorted accesses; it doubles.
FIRST_DEPTH = 16


def _term_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    t[48:58] = np.arange(48, 58)
    t[65:91] = np.arange(97, 123)
    t[97:123] = np.arange(97, 123)
    return t


_TABLE = _term_table()


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, one after the other, and where each text's begin."""
    return words(texts, table=_TABLE)


def counted(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms per text; then text, term index and occurrences of each (text, term) in the vocabulary."""
    flat, to = terms(texts)
    n = np.diff(to)
    found = pc.index_in(flat, value_set=vocabulary)
    here = found.is_valid().to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(n)), n)[here]
    pair, tf = np.unique(text * max(1, len(vocabulary)) + found.drop_null().to_numpy().astype(np.int64), return_counts=True)
    return n, pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary)), tf


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n, terms, tfs of every document with a term; the pairs are those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pa.array(shared.value, pa.large_string())
        for batch in (part for whole in batches for part in slices(whole, "text")):
            n, text, term, tf = counted(batch.column("text"), vocab)
            to = pa.array(np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32))
            rows = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(to, pa.array(term.astype(np.int32))),
                 pa.ListArray.from_arrays(to, pa.array(tf.astype(np.int32)))], names=["doc_id", "n", "terms", "tfs"])
            yield rows.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n bigint, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def top(score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest scores, smallest tie first among equals."""
    keep = np.arange(len(score))
    if len(score) > 4 * k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return keep[np.lexsort((tie[keep], -score[keep]))[:k]]


class Shard:
    """Impact lists of some documents, with direct access from a document to its entries."""

    def __init__(self, tie: np.ndarray, n: np.ndarray, to: np.ndarray, term: np.ndarray, tf: np.ndarray,
                 n_terms: int, n_docs: int, length: int):
        self.tie, self.to, self.term = tie, to, term
        m = 25 + (75 * n.astype(np.int64) * n_docs) // length
        doc = np.repeat(np.arange(len(n)), np.diff(to))
        tf = tf.astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((-self.impact, term))
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        #: lists, one after the other: document and impact of each position; and the position of each entry
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.position = np.empty(len(order), np.int64)
        self.position[order] = np.arange(len(order))
        self.seen = np.zeros(len(order), bool)
        self.known = np.zeros(len(n), bool)
        self.weights = np.zeros(n_terms, np.int64)
        #: sorted accesses of the last search
        self.accesses = 0

    def search(self, ids: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents (index in the shard) of the weighted terms, and their scores."""
        use = (weights > 0) & (self.start[ids + 1] > self.start[ids])
        ids, weights = ids[use], weights[use]
        begin, end = self.start[ids], self.start[ids + 1]
        self.weights[ids] = weights
        best = begin.copy()                    # best position of each list, exclusive
        at, depth = begin.copy(), FIRST_DEPTH
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        marked, met = [], []
        while (at < end).any():
            upto = np.minimum(at + depth, end)
            new = np.unique(self.list_doc[ranges(at, upto - at)])
            new = new[~self.known[new]]
            self.known[new] = True
            met.append(new)
            entries = ranges(self.to[new], self.to[new + 1] - self.to[new])
            w = self.weights[self.term[entries]]
            places = self.position[entries[w > 0]]
            self.seen[places] = True
            marked.append(places)
            if len(new):
                score = np.add.reduceat(w * self.impact[entries], np.concatenate([[0], np.cumsum(self.to[new + 1] - self.to[new])[:-1]]))
                docs, scores = np.concatenate([docs, new]), np.concatenate([scores, score])
                keep = top(scores, self.tie[docs], k)
                docs, scores = docs[keep], scores[keep]
            for i, (b, e) in enumerate(zip(best, end)):
                run = self.seen[b:e]
                if len(run):
                    stop = int(run.argmin())
                    best[i] = b + stop if not run[stop] else e
            at, depth = upto, depth * 2
            bound = int((weights * np.where(best < end, self.list_impact[np.maximum(best - 1, begin)], 0)).sum())
            if len(scores) >= k and bound < scores[-1]:
                break
        self.accesses = int((at - begin).sum())
        for places in marked:
            self.seen[places] = False
        for new in met:
            self.known[new] = False
        self.weights[ids] = 0
        full = scores > 0
        return docs[full], scores[full]


def _shards(batches: Iterator[pa.RecordBatch], bounds: Bounds) -> Iterator[pa.Table]:
    held, size, docs = [], 0, 0
    for batch in batches:
        per = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(per)])
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(total, total[at] + bounds.postings - size, side="right")) - 1
            to = min(max(to, at), batch.num_rows, at + bounds.docs - docs)
            if to > at:
                held.append(batch.slice(at, to - at))
                size, docs = size + int(total[to] - total[at]), docs + to - at
            elif not held:                     # one document beyond the bound is a shard of its own
                held.append(batch.slice(at, 1))
                to, size = at + 1, bounds.postings
            at = to
            if at < batch.num_rows or size >= bounds.postings or docs >= bounds.docs:
                yield pa.Table.from_batches(held)
                held, size, docs = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _block(rows: DataFrame, docs: DataFrame, k: int, bounds: Bounds) -> DataFrame:
    """Search of one block of items (item_id, text): item_id, doc_id, score, k rows at most per item and shard."""
    items = rows.collect()
    kinds = f"item_id {dict(rows.dtypes)['item_id']}, doc_id {dict(docs.dtypes)['doc_id']}, score bigint"
    flat, to = terms(pa.array([r["text"] for r in items], pa.string()))
    flat = flat.to_pylist()
    vocabulary = sorted(set(flat))
    index = {t: i for i, t in enumerate(vocabulary)}
    table = written(postings(docs, vocabulary), "postings")
    n_docs, length = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(table.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    w = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    queries = []
    for j in range(len(items)):
        ids, times = np.unique(np.array([index[t] for t in flat[to[j]:to[j + 1]]], np.int64), return_counts=True)
        queries.append((ids, w[ids] * times))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((queries, [r["item_id"] for r in items], len(vocabulary)))
    names, id_type = ["item_id", "doc_id", "score"], to_arrow_type(rows.schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, item_ids, n_terms = shared.value
        item_ids = pa.array(item_ids, id_type)
        for part in _shards(batches, bounds):
            part = part.combine_chunks()
            ids, lists, tfs = part.column("doc_id"), part.column("terms"), part.column("tfs")
            per = pc.list_value_length(lists).to_numpy()
            tie = np.empty(len(ids), np.int64)
            tie[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            shard = Shard(tie, part.column("n").to_numpy(), np.concatenate([[0], np.cumsum(per)]).astype(np.int64),
                          pc.list_flatten(lists).to_numpy(), pc.list_flatten(tfs).to_numpy(), n_terms, n_docs, max(1, length))
            found = [(j, *shard.search(*query, k)) for j, query in enumerate(queries)]
            item = np.concatenate([np.full(len(d), j) for j, d, _ in found] + [np.zeros(0, np.int64)]).astype(np.int64)
            doc = np.concatenate([d for _, d, _ in found] + [np.zeros(0, np.int64)]).astype(np.int64)
            score = np.concatenate([s for _, _, s in found] + [np.zeros(0, np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [item_ids.take(pa.array(item)), ids.take(pa.array(doc)).combine_chunks(), pa.array(score)], names=names)

    return table.mapInArrow(run, kinds)


def search(items: DataFrame, docs: DataFrame, k: int = 10, bounds: Bounds = Bounds()) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of every item."""
    items = written(items.groupBy("item_id").agg(F.min("text").alias("text")).where("text is not null"), "items")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / bounds.item_bytes))
    found = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = _block(part, docs, k, bounds)
        found = rows if found is None else found.unionByName(rows)
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: DuckDB statement for search(benchmark, documents).
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLD}, '{_PATTERN}') AS ts
           FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, t, count(*) AS times FROM (
          SELECT item_id, unnest(regexp_extract_all({_FOLD}, '{_PATTERN}')) AS t
          FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id) WHERE text IS NOT NULL) GROUP BY item_id, t),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0),
p AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY rid, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM p, s GROUP BY t),
m AS (SELECT rid, doc_id, 100 - 75 + ((75 * len(ts) * n_docs) // total) AS m FROM d, s WHERE len(ts) > 0),
r AS (SELECT item_id, rid, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (rid) GROUP BY item_id, rid)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM r JOIN (SELECT rid, doc_id FROM d) USING (rid) WHERE score > 0) WHERE rank <= 10
"""
