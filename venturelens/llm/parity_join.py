"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles, each a 64-bit hash.  Two sets
of sizes p and q reach the similarity only if their symmetric difference is at
most (1 - s) / (1 + s) * (p + q).

*Parity sketch.*  Every shingle flips one bit, so the exclusive or of two
sketches is the sketch of the symmetric difference, and their Hamming distance
is at most its size.  A 512-bit sketch of the whole set rejects candidates.

*Pigeonhole.*  Within a band of sizes, the hash range is divided into more
parts than the largest symmetric difference that a linked pair of that band
can have.  A shingle outside the intersection touches one part only, so at
least one part of a linked pair holds the same shingles, hence the same parity
word and the same exclusive or of hashes.  These two make the key by which
sketches are joined.  Spare parts let empty parts go without a key: there are
``spare + 1`` equal parts, so where a set has at most ``spare`` empty ones, one
of the equal parts has shingles.  A set with more empty parts gives those keys
as well, so no pair is lost.  A set whose partner may be in the next band gives
keys for both.

*Sections.*  512 bits tell long sets apart no more: sets of 1,152 shingles that share nothing
differ in no more bits than linked ones may.  A band of long sets therefore divides the hash
range into sections of at most 512 shingles on average, and its parts evenly among them.  In one section at
least a linked pair differs by no more than the sections' average, hence has an equal
part there: the pigeonhole holds within that section.  A key names its section, and the
members of its bucket are compared by the 512-bit sketches of that section alone.

*Links.*  Equal sets are one class, represented by its smallest doc_id.  In a
first round every member of a key's bucket meets the bucket's smallest member
(as many candidates as members; with ``sparing`` each set's nearest alone).
The verified links make components.  Then
a bucket whose members still lie in several components has its
members of different components compared by sketch, in blocks of bounded
size: first a least spanning forest of the pairs that pass is verified, which joins
nearly all components that are to be joined; then every pair that still passes (with ``sparing`` buckets of
two as well, whose members need not have been each other's nearest).
Members of one component need no further
comparison, so a large group of near copies costs few pairs, and no link between
two components is lost.  Of buckets with the same members one is compared.  Verification intersects the whole sets.

Rules: A-Z are lower-cased, words are runs of [^\\x20\\x09-\\x0D]; a text with
fewer words than a shingle has its whole sequence as its only shingle; a text
without words (or null) has an empty set and is linked with nothing; rows that
share a doc_id are one document; rows without doc_id are linked with nothing
and have a null component.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import xxhash

from venturelens.llm.components import components, split_join
from venturelens.llm.components import forest as smallest
from venturelens.llm.textkit import mix64, ranges, slices, words
from venturelens.session import discard, written

#: 64-bit words of the sketch that rejects candidates, and the most members of a bucket in one block.
FOLD_WORDS, BLOCK = 8, 1024
#: Most sections of a band, and the bits of a key that name one: the heap number, sections + place.
SECTIONS = 1 << 11
NAMED = 2 * SECTIONS - 1
#: Keys that a task combines, and pairs of a block that it compares, at a time.
COMBINE, PAIRS = 500_000, 1 << 18
#: Bytes of text whose shingles a task makes at a time.
SLICE = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``n`` words, linked when 100 * intersection >= ``percent`` * union."""

    n: int = 5
    percent: int = 80

    def most_apart(self, total: int) -> int:
        """Largest symmetric difference of a linked pair whose sizes add up to ``total``."""
        return (100 - self.percent) * total // (100 + self.percent)

    def bands(self, size: int) -> range:
        """Bands in which a set of this size gives keys: its own and those of larger partners."""
        return range(bisect_left(_TOPS, size), bisect_left(_TOPS, size * 100 // self.percent) + 1)

    def sections(self, band: int) -> int:
        """Sections of a band: a power of two, one for sets that a sketch tells apart as a whole."""
        return min(SECTIONS, 1 << ((_TOPS[band] - 1) // (64 * FOLD_WORDS)).bit_length())

    def parts(self, band: int) -> tuple[int, int]:
        """Parts of each section of a band and how many of them are spare."""
        sections = self.sections(band)
        least = self.most_apart(2 * _TOPS[band]) // sections + 1
        low = (_TOPS[band - 1] + 1 if band else 1) / sections
        # half as many again as parts that stay empty, on average, in the band's smallest sets, and one;
        # of several sections none should have more
        empty = least * math.exp(-low / least)
        spare = 0 if least == 1 else 1 + math.ceil(max(1.5 * empty, empty + 3 * math.sqrt(empty) if sections > 1 else 0))
        return least + spare, spare


#: Largest set size of each band; a band's sizes differ by half.
_TOPS = [1]
while _TOPS[-1] < 1 << 40:
    _TOPS.append((_TOPS[-1] + 1) * 3 // 2)
#: How many sections the band of a key has, by the section's heap number.
_OF = np.array([0] + [1 << (c.bit_length() - 1) for c in range(1, NAMED + 1)])


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of every text, joined, and where each text's begin."""
    flat, ends = words(texts)
    coded = flat.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = each[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    counts = np.diff(ends)
    take = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    acc = mix64(np.full(int(take.sum()), n, np.uint64))
    starts = ranges(ends[:-1], take)
    span = np.repeat(np.minimum(counts, n), take)
    for j in range(n):
        live = span > j
        part = mix64((acc[live] + h[starts[live] + j]) * _ODD)
        acc[live] = part
    to = np.concatenate([[0], np.cumsum(take)])
    for a, b in zip(to[:-1], to[1:]):
        acc[a:b].sort()
    first = np.ones(len(acc), bool)
    first[1:] = acc[1:] != acc[:-1]
    first[to[:-1][take > 0]] = True
    kept = np.concatenate([[0], np.cumsum(first)])
    return acc[first], kept[to]


def _part_keys(h: np.ndarray, sim: Similarity) -> np.ndarray:
    """The join keys of one sorted set; the lowest bits are the section's heap number."""
    out = []
    top = h >> np.uint64(32)
    bit = np.uint64(1) << (h & np.uint64(63))
    for band in sim.bands(len(h)):
        (each, spare), sections = sim.parts(band), sim.sections(band)
        parts = each * sections
        part = (top * np.uint64(parts)) >> np.uint64(32)
        at = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        base = (part[at] + np.uint64(band << 40)) * _ODD
        out.append(_named(mix64(base ^ mix64(np.bitwise_xor.reduceat(bit, at) * _ODD + np.bitwise_xor.reduceat(h, at))),
                          part[at] // np.uint64(each), sections))
        if parts - len(at) > spare:
            scarce = each - np.bincount((part[at] // np.uint64(each)).astype(np.int64), minlength=sections) > spare
            empty = np.setdiff1d(np.flatnonzero(np.repeat(scarce, each)).astype(np.uint64), part[at])
            out.append(_named(mix64((empty + np.uint64(band << 40)) * _ODD ^ mix64(np.zeros(1, np.uint64))),
                              empty // np.uint64(each), sections))
    return np.concatenate(out)


def _named(keys: np.ndarray, section: np.ndarray, sections: int) -> np.ndarray:
    return keys & ~np.uint64(NAMED) | (section + np.uint64(sections))


def section_folds(hashes: np.ndarray, least: int, most: int) -> bytes:
    """Parity sketches of the sections that a set is divided into, ``least`` of them, twice as many and so on to ``most``: by heap number from ``least`` on."""
    bit = (hashes >> np.uint64(7)) & np.uint64(64 * FOLD_WORDS - 1)
    out = []
    while least <= most:
        section = ((hashes >> np.uint64(32)) * np.uint64(least)) >> np.uint64(32)
        flips = np.bincount((section * np.uint64(64 * FOLD_WORDS) + bit).astype(np.int64), minlength=least * 64 * FOLD_WORDS) & 1
        out.append(np.packbits(flips.astype(np.uint8)).tobytes())
        least *= 2
    return b"".join(out)


def _usable(batch: pa.RecordBatch, size: np.ndarray) -> np.ndarray:
    return batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False) & (size > 0)


def _set_id(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sketches(docs: DataFrame, sim: Similarity) -> DataFrame:
    """doc_id, n_shingles, set_id, code (half of set_id), f0 .. f7 (the parity sketch), least and sections.

    ``sections`` holds the sketches of the sections of the bands in which the set gives keys, from the heap number ``least`` on.
    """
    folds = [f"f{i}" for i in range(FOLD_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                h, to = shingle_sets(part.column("text"), sim.n)
                size = np.diff(to)
                flips = np.bincount(np.repeat(np.arange(len(size)), size) * (64 * FOLD_WORDS)
                                    + ((h >> np.uint64(7)) & np.uint64(64 * FOLD_WORDS - 1)).astype(np.int64),
                                    minlength=len(size) * 64 * FOLD_WORDS) & 1
                fold = np.packbits(flips.astype(np.uint8)).view(np.int64).reshape(len(size), FOLD_WORDS)
                ids = [_set_id(h[a:b]) if ok else None for a, b, ok in zip(to[:-1], to[1:], _usable(part, size))]
                codes = [None if i is None else int.from_bytes(i[:8], "little", signed=True) for i in ids]
                ends = [(sim.sections(b[0]), sim.sections(b[-1])) for b in map(sim.bands, size.tolist())]
                each = [fold[i].tobytes() if most == 1 else section_folds(h[to[i]:to[i + 1]], least, most) for i, (least, most) in enumerate(ends)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(codes, pa.int64()),
                     *(pa.array(np.ascontiguousarray(fold[:, i])) for i in range(FOLD_WORDS)),
                     pa.array([least for least, _ in ends], pa.int64()), pa.array(each, pa.binary())],
                    names=["doc_id", "n_shingles", "set_id", "code", *folds, "least", "sections"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_id binary, code bigint, " + ", ".join(f"{f} bigint" for f in folds)
        + ", least bigint, sections binary")


def combine(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) in order, and the smallest node of each one's key."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new_key = np.ones(len(keys), bool)
    new_key[1:] = keys[1:] != keys[:-1]
    new = new_key.copy()
    new[1:] |= nodes[1:] != nodes[:-1]
    hubs = nodes[new_key][np.cumsum(new_key) - 1]
    return keys[new], nodes[new], hubs[new]


def _keyed(docs: DataFrame, sim: Similarity) -> DataFrame:
    """(key, node, hub) of every key of every set; hub is the smallest node that the same task has seen for the key.

    Nodes are codes of sets, so copies give equal rows, and a task passes on one row per
    key and node of COMBINE keys, of which only the hub's goes on to meet those of other tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c) for c in combine(np.concatenate(keys), np.concatenate(nodes))],
                                              names=["key", "node", "hub"])

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                h, to = shingle_sets(part.column("text"), sim.n)
                for a, b, ok in zip(to[:-1], to[1:], _usable(part, np.diff(to))):
                    if ok:
                        keys.append(_part_keys(h[a:b], sim).view(np.int64))
                        nodes.append(np.full(len(keys[-1]), int.from_bytes(_set_id(h[a:b])[:8], "little", signed=True), np.int64))
                        held += len(keys[-1])
                if held >= COMBINE:
                    yield rows()
                    keys, nodes, held = [], [], 0
        if held:
            yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, "key bigint, node bigint, hub bigint")


def _met(keyed: DataFrame) -> DataFrame:
    """(key, node, hub) of every node that shares a key with a smaller one: the key's smallest, or its task's smallest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_hub = None
        for batch in batches:
            key, node, hub = (batch.column(c).to_numpy() for c in ("key", "node", "hub"))
            own = node == hub
            k, n, first = combine(key[own], node[own])
            if len(k):
                if k[0] == last_key:
                    first[k == last_key] = last_hub
                last_key, last_hub = k[-1], first[-1]
            far = n != first
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key[~own], k[far]])), pa.array(np.concatenate([node[~own], n[far]])),
                 pa.array(np.concatenate([hub[~own], first[far]]))], names=["key", "node", "hub"])

    # a task's smallest go by key; those that have met them already go anywhere
    return (keyed.repartition(F.when(F.col("node") == F.col("hub"), F.col("key")).otherwise(F.col("node")))
            .sortWithinPartitions("key", "node").mapInArrow(run, "key bigint, node bigint, hub bigint"))


def _alike(pairs: DataFrame, classes: DataFrame, sim: Similarity, sparing: bool) -> DataFrame:
    """The pairs (a, b) of representatives whose sizes and sketches allow a link, of pairs (a, b) of codes.

    With ``sparing`` each representative's nearest partner by sketch alone.
    """
    folds = [c for c in classes.columns if c.startswith("f")]
    side = {s: classes.select(F.col("code").alias(s), F.col("rep").alias(f"{s}_rep"), F.col("n_shingles").alias(f"{s}_n"),
                              *(F.col(c).alias(f"{s}_{c}") for c in folds)) for s in "ab"}
    apart = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in folds[1:]),
                F.bit_count(F.col(f"a_{folds[0]}").bitwiseXOR(F.col(f"b_{folds[0]}"))))
    total = F.col("a_n") + F.col("b_n")
    near = (split_join(pairs.join(side["a"], "a"), side["b"], "b", "a")
            .where((100 * F.least("a_n", "b_n") >= sim.percent * F.greatest("a_n", "b_n"))
                   & ((100 + sim.percent) * apart <= (100 - sim.percent) * total) & (F.col("a_rep") != F.col("b_rep"))))
    if not sparing:
        return near.select(F.greatest("a_rep", "b_rep").alias("a"), F.least("a_rep", "b_rep").alias("b")).distinct()
    return (near.groupBy(F.col("a_rep").alias("a")).agg(F.min(F.struct((apart / total).alias("d"), F.col("b_rep").alias("b"))).alias("r"))
            .select("a", F.col("r.b").alias("b")))


def wide_sketch(hashes: np.ndarray) -> bytes:
    """Parity sketch of at least four bits per shingle, its length a power of two."""
    bits = max(512, 1 << (4 * len(hashes) - 1).bit_length()) if len(hashes) else 512
    odd = np.bincount(((hashes >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def wide_distance(x: bytes | pa.Buffer, y: bytes | pa.Buffer) -> int:
    """Hamming distance of two sketches, the longer folded to the length of the shorter; at most the symmetric difference."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _verified(pairs: DataFrame, docs: DataFrame, sim: Similarity, sparing: bool) -> DataFrame:
    """The pairs (a, b) that are linked; written.

    With ``sparing`` a parity sketch that grows with the set (a sixteenth of its bytes) rejects pairs first.  The whole sets decide.
    """
    wanted = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "join-wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                h, to = shingle_sets(part.column("text"), sim.n)
                sets = [h[x:y] for x, y in zip(to[:-1], to[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.large_binary()),
                     pa.array([wide_sketch(s) for s in sets], pa.binary())], names=["node", "hashes", "wide"])

    whole = written(docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi")
                    .mapInArrow(sets, "node bigint, hashes binary, wide binary"), "join-sets")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("a_size").to_numpy() + batch.column("b_size").to_numpy()
            # one pair of sketches at a time, read where Arrow holds them
            apart = np.fromiter((wide_distance(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("a_wide"), batch.column("b_wide"))),
                                np.int64, batch.num_rows)
            mask = pa.array((100 + sim.percent) * apart <= (100 - sim.percent) * total)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    wide = {s: whole.select(F.col("node").alias(s), F.col("wide").alias(f"{s}_wide"), (F.octet_length("hashes") / 8).cast("long").alias(f"{s}_size"))
            for s in "ab"}
    if sparing:
        pairs = written(split_join(pairs.join(wide["a"], "a"), wide["b"].join(pairs.select("b").distinct(), "b", "left_semi"), "b", "a")
                        .mapInArrow(near, "a bigint, b bigint").distinct(), "join-near")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("a_set"), batch.column("b_set")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) and len(y) else 0
                good.append(100 * both >= sim.percent * (len(x) + len(y) - both) and both > 0)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    side = {s: whole.select(F.col("node").alias(s), F.col("hashes").alias(f"{s}_set")) for s in "ab"}
    partners = side["b"].join(pairs.select("b").distinct(), "b", "left_semi") if sparing else side["b"]
    linked = written(split_join(pairs.join(side["a"], "a"), partners, "b", "a").mapInArrow(meet, "a bigint, b bigint"), "join-links")
    discard(wanted, whole, *([pairs] if sparing else []))
    return linked


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the pairs that make a least spanning forest of the graph of all pairs, by ascending (weight, a, b)."""
    order = np.lexsort((b, a, weight))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)][order], ends[len(a):][order]
    root, live, keep = np.arange(len(nodes)), np.arange(len(order)), [np.zeros(0, np.int64)]
    while True:
        u, v = root[x[live]], root[y[live]]
        live, u, v = (c[u != v] for c in (live, u, v))
        if not len(live):
            return order[np.sort(np.concatenate(keep))]
        # each tree takes its first pair to another one
        first = np.full(len(nodes), len(order))
        np.minimum.at(first, u, live)
        np.minimum.at(first, v, live)
        keep.append(np.unique(first[first < len(order)]))
        inner, low = smallest(root[x[keep[-1]]], root[y[keep[-1]]])
        lower = np.arange(len(nodes))
        lower[inner] = low
        root = lower[root]


def _close(rows: dict[str, np.ndarray], folds: list[str], x: np.ndarray, y: np.ndarray, sim: Similarity) -> tuple[np.ndarray, ...]:
    """Of the places x, y of two members each: those whose sketches allow a link, and how far apart these are."""
    n, comp, chunk, sections = rows["n"], rows["component"], rows["chunk"], rows["sections"]
    ok = (comp[x] != comp[y]) & ((rows["i"][x] == rows["j"][x]) | (chunk[x] != chunk[y]))
    x, y = x[ok], y[ok]
    apart = np.zeros(len(x), np.int64)
    for c in folds:
        apart += np.bitwise_count((rows[c][x] ^ rows[c][y]).view(np.uint64))
    apart *= sections[x]
    ok = (100 + sim.percent) * apart <= (100 - sim.percent) * (n[x] + n[y])
    return x[ok], y[ok], apart[ok]


def block_pairs(rows: dict[str, np.ndarray], folds: list[str], sim: Similarity, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(larger, smaller) nodes of the pairs within each block of ``rows`` (whole blocks, one after the other), about PAIRS looked at at a time.

    Sketches are of one of ``sections`` sections (without that column: of the whole set).
    """
    rows = {"sections": np.ones(len(rows["key"]), np.int64), **rows}
    change = np.zeros(len(rows["key"]), np.int64)
    for c in ("key", "i", "j"):
        change[1:] |= rows[c][1:] != rows[c][:-1]
    block = np.cumsum(change)
    order = np.lexsort((rows["n"], block))
    rows, n, block = {c: v[order] for c, v in rows.items()}, rows["n"][order], block
    sizes, rank = np.unique(n, return_inverse=True)
    # partners are later members of the block that are not too large
    limit = np.searchsorted(sizes, n * 100 // sim.percent, side="right")
    far = np.searchsorted(block * (len(sizes) + 1) + rank, block * (len(sizes) + 1) + limit)
    at = np.arange(len(n))
    todo = np.maximum(far - at - 1, 0)
    done = np.concatenate([[0], np.cumsum(todo)])
    starts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(n)]])
    node = rows["node"]
    comps, comp = np.unique(rows["component"], return_inverse=True)
    tree = block * len(comps) + comp

    def ends(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(node[x], node[y]), np.minimum(node[x], node[y])

    run = 0
    while run < len(starts) - 1:
        # as many whole blocks as hold PAIRS, one at least
        to = max(run + 1, int(np.searchsorted(done[starts], done[starts[run]] + PAIRS, side="right")) - 1)
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        p, last = starts[run], starts[to]
        while p < last:
            q = max(p + 1, min(last, int(np.searchsorted(done, done[p] + PAIRS, side="right")) - 1))
            found = _close(rows, folds, np.repeat(at[p:q], todo[p:q]), ranges(at[p:q] + 1, todo[p:q]), sim)
            p = q
            if not forest:
                yield ends(*found[:2])
                continue
            # the forest of all pairs is that of the forest so far and the new ones
            held = tuple(np.concatenate(c) for c in zip(held, found))
            x, y, apart = held
            if len(x):
                # components of different blocks are different nodes of the forest
                keep = spanning(tree[x], tree[y], apart * 1000 // (n[x] + n[y]))
                held = x[keep], y[keep], apart[keep]
        if forest:
            yield ends(*held[:2])
        run = to


def _across(members: DataFrame, sim: Similarity, forest: bool) -> DataFrame:
    """Pairs of different components that share a block and may be linked; with ``forest`` a least spanning forest of them per block.

    ``members``: block columns (key, i, j), chunk (its own), node, component, size n, fold (sketch of the key's section).
    """
    folds = [f"f{i}" for i in range(FOLD_WORDS)]
    columns = [c for c in members.columns if c != "fold"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def found(parts):
            rows = {c: np.concatenate([p[c] for p in parts]) for c in [*columns, *folds]}
            rows["sections"] = _OF[rows["key"] & NAMED]
            if len(rows["key"]):
                for a, b in block_pairs(rows, folds, sim, forest):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            data = {c: batch.column(c).to_numpy() for c in columns}
            fold = np.frombuffer(b"".join(batch.column("fold").to_pylist()), np.int64).reshape(-1, FOLD_WORDS)
            data |= {c: fold[:, i] for i, c in enumerate(folds)}
            other = np.zeros(batch.num_rows, bool)
            for c in ("key", "i", "j"):
                other |= data[c] != data[c][-1]
            last = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            same = held and not last and all(held[-1][c][-1] == data[c][-1] for c in ("key", "i", "j"))
            if same:        # the block goes on
                held.append(data)
                continue
            yield from found([*held, {c: v[:last] for c, v in data.items()}])
            held = [{c: v[last:] for c, v in data.items()}]
        if held:
            yield from found(held)

    return (members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(run, "a bigint, b bigint").distinct())


def _blocks(members: DataFrame, comp: DataFrame, classes: DataFrame, sparing: bool = False) -> DataFrame:
    """Members (key, node) of the buckets that hold several components, in blocks of at most 2 * BLOCK.

    The first round has compared a bucket of two, unless it was ``sparing``: then the larger member has met its nearest
    partner alone, which another bucket may have given it.
    """
    placed = members.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # one component needs no more links; of a section's buckets with the same members one is enough
    section = F.col("key").bitwiseAND(NAMED)
    open_keys = (placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"),
                                           F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
                 .where(f"lo <> hi AND m > {1 if sparing else 2}").groupBy("m", "x", "y", section).agg(F.min("key").alias("key"))
                 .select("key", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int").alias("chunks")))
    return (placed.join(open_keys, "key")
            .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .join(classes.select(F.col("rep").alias("node"), F.col("n_shingles").alias("n"), "least", "sections"), "node")
            # padded for a twin's keys, of which the set itself may not have the section
            .withColumn("fold", F.expr(f"rpad(substring(sections, cast((key & {NAMED}) - least as int) * {8 * FOLD_WORDS} + 1, {8 * FOLD_WORDS}), {8 * FOLD_WORDS}, X'00')"))
            .drop("least", "sections")
            .withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("other", "chunks"))


def join(docs: DataFrame, sim: Similarity = Similarity(), sparing: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row.

    ``sparing`` shuffles fewer whole sets at the cost of more, smaller jobs; the result is the same.  It pays at low
    similarities, where the fixed sketch lets pairs of long texts pass.
    """
    every = written(sketches(docs, sim), "join-sketches")
    same = [c for c in every.columns if c not in ("doc_id", "set_id", "code")]
    classes = written(every.where("set_id IS NOT NULL").groupBy("set_id", "code").agg(
        F.min("doc_id").alias("rep"), *(F.min(c).alias(c) for c in same)), "join-classes")
    met = written(_met(_keyed(docs, sim)), "join-buckets")
    # different sets of one code (a chance of 2**-64 for two sets) meet as well
    twins = classes.groupBy("code").count().where("count > 1").select(F.col("code").alias("a"), F.col("code").alias("b"))
    meetings = met.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct().unionByName(twins)
    first = written(_alike(meetings, classes, sim, sparing), "join-pairs")
    links = _verified(first, docs, sim, sparing)
    comp = written(components(links), "join-components")

    members = met.select("key", "node").union(met.select("key", F.col("hub").alias("node"))).distinct()
    members = written(members.join(classes.select(F.col("code").alias("node"), "rep"), "node")
                      .select("key", F.col("rep").alias("node")), "join-members")
    discard(met, first)
    for forest in (True, False):
        second = written(_across(_blocks(members, comp, classes, sparing), sim, forest), "join-pairs")
        if second.isEmpty():
            discard(second)
            break
        more = _verified(second, docs, sim, sparing)
        before = comp, second, links, more
        links = written(links.unionByName(more), "join-links")
        comp = written(components(links), "join-components")
        discard(*before)
    discard(members, links)
    group = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_id", F.coalesce("component", "rep").alias("component_id"))
    return (every.select("doc_id", "n_shingles", "set_id").join(group, "set_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """``docs`` with the document of smallest doc_id of every component; rows without doc_id stay."""
    gone = join(docs, sim, sparing=True).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * common >= 90 * (u.n + v.n - common)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.seen) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY ALL
"""
