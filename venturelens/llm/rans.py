"""Token ids in a binary format coded by a static range asymmetric numeral system.

*Tokens.*  The tokenizers library encodes each text.  White space separates
its words whatever stands around them, so a task encodes each distinct word of
its slices once and joins the words' ids (a word's closing ASCII punctuation is
a token run of its own and is split off first).

*Shared table.*  Id counts over all documents give one frequency table (2**20
slots), the same for every block; its size is that of the vocabulary.

*Files.*  Documents are range-partitioned and sorted by doc_id.  Each partition
is a shard; it writes frames of whole documents with at least ``FRAME`` ids.  A
frame's ids are cut into independent blocks of LANES interleaved states and
STEPS steps each.  A block stores its initial states, a checkpoint (states and
word position) every ``STEPS // PARTS`` steps, and its words, so that a reader
decodes all parts of all blocks at once or starts at any checkpoint.  A frame
carries the crc32 of its payload and of its ids, both checked when it is read.
Frames are rows of Parquet files in the shared folder: the writer's commit
protocol makes a lost task's file reappear whole or not at all.

A null text counts as empty; an empty text has only the end id.  Rows that
share a doc_id are all kept, next to each other; rows without doc_id come
first.  An empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venturelens.llm.textkit import ranges, slices, words
from venturelens.session import written

LANES, STEPS, PARTS, PROB_BITS, FRAME = 64, 256, 2, 20, 1 << 18
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sQIII")      # magic, ids, blocks, crc32 of the payload, crc32 of the ids
_TAIL = re.compile(r"(?<=[A-Za-z0-9À-ÖØ-öø-ÿ])[!-&(-/:-@\[-`{-~]+\Z")


def word_list(words: pa.Array) -> list[str]:
    """The words as Python strings; none holds a space, so one joined string is split, which is much cheaper."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), " ")[0].as_py().split(" ")


class WordCoder:
    """Ids of distinct words, kept from slice to slice of a Python worker.

    A word is a number; its ids are ``flat[start[number]:start[number] + size[number]]``.
    """

    #: Words, or parts of words, beyond which all are forgotten.
    MOST = 1_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {"": 0}
        self.flat, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.start = np.zeros(1 << 14, np.int64)
        self.n_ids, self.n = 0, 1                        # number 0: nothing

    def _store(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of new entries with these ids, one after the other."""
        while self.n_ids + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(size) > len(self.size):
            self.size, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.start))
        at, numbers = self.n_ids, np.arange(self.n, self.n + len(size))
        self.flat[at:at + len(flat)] = flat
        self.size[numbers] = size
        self.start[numbers] = at + np.cumsum(size) - size
        self.n_ids, self.n = at + len(flat), self.n + len(size)
        return numbers

    def _learn(self, stems: list[str]) -> None:
        plain = [s for s in stems if s.isascii()]
        if plain:
            # one text for all of them: a token belongs to the word in which it starts
            got = self.tokenizer.encode(" ".join(plain), add_special_tokens=False)
            size = np.fromiter(map(len, plain), np.int64, len(plain))
            starts = np.cumsum(size + 1) - size - 1
            first = np.fromiter((a for a, _ in got.offsets), np.int64, len(got.ids))
            cut = np.append(np.searchsorted(first, starts), len(first))
            self.parts.update(zip(plain, self._store(np.array(got.ids, np.uint32), np.diff(cut)).tolist()))
        other = [s for s in stems if not s.isascii()]
        if other:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            size = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((i for ids in got for i in ids), np.uint32, int(size.sum()))
            self.parts.update(zip(other, self._store(flat, size).tolist()))

    def numbers(self, vocab: list[str]) -> np.ndarray:
        """The number of every word; valid until the next call."""
        if max(len(self.words), len(self.parts)) > self.MOST:
            self._forget()
        out = np.fromiter(map(self.words.get, vocab, repeat(-1)), np.int64, len(vocab))
        unknown = np.flatnonzero(out < 0)
        if len(unknown):
            new, stems, tails = [vocab[i] for i in unknown.tolist()], [], []
            for w in new:
                m = None if w[-1].isalnum() else _TAIL.search(w)
                stem, tail = (w[:m.start()], m[0]) if m else (w, "")
                stems.append(stem.lower() if stem.isascii() else stem)
                tails.append(tail)
            self._learn([p for p in dict.fromkeys(chain(stems, tails)) if p not in self.parts])
            stem, tail = (np.fromiter(map(self.parts.__getitem__, p), np.int64, len(p)) for p in (stems, tails))
            whole = stem.copy()
            ended = np.flatnonzero(tail)
            if len(ended):
                both = np.stack([stem[ended], tail[ended]], 1).ravel()
                size = self.size[both]
                whole[ended] = self._store(self.flat[ranges(self.start[both], size)], size.reshape(-1, 2).sum(1))
            self.words.update(zip(new, whole.tolist()))
            out[unknown] = whole
        return out


_CODERS: dict[str, WordCoder] = {}


def _coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian uint16 or uint32) of every row, the end id included.

    ``tokenizer_path`` is a file that every machine has (an installed package's).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, to = words(part.column("text"), lower=False)
                coded = flat.dictionary_encode()
                number = coder.numbers(word_list(coded.dictionary))
                start, size = np.append(coder.start[number], coder.n_ids), np.append(coder.size[number], 1)
                # the words of every document, then the end id, which stands after all ids of the words
                order = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), to[1:], len(number))
                flat_ids = np.append(coder.flat[:coder.n_ids], np.uint32(end_id))
                ids = flat_ids[ranges(start[order], size[order])].astype(kind)
                ends = np.concatenate([[0], np.cumsum(size[order])])[to + np.arange(len(to))]
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ends), pa.int64()),
                     pa.array([raw[a * kind.itemsize:b * kind.itemsize] for a, b in zip(ends[:-1], ends[1:])], pa.binary())],
                    names=["doc_id", "n_tokens", "ids"])

    kind = id_type(tokenizer_path)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids binary")


def id_type(tokenizer_path: str) -> np.dtype:
    return np.dtype("<u2" if _coder(tokenizer_path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4")


def frequencies(tokens: DataFrame, kind: np.dtype) -> np.ndarray:
    """Slots of each id: counts over all rows, scaled to 2**PROB_BITS, at least one where an id occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=len(total))
            n[:len(total)] += total
            total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    if not rows.num_rows:
        return np.zeros(1, np.int64)
    count = np.zeros(int(rows.column("id").to_numpy().max()) + 1, np.float64)
    count[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    slots = 1 << PROB_BITS
    if rows.num_rows > slots:
        raise ValueError(f"{rows.num_rows} distinct ids do not fit a table of {slots} slots")
    freq = np.where(count > 0, np.maximum(1, np.floor(count * (slots / count.sum()))), 0).astype(np.int64)
    while (over := int(freq.sum()) - slots) != 0:
        if over < 0:
            freq[np.argmax(freq)] -= over
        else:                                            # the most frequent ids give up what the single slots took
            top = np.argsort(-freq, kind="stable")[:max(1, min(over, int((freq > 1).sum())))]
            freq[top] -= np.minimum(freq[top] - 1, -(-over // len(top)))
    return freq


def encode_ids(ids: np.ndarray, freq: np.ndarray) -> bytes:
    """One frame: header, checkpoints and words of all blocks."""
    n = len(ids)
    blocks = max(1, -(-n // (LANES * STEPS)))
    cum = np.concatenate([[0], np.cumsum(freq)]).astype(np.uint64)
    f64 = freq.astype(np.uint64)
    fill = int(np.argmax(freq))
    sym = np.full(blocks * STEPS * LANES, fill, np.int64)
    sym[:n] = ids
    sym = sym.reshape(blocks, STEPS, LANES).transpose(1, 0, 2).reshape(STEPS, -1)
    state = np.full(blocks * LANES, _LOW, np.uint64)
    spill = np.zeros((STEPS, blocks * LANES), np.uint32)
    full = np.zeros((STEPS, blocks * LANES), bool)
    marks = np.zeros((PARTS, blocks * LANES), np.uint64)
    each = STEPS // PARTS
    for k in range(STEPS - 1, -1, -1):
        s = sym[k]
        f = f64[s]
        over = state >= (f << np.uint64(63 - PROB_BITS))
        full[k] = over
        spill[k] = state.astype(np.uint32)
        state = np.where(over, state >> np.uint64(32), state)
        q, r = np.divmod(state, f)
        state = (q << np.uint64(PROB_BITS)) + r + cum[s]
        if k % each == 0:
            marks[k // each] = state
    by_block = full.reshape(STEPS, blocks, LANES).transpose(1, 0, 2)
    stream = spill.reshape(STEPS, blocks, LANES).transpose(1, 0, 2)[by_block]
    per_part = by_block.reshape(blocks, PARTS, each * LANES).sum(2).ravel()
    places = (np.cumsum(per_part) - per_part).astype("<u4")
    payload = b"".join([places.tobytes(), marks.reshape(PARTS, blocks, LANES).transpose(1, 0, 2).astype("<u8").tobytes(), stream.astype("<u4").tobytes()])
    return _HEAD.pack(b"RANS", n, blocks, zlib.crc32(payload), zlib.crc32(np.asarray(ids, "<u4").tobytes())) + payload


class Decoder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    def decode(self, frame: bytes) -> np.ndarray:
        """The ids of one frame, all parts of all blocks side by side."""
        magic, n, blocks, payload_crc, ids_crc = _HEAD.unpack_from(frame)
        body = memoryview(frame)[_HEAD.size:]
        if magic != b"RANS" or zlib.crc32(body) != payload_crc:
            raise ValueError("frame is damaged")
        parts = blocks * PARTS
        at = np.frombuffer(body, "<u4", parts).astype(np.int64)
        state = np.frombuffer(body, "<u8", parts * LANES, parts * 4).reshape(parts, LANES).copy()
        stream = np.append(np.frombuffer(body, "<u4", offset=parts * 4 + parts * LANES * 8), np.uint32(0)).astype(np.uint64)
        out = np.empty((parts, STEPS // PARTS, LANES), np.int32)
        low = np.uint64((1 << PROB_BITS) - 1)
        for k in range(STEPS // PARTS):
            slot = state & low
            s = self.symbol[slot]
            out[:, k] = s
            state = self.freq[s] * (state >> np.uint64(PROB_BITS)) + slot - self.cum[s]
            need = state < _LOW
            place = at[:, None] + np.cumsum(need, 1) - 1
            state = np.where(need, (state << np.uint64(32)) | stream[np.where(need, place, 0)], state)
            at += need.sum(1)
        ids = out.reshape(-1)[:n].astype("<u4")
        if zlib.crc32(ids.tobytes()) != ids_crc:
            raise ValueError("ids do not match their checksum")
        return ids


def write(tokens: DataFrame, freq: np.ndarray, kind: np.dtype) -> DataFrame:
    """Writes the frames and returns the table read back: shard, frame, start, doc_ids, lengths, data."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(freq)
    id_sql = dict(tokens.dtypes)["doc_id"]
    arrow_id = tokens.select("doc_id").limit(0).toArrow().schema.field("doc_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, frame, start = TaskContext.get().partitionId(), 0, 0
        docs, lengths, parts = [], [], []

        def flush():
            nonlocal frame, start, docs, lengths, parts
            total = sum(lengths)
            data = encode_ids(np.frombuffer(b"".join(parts), kind).astype(np.int64), shared.value)
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([frame], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([docs], pa.list_(arrow_id)), pa.array([lengths], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                names=["shard", "frame", "start", "doc_ids", "lengths", "data"])
            frame, start, docs, lengths, parts = frame + 1, start + total, [], [], []
            return row

        held = 0
        for batch in batches:
            for d, n, raw in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(d)
                lengths.append(n)
                parts.append(raw)
                held += n
                if held >= FRAME:
                    held = 0
                    yield flush()
        if docs:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(parts, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"))
    return written(ordered.mapInArrow(
        run, f"shard int, frame int, start bigint, doc_ids array<{id_sql}>, lengths array<bigint>, data binary"), "rans-frames")


def read(frames: DataFrame, freq: np.ndarray) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the frames."""
    shared = frames.sparkSession.sparkContext.broadcast(freq)
    id_sql = frames.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decoder.decode(batch.column("data")[i].as_py())
                size = batch.column("lengths")[i].values.to_numpy()
                ends = np.cumsum(size)
                starts = ends - size
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(np.full(len(size), batch.column("shard")[i].as_py()), pa.int32()),
                     pa.array(starts + batch.column("start")[i].as_py(), pa.int64()), pa.array(size, pa.int64()),
                     pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64())],
                    names=["doc_id", "shard", "within", "n_tokens", "ids_crc32"])

    docs = frames.select("shard", "start", "doc_ids", "lengths", "data").mapInArrow(
        run, f"doc_id {id_sql}, shard int, within bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = frames.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)       # a row per shard
    base = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return docs.join(base, "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Tokenise, write and read back ``docs``."""
    kind = id_type(tokenizer_path)
    tokens = written(tokenise(docs, tokenizer_path, end_id), "rans-tokens")
    freq = frequencies(tokens, kind)
    return read(write(tokens, freq, kind), freq)
