"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is read on the driver and broadcast (its size is that of the
vocabulary).  A task encodes each text without special tokens.  A long text is
first cut at safe boundaries, places where the split pattern must end one match
and begin another whatever stands around them: between a character that is no
white space and a single space or line feed that is followed by a character
that is no white space.  No match of the pattern spans such a place, so the
pieces' ids, joined, are those of the whole text.  A run of LONG_RUN white-space
characters or more, for which the library's pattern matcher runs out of stack, is cut out as
the match that the pattern makes of it: all but its last character, or all of it at the end of the text; the
match is encoded as one piece.  Decoding joins the raw bytes
of the ids; a character whose bytes lie in several ids comes back whole.

A null text is encoded as an empty one; an empty text has no ids and decodes to
no bytes; repeated rows are encoded alike; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from venturelens.llm.textkit import slices

#: Characters from which a text is cut, and the least length of a piece.
LONG_TEXT, PIECE = 1 << 16, 1 << 14
_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: White-space characters in a row that are encoded without the pattern.
LONG_RUN = 10_000
# White space as the library's pattern takes it: the Unicode property, without the separators U+001C .. U+001F.
_RUN = re.compile(r"[^\S\x1C-\x1F]{%d,}" % LONG_RUN)


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The rank file at ``path``: local to the driver, or in a store that Spark reads."""
    try:
        with open(path, "rb") as f:
            raw = f.read()
    except FileNotFoundError:
        raw = bytes(spark.read.format("binaryFile").load(path).first().content)
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def safe_pieces(text: str) -> Iterator[str]:
    """``text`` in pieces of at least PIECE characters, cut at safe boundaries."""
    at = 0
    while len(text) - at > PIECE and (m := _SAFE.search(text, at + PIECE)):
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


class Codec:
    """Encoder and decoder of one rank table; built once per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self._enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return self._enc.encode_ordinary(text)
        ids, at = [], 0
        for run in _RUN.finditer(text):
            # the run's last character goes with what follows
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += self._pieces(text[at:run.start()])
            ids += self._enc._encode_single_piece(text[run.start():end].encode())
            at = end
        return ids + self._pieces(text[at:])

    def _pieces(self, text: str) -> list[int]:
        if len(text) < LONG_TEXT:
            return self._enc.encode_ordinary(text)
        return [i for piece in safe_pieces(text) for i in self._enc.encode_ordinary(piece)]

    def decode(self, ids: list[int]) -> bytes:
        get = self._bytes.__getitem__
        return b"".join([get(i) for i in ids])


@lru_cache(maxsize=2)
def _codec(shared, pattern: str) -> Codec:
    return Codec(shared.value, pattern)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (array<int>) per document; with ``digests`` the ids' and the decoded bytes' sha256 instead."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    names = [str(i) for i in range(max(ranks.values(), default=-1) + 1)] if digests else []
    names = docs.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, name = _codec(shared, pattern), names.value.__getitem__
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = []
            for text in batch.column("text"):
                ids = codec.encode(text.as_py() or "")
                rows.append((len(ids), hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest(),
                             hashlib.sha256(codec.decode(ids)).hexdigest()) if digests
                            # four bytes an id: a slice's ids as Python numbers took some 100 MB
                            else (len(ids), np.array(ids, np.int32)))
            sizes, *rest = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), *(
                    (pa.array(c, pa.string()) for c in rest) if digests else
                    [pa.ListArray.from_arrays(pa.array(np.cumsum((0, *sizes)), pa.int32()), pa.array(np.concatenate(rest[0])))])], names=out)

    out = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids"])]
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"))


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id and the raw bytes of every row's ids."""
    shared = encoded.sparkSession.sparkContext.broadcast({i: b for b, i in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.__getitem__
        for batch in batches:
            raw = [b"".join(map(get, ids.as_py() or ())) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, bytes binary")
