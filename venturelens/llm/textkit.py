"""Shared pieces: splits by doc_id, bounded labelled samples, words of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from venturelens.session import written

#: Text of one working slice inside a task; a longer text is a slice of its own.
SLICE_BYTES = 6 << 20

_AZ = np.arange(256, dtype=np.uint8)
_AZ[65:91] += 32


def remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text modulo ``mod``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % F.lit(mod)


def held_out(doc_id: str | Column, mod: int, rest: int) -> Column:
    """True for rows that no model may learn from; a null id counts as not held out."""
    return F.coalesce(remainder(doc_id, mod) == rest, F.lit(False))


def _sample_hash(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 40))


def _sample_slack(per_stratum: int) -> int:
    """Rows that the hash threshold leaves on average: enough that the bound is nearly surely reached."""
    return per_stratum + 6 * int(per_stratum ** 0.5) + 20


def bounded_sample(rows: DataFrame, stratum: str | None, per_stratum: int, key: str = "doc_id") -> DataFrame:
    """At most ``per_stratum`` rows of each stratum (None: of all rows), those of the smallest key hashes.

    A hash threshold from the strata's counts leaves little more than the bound
    before the exact cut, so that no stratum is gathered whole in one task.
    Reruns choose the same rows.
    """
    if stratum is None:
        n = max(1, rows.count())
        h, slack = _sample_hash(key), _sample_slack(per_stratum)
        return rows.withColumn("_h", h).where(F.col("_h") <= slack * (1 << 40) // n).orderBy("_h", key).limit(per_stratum).drop("_h")
    # written: Spark then knows the bytes, and does not shuffle the rows by stratum to join a few counts
    counts = written(rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")), "strata")
    near = (rows.join(counts, stratum).withColumn("_h", _sample_hash(key))
            # in double: the product of the two bigints passes 2^63 from 2^23 rows per stratum on
            .where(F.col("_h").cast("double") * F.col("_n") <= F.lit(float(_sample_slack(per_stratum))) * F.lit(float(1 << 40))))
    w = Window.partitionBy(stratum).orderBy("_h", key)
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_stratum).drop("_n", "_h", "_r")


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores as no column has it (column names do not differ by case alone)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows holding at most ``max_bytes`` of ``column`` (one row at least)."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))])
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(size, size[at] + max_bytes, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(texts: pa.Array, lower: bool = True, table: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """Runs of characters outside [\\x20\\x09-\\x0D] of every text, and where each text's begin.

    Null counts as empty; ``lower`` folds A-Z only; ``table`` replaces bytes first (others that part words by spaces).
    """
    split = pc.ascii_split_whitespace(compact(texts, table if table is not None else _AZ if lower else None))
    flat, ends = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        flat = flat.filter(pa.array(full))
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
    return flat, ends.astype(np.int64)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts (null counts as empty), joined, and each text's number of bytes."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    # a copy that begins at offset 0: some Arrow kernels misread slices
    texts = pc.fill_null(pa.concat_arrays([texts.cast(pa.large_string()), pa.array([""], pa.large_string())]), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts)]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, np.diff(offsets)


def compact(texts: pa.Array, table: np.ndarray | None = None) -> pa.Array:
    """The texts as one array from offset 0 (null: empty), each byte replaced by ``table`` where given."""
    raw, size = raw_bytes(texts)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    raw = raw if table is None else table[raw]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw)))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start .. start + length - 1 of every pair, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - before, lengths)
