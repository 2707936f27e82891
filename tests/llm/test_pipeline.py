import base64
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
from common import jaccard_components
from pyspark.sql import functions as F
from venturelens.llm import byte_bpe, mixing, parity_join, stream_dedup
from venturelens.llm.registry import tokenizer_file, tokenizer_pattern

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, SF)
    rows = {r.doc_id: r for r in good.collect()}
    assert good.columns == docs.columns and 0.6 * docs.count() < len(rows) < docs.count()
    # exact: the longest, then the smallest id of equal texts
    groups = {}
    for r in rows.values():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append((-len(r.text), r.doc_id))
    kept = sorted(min(g)[1] for g in groups.values())
    # near: the smallest id of each component
    comp = jaccard_components([(i, rows[i].text) for i in kept], 5, 80)
    kept = sorted({c for _, _, c in comp})
    left = spark.createDataFrame([tuple(rows[i]) for i in kept], docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix(left).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_file("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokenizer_pattern(), mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, len(ids := enc.encode_ordinary(rows[i].text)), tuple(ids)) for i in kept for _ in range(copies[i]))
    got = sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("copies", F.lit(1)).withColumn("component_id", F.lit("x"))
    for stage in (stream_dedup.keep_one, parity_join.keep_one, mixing.mixed):
        assert stage(docs.limit(0)).columns == docs.columns and stage(docs.limit(0)).count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and byte_bpe.LONG_TEXT > byte_bpe.PIECE


def test_near_dedup_keeps_links_of_buckets_of_two(spark):
    """A set whose only shared keys with each of two partners are theirs alone is linked with both, not with the nearest only."""
    sim, rng = parity_join.Similarity(5, 80), np.random.default_rng(1)
    found = []
    while len(found) < 3:
        base = rng.integers(0, 1 << 30, (4000, 11))
        texts = [" ".join(map(str, r)) for part in (base[:, 1:-1], base[:, :-1], base[:, 1:]) for r in part]     # 5 shingles, and one more at an end
        h, to = parity_join.shingle_sets(pa.array(texts), 5)
        keys, codes = [], []
        for a, b in zip(to[:-1], to[1:]):
            keys.append(set(parity_join._part_keys(h[a:b], sim).tolist()))
            codes.append(int.from_bytes(parity_join._set_id(h[a:b])[:8], "little", signed=True))
        for i in range(4000):
            mid, left, right = i, 4000 + i, 8000 + i
            if codes[mid] > max(codes[left], codes[right]) and not keys[mid] & keys[left] & keys[right]:
                found.append([texts[j] for j in (left, right, mid)])
    rows = [(10 * n + k, t) for n, group in enumerate(found) for k, t in enumerate(group)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sparing in (False, True):
        got = {r.doc_id: r.component_id for r in parity_join.join(docs, sim, sparing).collect()}
        assert got == {d: d // 10 * 10 for d, _ in rows}, sparing


def test_section_keys_and_sketches_lose_no_linked_pair():
    """Some common key names a section in which a linked pair's sketches pass; long sets that merely share keys do not."""
    sim, rng, long = parity_join.Similarity(5, 80), np.random.default_rng(5), 0
    for _ in range(300):
        n = int(rng.choice([1, 4, 30, 300, 700, 1500, 4000]))
        base = rng.integers(0, 1 << 63, n + n // 8, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        x = np.unique(np.concatenate([base[:n], base[n:]]) if rng.random() < 0.3 else base[:n])
        y = np.unique(np.concatenate([base[n // 9:n], base[n:n + rng.integers(0, n // 9 + 1)]]))
        common = len(np.intersect1d(x, y))
        if 100 * common < 80 * (len(x) + len(y) - common):
            continue
        assert close_in_a_section(x, y, sim)
        long += len(x) > 1200
    assert long > 30
    passed = 0
    for _ in range(40):                                         # half of the shingles in common
        base = rng.integers(0, 1 << 63, 4500, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        x, y = np.sort(base[:3000]), np.sort(base[1500:])
        whole = sum(int(np.bitwise_count(a ^ b)) for a, b in zip(*(np.frombuffer(parity_join.section_folds(z, 1, 1), np.uint64) for z in (x, y))))
        assert 180 * whole <= 20 * 6000                         # one sketch of the whole set lets the pair pass
        passed += close_in_a_section(x, y, sim)
    assert passed <= 2


def close_in_a_section(x, y, sim):
    keys = np.intersect1d(*(parity_join._part_keys(z, sim) for z in (x, y)))
    folds = {}
    for name, z in (("x", x), ("y", y)):
        bands = sim.bands(len(z))
        least, most = sim.sections(bands[0]), sim.sections(bands[-1])
        cut = np.frombuffer(parity_join.section_folds(z, least, most), np.uint64).reshape(-1, parity_join.FOLD_WORDS)
        assert len(cut) == 2 * most - least and (np.bitwise_xor.reduce(cut[:least]) == np.frombuffer(parity_join.section_folds(z, 1, 1), np.uint64)).all()
        folds[name] = {least + i: f for i, f in enumerate(cut)}
    for section in {int(k) & parity_join.NAMED for k in keys}:
        apart = int(np.bitwise_count(folds["x"][section] ^ folds["y"][section]).sum())
        if 180 * apart * int(parity_join._OF[section]) <= 20 * (len(x) + len(y)):
            return True
    return False


def test_token_ids_are_held_as_four_bytes_each(spark, monkeypatch):
    """No list of all ids of a slice: what a task holds of a text it has encoded are four bytes an id."""
    import tracemalloc

    ranks = byte_bpe.read_ranks(spark, tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    texts = [f"{i} " + " ".join(f"w{i * j % 9973} x{j}" for j in range(400)) for i in range(300)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, keep = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: made.append(run) or keep(self, run, schema))
    byte_bpe.encode(rows, ranks, tokenizer_pattern())
    run, = made
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    out, = run(iter([batch]))
    tracemalloc.start()
    again, = run(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    codec = byte_bpe.Codec(ranks, tokenizer_pattern())
    assert again.equals(out) and out.column("ids").to_pylist() == [codec.encode(t or "") for t in texts]
    assert out.column("n_tokens").to_pylist() == [len(x) for x in out.column("ids").to_pylist()]
    assert peak < 14 * sum(out.column("n_tokens").to_pylist())
