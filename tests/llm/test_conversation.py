"""Operator 12 against exhaustive search and against its SQL on awkward tables."""
import itertools
import random
import re

import duckdb
import pytest
from venturelens.llm import conversation as C

LINES = ["Yes.", "no", "Why?", "", "  \t", "ok ok!", "well, ", "see. ", None]


def cheapest(rows, costs=C.Costs()):
    """All edit strings by depth-first search: (cost, letters) of the least."""
    best = [10 ** 9, ""]

    def go(i, state, cost, letters, inserts):
        if cost > best[0] + 0:
            return
        if i == len(rows) and state in (C.START, C.A) and (cost, letters) < tuple(best):
            best[:] = [cost, letters]
        if inserts < 7:
            go(i, C.NEXT[state, C.FILL[state]], cost + costs.insert, letters + "I", inserts + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, state, cost + costs.delete, letters + "D", inserts)
            if fault < C.DUPLICATE:
                extra = costs.truncated * (fault == C.TRUNCATED)
                if (state, initial) in C.NEXT:
                    go(i + 1, C.NEXT[state, initial], cost + costs.keep + extra, letters + "K", inserts)
                go(i + 1, C.NEXT[state, C.FILL[state]], cost + costs.rerole + extra, letters + "R", inserts)

    go(0, C.START, 0, "", 0)
    return tuple(best)


def decode(rows, costs=C.Costs()):
    got = []
    d = C.Decoder(lambda letters, row: got.append(letters), costs)
    for initial, fault in rows:
        d.row(initial, fault, None)
    d.end()
    return d.cost, "".join(got)


COSTS = [C.Costs(), C.Costs(0, 1, 2, 1, 5), C.Costs(1, 1, 1, 1, 1), C.Costs(0, 3, 2, 1, 0)]


@pytest.mark.parametrize("costs", COSTS)
def test_decoder_against_exhaustive_search(costs):
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 5):
        for _ in range(25):
            rows = [(rng.choice("suaaux "), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
            assert decode(rows, costs) == cheapest(rows, costs), rows


def test_lead_bounds_what_the_rest_costs():
    """No continuation is cheaper from one state than the bound allows."""
    for costs in COSTS:
        lead = costs.lead()
        for n in range(4):
            for rows in itertools.product([("s", 0), ("u", 0), ("a", 0), ("x", 0), ("u", 2), ("s", 1)], repeat=n):
                rest = []
                for e in range(4):
                    total, alive = 0, ((e, 0),)
                    for initial, fault in rows:
                        rise, alive, _ = C.advance(alive, initial if initial in "sua" else "", fault, costs)
                        total += rise
                    rest.append(total + C.finish(alive, costs)[1])
                assert all(rest[t] - rest[s] <= b for (t, s), b in lead.items()), (rows, rest)


def test_memory_is_bounded_by_what_is_unresolved(monkeypatch):
    monkeypatch.setattr(C, "LOOK", 4)
    rng = random.Random(3)
    sent, most = 0, 0

    def emit(letters, row):
        nonlocal sent
        sent += len(letters) - letters.count("I")

    d = C.Decoder(emit, C.Costs())
    for i in range(20_000):
        d.row(rng.choice("uuaas"), rng.choice([0, 0, 1, 2]), None)
        most = max(most, d.rows - sent)
    assert most < 200 and not any(node[3] != 1 for node in d.nodes)


def table(seed, rows=260):
    rng = random.Random(seed)
    out = []
    for _ in range(rows):
        conv = rng.choice([1, 1, 1, 2, 3, None, *range(10, 40)])
        turn = rng.choice([None, *range(80 if conv == 1 else 9)])
        out.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice(LINES)))
    return out + rng.sample(out, 40) + [(1, t, "user", "same") for t in range(60)] + [(2, 5, "user", "twin.")] * 30


def sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(C.ORACLE)
    return [d[0] for d in got.description], sorted(got.fetchall(), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bounds,cut", [(C.Bounds(), False), (C.Bounds(20, 30), True), (C.Bounds(0, 1), True), (C.Bounds(), True)])
def test_repair_against_sql(spark, bounds, cut):
    rows = table(11)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not cut).lower())
    try:
        frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", audit string, copies long")
        got = C.repair(C.damaged(frame), bounds=bounds)
        names, want = sql(rows)
        assert got.columns == names and sorted(map(tuple, got.collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repaired_messages_have_legal_roles_and_the_digest(spark):
    import hashlib

    rows = table(4)
    frame = C.damaged(spark.createDataFrame(rows, SCHEMA))
    digest = {r.conv_id: (r.repaired_sha256, r.audit) for r in C.repair(frame).collect()}
    found = {}
    for r in C.repaired_messages(frame, bounds=C.Bounds(50, 1 << 20)).orderBy("conv_id", "piece", "seq").collect():
        found.setdefault(r.conv_id, []).append(r)
    for conv, (sha, audit) in digest.items():
        run = found.get(conv, [])
        kept = [r for r in run if r.edit != "D"]
        assert "".join(r.edit for r in run) == audit
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r.role[:1] for r in kept))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == sha


def test_dropped_conversations_and_empty_tables(spark):
    import zlib

    gone = next(i for i in range(10 ** 6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    r = C.repair(C.damaged(spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA))).collect()
    assert [tuple(x) for x in r] == [(gone, 0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")]
    assert C.repair(C.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_very_long_text_is_repaired_whole(spark):
    text = "word " * 2_000_000 + "end."
    rows = [(1, 0, "user", text), (1, 1, "user", text), (1, 2, "assistant", "Fine.")]
    got = C.repair(C.plain(spark.createDataFrame(rows, SCHEMA))).collect()[0]
    assert (got.duplicate, got.audit, got.cost) == (1, "KDK", 2)
