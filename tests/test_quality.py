"""Failing scorers, calibrated intervals, binned density, broken and repeated requests."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMOKE
from venturelens.operators.guards import split_requests
from venturelens.operators.model import calibration_table
from venturelens.operators.pairs import isolated, score_pairs
from venturelens.operators.profile import binned_kde_curve, kde_curve
from venturelens.sources.catalog import scan_checked_requests


def test_one_bad_prompt_defaults_one_row(spark):
    def scorer(prompts):
        if any("poison" in p for p in prompts):
            raise ValueError("refused")
        return ['{"similarity_score": 50, "is_copy": false, "reasoning": "ok"}' for _ in prompts]

    rows = [(i, "poison" if i == 13 else f"idea {i}", "match", "Co") for i in range(40)]
    got = score_pairs(spark.createDataFrame(rows, "idea_id long, user_idea string, description string, company string"), scorer=scorer).collect()
    assert len(got) == 40 and {(r.score, r.scorer_error) for r in got if r.idea_id != 13} == {(50.0, None)}
    bad = next(r for r in got if r.idea_id == 13)
    assert (bad.score, bad.is_copy, bad.reasoning, bad.scorer_error) == (0.0, False, "Could not get AI analysis.", "ValueError: refused")


def test_isolation_halves_retries_and_keeps_order():
    calls, flaky = [], {"b": 1}

    def scorer(prompts):
        calls.append(len(prompts))
        for p in prompts:
            if p == "x":
                raise RuntimeError("always")
            if len(prompts) == 1 and flaky.get(p, 0) > 0:
                flaky[p] -= 1
                raise RuntimeError("once")
        return [p.upper() for p in prompts]

    got = isolated(scorer, pd.Series(list("abcxdefg")), retries=1)
    assert got == [("A", None), ("B", None), ("C", None), (None, "RuntimeError: always"), ("D", None), ("E", None), ("F", None), ("G", None)]
    assert len(calls) <= 2 * 3 + 2 + 1
    assert isolated(lambda p: [1] * len(p), pd.Series(["a"]), 0) == [(None, "TypeError: answer of type int")]
    assert isolated(lambda p: [], pd.Series(["a"]), 0) == [(None, "ValueError: 0 answers for 1 prompts")]
    assert isolated(scorer, pd.Series([], dtype=object), 1) == []


def test_calibrated_intervals_cover_held_out_rows(spark):
    rng = np.random.default_rng(1)
    std = rng.uniform(0.5, 2.0, 8000)
    mean = rng.normal(size=8000)
    y = mean + 3.0 * std * rng.standard_t(5, 8000)             # far wider than the stated deviations
    df = spark.createDataFrame(pd.DataFrame({"id": range(8000), "y": y, "mean_pred": mean, "std_pred": std}))
    table = {r.level: r for r in calibration_table(df.where("id < 4000")).collect()}
    held = df.where("id >= 4000")
    for level, r in table.items():
        assert r.n == 4000 and r.coverage < level - 0.1 and r.z_calibrated > r.z
        covered = held.agg(F.avg((F.abs(F.col("y") - F.col("mean_pred")) <= F.lit(r.z_calibrated) * F.col("std_pred")).cast("double"))).first()[0]
        assert abs(covered - level) < 0.02
    assert calibration_table(df.limit(0)).collect() == []
    one = calibration_table(spark.createDataFrame([(1.0, 0.0, 0.0)], "y double, mean_pred double, std_pred double"), levels=(0.5,)).first()
    assert one.z_calibrated == pytest.approx(1e9)


@pytest.mark.parametrize("error", [1e-3, 1e-6])
def test_binned_density_is_within_its_bound(spark, error):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(40, 0.1, 1500), np.full(1500, 7.0), [200.0]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    exact = kde_curve(df, "v").orderBy("point").toPandas()
    fast = binned_kde_curve(df, "v", error=error).orderBy("point").toPandas()
    h = x.std(ddof=1) * len(x) ** -0.2
    assert (exact["x"] == fast["x"]).all() and list(fast.columns) == list(exact.columns)
    assert np.abs(exact["density"] - fast["density"]).max() <= 2 * error / (h * math.sqrt(2 * math.pi)) + 1e-9
    assert binned_kde_curve(df.limit(0), "v").count() == 0


def test_broken_lines_are_rejected_once_with_their_text(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.json").write_text('{"idea_id": 1, "user_idea": "x", "user_city": "y", "founding_year": 2020}\n{"idea_id": 2, broken\nnot json\n'
                                 '{"idea_id": 3, "user_idea": "", "user_city": "y", "founding_year": 2020}\n')
    valid, rejected = split_requests(scan_checked_requests(spark, str(path)))
    assert [r.idea_id for r in valid.collect()] == [1] and "_corrupt_record" not in valid.columns
    got = sorted((r.reason, r._corrupt_record) for r in rejected.collect())
    assert got == [("malformed record", "not json"), ("malformed record", '{"idea_id": 2, broken'), ("missing idea", None)]


def test_stream_takes_every_request_once_and_keeps_those_without_id(spark, tmp_path):
    from venturelens.plans.queries import cleaned_catalog
    from venturelens.streaming.requests import evaluate_stream

    catalog = cleaned_catalog(spark, SMOKE)
    ins, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    (tmp_path / "in").mkdir()
    line = '{"idea_id": %d, "user_idea": "food delivery", "user_city": "Pune", "founding_year": 2020}\n'

    def send(name, text):
        (tmp_path / "in" / name).write_text(text)
        evaluate_stream(spark, ins, out, ckpt, catalog).awaitTermination()

    none = '{"user_idea": "%s", "user_city": "Pune", "founding_year": 2020}\n'
    send("a.json", line % 1 + line % 2 + line % 1 + "broken\n" + none % "one" + none % "two")
    send("b.json", line % 2 + line % 3 + "broken\n" + none % "one")
    got = sorted(str(r.idea_id) for r in spark.read.parquet(f"{out}/evaluated").collect())
    assert got == ["1", "2", "3", "None", "None"]
    assert [r._corrupt_record for r in spark.read.parquet(f"{out}/rejected").collect()] == ["broken"]


@pytest.mark.parametrize("name", ["binned_kde_curve", "score_pairs_isolated", "interval_calibration", "rejected_requests", "evaluate_stream_once"])
def test_quality_queries_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as E
    from test_oracle import norm
    from venturelens.sources.bindings import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    assert norm(E.queries()[name](spark, SMOKE).toPandas()) == norm(con.execute(E.oracle_sql()[name]).df())
