"""Every oracle key against DuckDB on the sf0.001 tables (the driver gate, smaller)."""
import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E
from conftest import SMOKE
from venturelens.sources.bindings import TABLES

FAST = ["scan_catalog", "clean_currency", "range_midpoint", "list_count", "verdict_label", "validate_requests",
        "frequency_encode", "top_k_similar", "knn_join", "embed_text", "industry_mode", "top10_categories",
        "describe_all", "histogram", "kde_curve", "box_stats", "correlation_matrix", "split_train_validation",
        "score_pairs", "extract_json_blob", "evaluate_ideas", "copycat_report"]


def norm(df):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False):
        row = []
        for v in rec:
            if v is None or v is pd.NA or (isinstance(v, (float, np.floating)) and v != v):
                row.append("<null>")
            elif isinstance(v, (bool, np.bool_)):
                row.append(str(bool(v)))
            elif isinstance(v, (float, np.floating)):
                row.append(f"{round(float(v), 6):.6f}")
            else:
                row.append(str(v))
        out.append(tuple(row))
    return cols, sorted(out)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


def test_every_query_has_a_callable_and_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 70


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, con, name):
    got = norm(E.queries()[name](spark, SMOKE).toPandas())
    want = norm(con.execute(E.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "predicted_industry" in df.columns
