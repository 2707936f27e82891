"""S1 CSV scan (quoted multi-line text, null tokens, missing file), S3, plug-in encoder, A8."""
import os
import tempfile

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from conftest import SMOKE
from venturelens.operators import model as M
from venturelens.operators.vectors import embed_text
from venturelens.plans.queries import scanned_catalog
from venturelens.sources.bindings import binding
from venturelens.sources.catalog import CatalogNotFound, assign_row_id, scan_catalog


def test_csv_scan_round_trip(spark):
    raw = binding(spark, SMOKE, "catalog")
    path = os.path.join(tempfile.mkdtemp(prefix="vl-csv-"), "catalog")
    raw.write.option("header", True).option("escape", '"').csv(path)
    got = scan_catalog(spark, path)
    want = scanned_catalog(spark, SMOKE)
    key = lambda r: r.id
    a = sorted((tuple(r) for r in got.select(*want.columns).collect()), key=lambda t: t[0])
    b = sorted((tuple(r) for r in want.collect()), key=lambda t: t[0])
    assert a == b


def test_missing_catalog_is_reported(spark):
    with pytest.raises(CatalogNotFound):
        scan_catalog(spark, "/nonexistent/venturelens/catalog.csv")


def test_assign_row_id_dense_and_ordered(spark):
    df = spark.createDataFrame([(5, "b"), (3, "a"), (9, "a")], "id long, company string").repartition(3)
    got = sorted((r.row_id, r.company, r.id) for r in assign_row_id(df, ["company", "id"]).collect())
    assert got == [(0, "a", 3), (1, "a", 9), (2, "b", 5)]


def test_plugin_encoder(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")

    def encode(texts):
        return [[float(len(t)), 1.0] for t in texts]

    got = {r.doc_id: list(r.embedding) for r in embed_text(df, "text", "doc_id", encoder=encode).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_rmse_agrees_with_evaluator(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(a + b)) for a, b in zip(rng.normal(size=200), rng.normal(size=200) * 0.3)]
    df = spark.createDataFrame(rows, "y double, pred double")
    ours = M.rmse(df, "y", "pred").first()[0]
    ev = RegressionEvaluator(labelCol="y", predictionCol="pred", metricName="rmse").evaluate(df)
    assert abs(ours - ev) < 1e-12


def test_table_scan_built_once(spark):
    from venturelens.sources.bindings import table

    a = table(spark, SMOKE, "documents")
    assert table(spark, SMOKE, "documents") is a  # one scan (one schema job) per session
    assert a.count() == spark.read.parquet(f"{SMOKE}/documents.parquet").count()
    # views are registered once per folder and follow a change of folder
    binding(spark, SMOKE, "catalog").count()
    other = "/root/testdata/sf0.01"
    assert binding(spark, other, "catalog").count() == spark.read.parquet(f"{other}/documents.parquet").count()
    assert binding(spark, SMOKE, "catalog").count() == a.count()


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_assign_row_id_dense_with_hot_key(spark, parts):
    rows = [(i, "hot" if i % 3 == 0 else f"c{i % 37:02d}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, company string").repartition(parts)
    got = sorted((r.row_id, r.company, r.id) for r in assign_row_id(df, ["company", "id"]).collect())
    want = [(n, c, i) for n, (c, i) in enumerate(sorted((c, i) for i, c in rows))]
    assert got == want


def test_csv_catalog_by_header_name(spark):
    folder = tempfile.mkdtemp(prefix="vl-csv-")
    path = os.path.join(folder, "c.csv")
    with open(path, "w") as f:
        f.write('City,Company,Funding Amount in $,Description,Industries,Funding Round,Founders Count\n'
                'Oslo,Acme,"$1,000","makes ""things"", fast","A,B",Seed,2\nBern,None,5M,,C,Seed,\n')
    rows = scan_catalog(spark, path).orderBy("id").collect()
    assert [(r.id, r.company, r.city, r.funding_raw, r.description_raw, r.founders_count_raw, r.starting_year_raw) for r in rows] == [
        (0, "Acme", "Oslo", "$1,000", 'makes "things", fast', "2", None), (1, None, "Bern", "5M", None, None, None)]
    for bad in ("Company,City\na,b\n", "Company,Description,Industries,City,Funding Amount in $,Funding Round,Colour\n1,2,3,4,5,6,7\n"):
        with open(path, "w") as f:
            f.write(bad)
        with pytest.raises(ValueError):
            scan_catalog(spark, path)
