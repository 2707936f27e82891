"""What a task holds, and what is shuffled, does not grow with the tables."""
import datetime
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from venturelens.operators import model, vectors
from venturelens.operators.fingerprints import fingerprint, fingerprinted, group_counts
from venturelens.operators.profile import describe_texts
from venturelens.sources import bindings


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """A small star schema with repeated and null keys."""
    folder = str(tmp_path_factory.mktemp("star"))
    keys = [1, 2, 2, 3, 4, 5, None, 7, 90]
    day = datetime.date(2001, 2, 3)
    tables = {
        "documents": ([(k, f"text {i}", None if i == 3 else "src") for i, k in enumerate(keys)], "doc_id long, text string, source string"),
        "orders": ([(k, k and k % 3, 1000.5 * i, "HIGH", day) for i, k in enumerate([*keys[:-1], 3])],
                   "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string, o_orderdate date"),
        "customer": ([(0, "zero", 1, "SEG"), (1, "one", 2, None), (2, "two", 1, "SEG"), (2, "two again", 1, "SEG"), (None, "none", 1, "SEG")],
                     "c_custkey long, c_name string, c_nationkey long, c_mktsegment string"),
        "nation": ([(1, "A"), (2, "B"), (None, "C")], "n_nationkey long, n_name string"),
        "part": ([(k, "type", 7) for k in keys], "p_partkey long, p_type string, p_size int"),
        "lineitem": ([(k, n % 3, 10.5 * n) for n, k in enumerate(keys * 4)], "l_orderkey long, l_linenumber int, l_extendedprice double"),
    }
    for name in bindings.TABLES:
        data, schema = tables.get(name, ([], "id long"))
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["catalog", "member_predictions"])
def test_binding_gives_the_rows_of_its_statement(spark, star, name):
    got = bindings.binding(spark, star, name)
    want = spark.sql(bindings.BINDINGS[name])
    assert got.columns == want.columns and rows_of(got) == rows_of(want) and got.count() > 0


def test_member_predictions_take_more_tasks_for_more_rows(spark, star, monkeypatch):
    monkeypatch.setattr(bindings, "TASK_ROWS", 3)
    got = bindings.binding(spark, star, "member_predictions")
    assert got.rdd.getNumPartitions() == -(-(36 + 9) // 3)      # lineitem and orders
    plan = got.groupBy("id").agg(F.avg("pred"))._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\([^,]*, (\d+)\), (\w+)", plan)) == {("15", "REPARTITION_BY_NUM")}


def test_catalog_texts_go_through_one_exchange(spark, star):
    """Texts are joined last, with rows that hold no text."""
    plan = bindings.binding(spark, star, "catalog")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    scans = [line for line in plan.splitlines() if "Relation" in line]
    assert len(joins) == 4 and "doc_id" in joins[0] and not any("doc_id" in j for j in joins[1:]) and "text" in scans[-1]


def test_equal_texts_are_counted_without_a_join(spark, monkeypatch):
    df = spark.createDataFrame([("long " * 50 + str(i % 4), i % 2) for i in range(40)], "s string, n int")

    def no_join(*args, **kw):
        raise AssertionError("texts joined")

    rows = fingerprinted(df, [], ["s", "n"], fingerprint)
    monkeypatch.setattr(DataFrame, "join", no_join)
    got = group_counts(rows, [], ["s", "n"])
    assert [r.n for r in got.collect()] == [10] * 4 and got.where("value IS NOT NULL").isEmpty()


def test_few_of_many_tied_texts_are_fetched(spark, monkeypatch):
    texts = [f"{i:03d} {'x' * 40}" for i in range(300)] + ["é"]
    df = spark.createDataFrame([(t,) for t in texts * 2], "s string")
    fetched, join = [], DataFrame.join

    def spied(self, other, *args, **kw):
        fetched.append(other.count())
        return join(self, other, *args, **kw)

    monkeypatch.setattr(DataFrame, "join", spied)
    got = {r.stat: r.num_value if r.text_value is None else r.text_value for r in describe_texts(df, ["s"]).collect()}
    assert got == {"count": 602.0, "unique": 301.0, "freq": 2.0, "top": texts[0]} and fetched == [1]


def test_training_tasks_follow_cores_not_partitions(spark, tmp_path, monkeypatch):
    """Every task of a forest shuffles the statistics of all nodes, however few rows it has."""
    seen, cores = [], spark.sparkContext.defaultParallelism
    fit = model.ForestEnsemble.fit

    def spied(self, df, *args):
        seen.append(df.rdd.getNumPartitions())
        return fit(self, df, *args)

    monkeypatch.setattr(model.ForestEnsemble, "fit", spied)
    catalog = spark.createDataFrame(
        [(i, f"word{i % 7} other", 2000.0 + i % 9, 1.0, float(i % 5), "city", "a,b", 10.0 + i) for i in range(400)],
        "id long, description string, starting_year double, founders_count double, employees_count double, city string, "
        "industries string, funding double").repartition(40)
    params = model.TrainParams(n_members=2, num_trees=2, max_depth=2)
    got = model.train_funding_model(catalog, str(tmp_path / "m"), params).first()
    assert got.n_train + got.n_validation == 400 and seen and max(seen) <= cores
    assert model.training_tasks(10, 4) == 4 and model.training_tasks(9 * model.TRAIN_TASK_ROWS, 4) == 9


def test_text_runs_are_bounded_and_whole(spark, monkeypatch):
    texts = ["x" * n for n in (5, 0, 900, 3, 3, 3, 2000, 1)] + [None, "word Word"] + ["y"] * 40
    monkeypatch.setattr(vectors, "RUN_BYTES", 1000)
    monkeypatch.setattr(vectors, "RUN_ROWS", 16)
    runs = list(vectors._text_runs(pa.array(texts)))
    assert [at for at, _ in runs] == [0, *(to for _, to in runs[:-1])] and runs[-1][1] == len(texts)
    assert all(to - at <= 16 and (to - at == 1 or sum(len(t or "") for t in texts[at:to]) <= 1000) for at, to in runs)
    assert list(vectors._text_runs(pa.array([], pa.string()))) == []


def test_long_texts_give_the_vectors_of_the_sql_form(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 5000}" for j in range(9000 * (i % 3)))) for i in range(90)] + [(90, None)]      # several runs
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    a = {r.id: r.embedding for r in vectors.embed_text(df, "text", "id").collect()}
    b = {r.id: r.embedding for r in vectors.embed_text(df, "text", "id", method="sql").collect()}
    assert a == b and len(a) == 91


def test_grid_blocks_grow_with_the_tables_up_to_a_bound():
    assert vectors.grid_shape(1000, 1000, 128, 256, 8) == (8, 8)            # as asked
    assert vectors.grid_shape(0, 0, 128, 256, 8) == (1, 8)
    for n in (10_000, 60_000, 1_000_000):
        ib, cb = vectors.grid_shape(n, n, 128, 256, 12)
        full = -(-n // vectors.MOST_IDEA_ROWS) * -(-n // vectors.MOST_CATALOG_ROWS)
        assert n / ib <= vectors.MOST_IDEA_ROWS and n / cb <= vectors.MOST_CATALOG_ROWS
        assert ib * cb <= max(vectors.CELLS_PER_CORE * 12, full, 12 * ib)


def test_grid_of_grown_blocks_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELLS_PER_CORE", 1)
    rows = [(i, [float((i * j) % 13) for j in range(1, 6)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    ideas = df.withColumnRenamed("id", "idea_id")
    grid = vectors.top_k_similar(ideas, df, 4, True, broadcast_budget_bytes=0, idea_block_rows=8, catalog_block_rows=8)
    assert rows_of(grid) == rows_of(vectors.top_k_similar(ideas, df, 4, True))
