"""exact_quantiles equals numpy's linear interpolation, with a hot group and ties."""
import numpy as np
import pytest

from venturelens.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("parts", [1, 7])
def test_grouped_quantiles_with_hot_group(spark, parts):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{i % 11}"
        v = float(rng.integers(0, 40)) if g == "hot" else float(rng.normal())
        rows.append((g, v))
    rows.append((None, 1.0))
    rows.append(("g1", None))
    df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r.g: (r.n, [r[f"q_{i}"] for i in range(len(probs))])
           for r in exact_quantiles(df, "v", probs, ["g"], partitions=parts * 3).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vals in groups.items():
        n, qs = got[g]
        assert n == len(vals)
        assert np.allclose(qs, np.quantile(np.array(vals), probs), rtol=0, atol=1e-9)


def test_global_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 3, 3, 9, 7]], "v double")
    r = exact_quantiles(df, "v", [0.25, 0.5, 0.9]).first()
    assert r.n == 6 and [r.q_0, r.q_1, r.q_2] == list(np.quantile([5, 1, 3, 3, 9, 7], [0.25, 0.5, 0.9]))


def test_one_value_on_half_of_the_rows_is_one_row(spark):
    """The hot value is folded before the range partitioning: no task reads its rows."""
    n = 4000
    df = spark.range(n).selectExpr("'g' AS g", "CASE WHEN id % 2 = 0 THEN 7.0 ELSE id * 1.0 END AS v")
    r = exact_quantiles(df, "v", [0.1, 0.5, 0.9], ["g"], partitions=16).first()
    import numpy as np
    x = np.where(np.arange(n) % 2 == 0, 7.0, np.arange(n))
    assert [r.q_0, r.q_1, r.q_2] == list(np.quantile(x, [0.1, 0.5, 0.9])) and r.n == n
