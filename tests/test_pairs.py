"""Verdict parsing, defaults and the built-in scorer."""
from venturelens.operators.pairs import default_verdict, parse_verdicts, score_pairs


def test_parse_and_default(spark):
    raws = [(0, None), (1, "not json"), (2, "{}"),
            (3, '{"similarity_score": 78, "is_copy": true, "reasoning": "same market"}'),
            (4, '{"similarity_score": "78"}'), (5, 'Sure: {"similarity_score": 5, "is_copy": false} done'),
            (6, "[1, 2]")]
    df = spark.createDataFrame(raws, "id long, raw string")
    got = {r.id: (r.score, r.is_copy, r.reasoning) for r in default_verdict(parse_verdicts(df)).collect()}
    none = (0.0, False, "Could not get AI analysis.")
    assert got[0] == none and got[1] == none and got[2] == none and got[5] == none and got[6] == none
    assert got[3] == (78.0, True, "same market")
    assert got[4] == (78.0, False, "No reasoning provided.")
    blob = {r.id: r.similarity_score for r in parse_verdicts(df, extract=True).collect()}
    assert blob[5] == 5.0 and blob[3] == 78.0


def test_default_scorer(spark):
    df = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "a b", "c d"), (3, "", "")],
                               "idea_id long, user_idea string, description string")
    got = {r.idea_id: (r.score, r.is_copy) for r in score_pairs(df.withColumn("company", df.idea_id.cast("string"))).collect()}
    assert got == {1: (100.0, True), 2: (0.0, False), 3: (0.0, False)}


def test_plugin_scorer(spark):
    df = spark.createDataFrame([(1, "x", "y", "Co")], "idea_id long, user_idea string, description string, company string")
    scorer = lambda prompts: ['{"similarity_score": 91, "is_copy": true}' for _ in prompts]
    r = score_pairs(df, scorer=scorer).first()
    assert (r.score, r.is_copy, r.reasoning) == (91.0, True, "No reasoning provided.")
