"""Pair ("copycat") analysis over a table of (idea, match) pairs: L1-L5.

The scorer is a parameter.  The built-in default is word-set Jaccard computed
with array functions inside the JVM; a plug-in scorer (for example a language
model client) runs per Arrow batch with ``mapInPandas`` and must return JSON
text, which then goes through the same parser and defaults as any other
verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venturelens.functions.text import jaccard_percent, shared_word_count, word_set
from venturelens.schema import (
    MISSING_REASONING, NO_ANALYSIS_IS_COPY, NO_ANALYSIS_REASONING, NO_ANALYSIS_SCORE,
    VERDICT_SCHEMA,
)

DEFAULT_COPY_THRESHOLD = 80.0


def build_prompts(pairs: DataFrame, idea_col: str = "user_idea", match_col: str = "description",
                  company_col: str = "company") -> DataFrame:
    """L1: one prompt text per pair (our own wording)."""
    prompt = F.concat(
        F.lit("Compare two startup descriptions and say whether the first copies the second.\n"),
        F.lit("Idea: \""), F.coalesce(F.col(idea_col), F.lit("")), F.lit("\"\n"),
        F.lit("Existing company "), F.coalesce(F.col(company_col), F.lit("")), F.lit(": \""),
        F.coalesce(F.col(match_col), F.lit("")), F.lit("\"\n"),
        F.lit("Answer with JSON: {\"similarity_score\": 0-100, \"is_copy\": true|false, "
              "\"reasoning\": \"one or two sentences\"}"))
    return pairs.withColumn("prompt", prompt)


def default_verdict_json(idea: Column, match: Column, threshold: float) -> Column:
    """Built-in scorer: Jaccard percent of the word sets, as verdict JSON text."""
    score = jaccard_percent(idea, match)
    shared = shared_word_count(idea, match)
    union = F.size(F.array_union(word_set(idea), word_set(match)))
    reasoning = F.concat(F.lit("The texts share "), shared.cast("string"), F.lit(" of "),
                         union.cast("string"), F.lit(" distinct words."))
    return F.to_json(F.struct(score.alias("similarity_score"),
                              (score >= F.lit(threshold)).alias("is_copy"),
                              reasoning.alias("reasoning")))


def isolated(scorer: Callable[[pd.Series], list], prompts: pd.Series, retries: int) -> list[tuple[str | None, str | None]]:
    """(answer, reason) per prompt.  A batch that fails is halved until the failing prompt stands alone.

    A lone prompt is asked ``retries`` times more; then it has no answer, and the last failure is its reason.
    A batch fails if the scorer raises or does not return one text or None per prompt.
    """
    def ask(part: pd.Series) -> list[tuple[str | None, str | None]]:
        answers = list(scorer(part))
        if len(answers) != len(part):
            raise ValueError(f"{len(answers)} answers for {len(part)} prompts")
        if bad := [a for a in answers if not (a is None or isinstance(a, str))]:
            raise TypeError(f"answer of type {type(bad[0]).__name__}")
        return [(a, None) for a in answers]

    out: list[tuple[str | None, str | None]] = []
    waiting = [prompts] if len(prompts) else []
    while waiting:
        part = waiting.pop()
        for attempt in range(1 if len(part) > 1 else 1 + retries):
            try:
                out += ask(part)
                break
            except Exception as exc:  # noqa: BLE001 - the reason is kept per row
                reason = f"{type(exc).__name__}: {exc}"
        else:
            if len(part) == 1:
                out.append((None, reason))
            else:
                half = len(part) // 2
                waiting += [part.iloc[half:], part.iloc[:half]]
    return out


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.Series], list] | None = None,
                threshold: float = DEFAULT_COPY_THRESHOLD, idea_col: str = "user_idea",
                match_col: str = "description", company_col: str = "company", retries: int = 1) -> DataFrame:
    """L2: add ``raw`` verdict text per pair, then parse it (L3) and default it (L4).

    ``scorer(prompts) -> list[str | None]`` is called once per Arrow batch; where that fails, the failing
    prompts are found by halving, retried ``retries`` times and defaulted, with the reason in ``scorer_error``.
    """
    if scorer is None:
        raw = (pairs.withColumn("raw", default_verdict_json(F.col(idea_col), F.col(match_col), threshold))
               .withColumn("scorer_error", F.lit(None).cast("string")))
    else:
        prompted = build_prompts(pairs, idea_col, match_col, company_col)
        schema = T.StructType(prompted.schema.fields + [T.StructField("raw", T.StringType()),
                                                           T.StructField("scorer_error", T.StringType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = isolated(scorer, b["prompt"], retries)
                b = b.copy()
                b["raw"] = pd.Series([a for a, _ in out], index=b.index, dtype=object)
                b["scorer_error"] = pd.Series([r for _, r in out], index=b.index, dtype=object)
                yield b

        raw = prompted.mapInPandas(run, schema).drop("prompt")
    return default_verdict(parse_verdicts(raw, "raw"))


def extract_json_blob(col: Column | str) -> Column:
    """The first flat ``{...}`` inside noisy text, else null; braces in quoted strings do not count."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.regexp_extract(c, r'\{(?:[^{}"]++|"(?:[^"\\]++|\\.)*+")*+\}', 0), F.lit(""))


def parse_verdicts(df: DataFrame, raw_col: str = "raw", extract: bool = False) -> DataFrame:
    """L3: JSON text -> typed columns.

    Fields are read as strings, so a quoted number still parses.  A record
    exists only when the whole text is one non-empty JSON object (an empty
    object, a second object or words after it count as no answer); otherwise every field is null and ``has_record`` is false.
    """
    text = extract_json_blob(raw_col) if extract else F.col(raw_col)
    keys = F.json_object_keys(text)
    parsed = F.from_json(text, VERDICT_SCHEMA)
    # the text as the only element of an array: anything after the object breaks that
    alone = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>")
    has = F.coalesce((F.size(alone) == 1) & (F.size(keys) > 0), F.lit(False))
    return df.select(
        "*",
        has.alias("has_record"),
        F.when(has, parsed["similarity_score"].try_cast("double")).alias("similarity_score"),
        F.when(has, parsed["is_copy"].try_cast("boolean")).alias("is_copy"),
        F.when(has, parsed["reasoning"]).alias("reasoning"),
    )


def default_verdict(parsed: DataFrame) -> DataFrame:
    """L4: no record -> the no-analysis defaults; a missing key -> its own default."""
    has = F.col("has_record")
    return parsed.select(
        *[c for c in parsed.columns if c not in ("similarity_score", "is_copy", "reasoning")],
        F.when(has, F.coalesce("similarity_score", F.lit(NO_ANALYSIS_SCORE)))
        .otherwise(F.lit(NO_ANALYSIS_SCORE)).alias("score"),
        F.when(has, F.coalesce("is_copy", F.lit(False)))
        .otherwise(F.lit(NO_ANALYSIS_IS_COPY)).alias("is_copy"),
        F.when(has, F.coalesce("reasoning", F.lit(MISSING_REASONING)))
        .otherwise(F.lit(NO_ANALYSIS_REASONING)).alias("reasoning"),
    )
