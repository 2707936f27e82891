"""DuckDB statements that define the expected result of each registered query.

These are the independent check: brute-force SQL over the same bindings
(``venturelens.sources.bindings``).  They are never run by the library.
"""

from __future__ import annotations

from venturelens.schema import (
    ENCODER_DIM, INTEGER_PATTERN, NULL_TOKENS, NUMBER_PATTERN, SERVING_DESCRIPTION_DEFAULT,
    SERVING_INDUSTRY_DEFAULT, TOKEN_SPLIT_PATTERN, UNKNOWN_INDUSTRY,
)
from venturelens.sources.bindings import BINDINGS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def nn(col: str) -> str:
    toks = ", ".join(q(t) for t in NULL_TOKENS)
    return f"(CASE WHEN {col} IN ({toks}) THEN NULL ELSE {col} END)"


def gdouble(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, {q(NUMBER_PATTERN)}) THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def gint(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, {q(INTEGER_PATTERN)}) THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def coerce_number(x: str) -> str:
    return f"coalesce({gdouble(f'CAST({x} AS VARCHAR)')}, 0.0)"


def clean_currency(x: str) -> str:
    return coerce_number(f"regexp_replace({x}, '[$,]', '', 'g')")


def first_integer(x: str) -> str:
    return f"coalesce(TRY_CAST(regexp_extract({x}, '([0-9]+)', 1) AS DOUBLE), 0.0)"


def range_midpoint(x: str) -> str:
    return (f"(CASE WHEN instr({x}, '-') > 0 THEN ({gint(f'split_part({x}, {q(chr(45))}, 1)')} + "
            f"{gint(f'split_part({x}, {q(chr(45))}, 2)')}) / 2.0 ELSE {gdouble(x)} END)")


def list_count(x: str) -> str:
    return f"CAST(len(string_split(coalesce({x}, 'nan'), ',')) AS BIGINT)"


def format_currency(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN 'N/A' ELSE '$' || format('{{:,.0f}}', {x}) END)"


RAW_COLS = ("company", "description_raw", "industries_raw", "city", "funding_raw",
            "funding_round", "starting_year_raw", "employees_raw", "founders_raw")


def scanned_catalog_cte() -> str:
    cols = ", ".join(f"{nn(c)} AS {c}" for c in RAW_COLS)
    return f"scanned AS (SELECT id, {cols} FROM catalog)"


def clean_catalog_cte(description_default: str | None = SERVING_DESCRIPTION_DEFAULT,
                      industries_default: str | None = SERVING_INDUSTRY_DEFAULT,
                      name: str = "clean") -> str:
    d = "description_raw" if description_default is None else f"coalesce(description_raw, {q(description_default)})"
    i = "industries_raw" if industries_default is None else f"coalesce(industries_raw, {q(industries_default)})"
    return f"""{name} AS (SELECT id, company, {d} AS description, {i} AS industries, city,
  {clean_currency('funding_raw')} AS funding, funding_round,
  {coerce_number('starting_year_raw')} AS starting_year, 0.0 AS founders_count,
  {first_integer('employees_raw')} AS employees_count,
  {range_midpoint("nullif(employees_raw, 'None')")} AS employees_mid,
  {list_count('founders_raw')} AS founders
FROM scanned)"""


def catalog_prefix(*extra: str, description_default=SERVING_DESCRIPTION_DEFAULT,
                   industries_default=SERVING_INDUSTRY_DEFAULT) -> str:
    """WITH catalog, scanned, clean [, extra bindings...]"""
    parts = [f"catalog AS ({BINDINGS['catalog'].strip()})", scanned_catalog_cte(),
             clean_catalog_cte(description_default, industries_default)]
    parts += [f"{n} AS ({BINDINGS[n].strip()})" for n in extra]
    return "WITH " + ",\n".join(parts)


def encoder_ctes(name: str, src: str, id_col: str, text_col: str, dim: int = ENCODER_DIM) -> str:
    """Dense (vid, b, v) rows of the default text encoder for ``src``."""
    return f"""{name}_tok AS (
  SELECT {id_col} AS vid,
         unnest(list_filter(regexp_split_to_array(coalesce({text_col}, ''), {q(TOKEN_SPLIT_PATTERN)}),
                            lambda t: t <> '')) AS t
  FROM {src}),
{name}_cnt AS (
  SELECT vid, CAST(('0x' || substr(md5(lower(t)), 1, 8)) AS BIGINT) % {dim} AS b, count(*) AS n
  FROM {name}_tok GROUP BY vid, b),
{name}_norm AS (SELECT vid, sqrt(sum(n * n)) AS norm FROM {name}_cnt GROUP BY vid),
{name}_sparse AS (
  SELECT c.vid, c.b, CAST(CAST(c.n / m.norm AS FLOAT) AS DOUBLE) AS v
  FROM {name}_cnt c JOIN {name}_norm m ON c.vid = m.vid),
{name} AS (
  SELECT s.{id_col} AS vid, r.range AS b, coalesce(x.v, 0.0) AS v
  FROM {src} s CROSS JOIN range({dim}) r
  LEFT JOIN {name}_sparse x ON x.vid = s.{id_col} AND x.b = r.range)"""


def list_vector_cte(name: str, src: str, id_col: str, vec_col: str) -> str:
    return f"""{name} AS (
  SELECT {id_col} AS vid, generate_subscripts({vec_col}, 1) - 1 AS b, CAST(unnest({vec_col}) AS DOUBLE) AS v
  FROM {src})"""


def knn_ctes(qname: str, cname: str, k: int, exclude_self: bool = False, out: str = "nb") -> str:
    cond = " AND a.vid <> c.vid" if exclude_self else ""
    return f"""{out}_all AS (
  SELECT a.vid AS idea_id, c.vid AS id, round(sum((a.v - c.v) * (a.v - c.v)), 6) AS dist2
  FROM {qname} a JOIN {cname} c ON a.b = c.b{cond}
  GROUP BY a.vid, c.vid),
{out} AS (
  SELECT idea_id, CAST(rnk AS INTEGER) AS rank, id, dist2 FROM (
    SELECT *, row_number() OVER (PARTITION BY idea_id ORDER BY dist2, id) AS rnk FROM {out}_all) t
  WHERE rnk <= {k})"""


def valid_ideas_cte(name: str = "valid") -> str:
    return f"""{name} AS (SELECT * FROM ideas
  WHERE user_idea IS NOT NULL AND user_idea <> '' AND user_city IS NOT NULL AND user_city <> ''
    AND founding_year IS NOT NULL AND founding_year <> 0)"""


def neighbour_stats_ctes(k: int, rows: str = "rows", out: str = "stats") -> str:
    return f"""{out}_mode AS (
  SELECT idea_id, industries AS predicted_industry FROM (
    SELECT idea_id, industries, row_number() OVER (PARTITION BY idea_id ORDER BY count(*) DESC, industries) AS r
    FROM {rows} GROUP BY idea_id, industries) t WHERE r = 1),
{out} AS (
  SELECT g.idea_id, coalesce(m.predicted_industry, {q(UNKNOWN_INDUSTRY)}) AS predicted_industry,
         g.top_match_id, g.top_match_name, g.top_match_dist2, g.n_neighbours, g.funded_count,
         round(g.avg_funding, 4) AS avg_funding,
         CAST(g.funded_count AS VARCHAR) || ' out of {k}' AS rate,
         {format_currency('g.avg_funding')} AS avg_funding_str
  FROM (SELECT idea_id,
               max(CASE WHEN rank = 1 THEN id END) AS top_match_id,
               max(CASE WHEN rank = 1 THEN company END) AS top_match_name,
               max(CASE WHEN rank = 1 THEN dist2 END) AS top_match_dist2,
               CAST(count(*) AS BIGINT) AS n_neighbours,
               CAST(count(*) FILTER (WHERE funding > 0) AS BIGINT) AS funded_count,
               avg(CASE WHEN funding > 0 THEN funding END) AS avg_funding
        FROM {rows} GROUP BY idea_id) g
  LEFT JOIN {out}_mode m ON m.idea_id = g.idea_id)"""


def evaluate_ideas_ctes(k: int) -> str:
    """Everything Q1 needs after ``catalog_prefix('ideas')``: valid, vectors, nb, rows, stats, q1."""
    return ",\n".join([
        valid_ideas_cte(),
        encoder_ctes("cvec", "clean", "id", "description"),
        encoder_ctes("ivec", "valid", "idea_id", "user_idea"),
        knn_ctes("ivec", "cvec", k),
        "rows AS (SELECT nb.idea_id, nb.rank, nb.id, nb.dist2, c.company, c.industries, c.funding "
        "FROM nb JOIN clean c ON c.id = nb.id)",
        neighbour_stats_ctes(k),
        f"""q1 AS (
  SELECT v.idea_id, coalesce(s.predicted_industry, {q(UNKNOWN_INDUSTRY)}) AS predicted_industry,
         v.user_city, v.founding_year, s.top_match_id, s.top_match_name, s.top_match_dist2,
         coalesce(s.n_neighbours, CAST(0 AS BIGINT)) AS n_neighbours,
         coalesce(s.funded_count, CAST(0 AS BIGINT)) AS funded_count, s.avg_funding,
         coalesce(s.rate, '0 out of {k}') AS rate, coalesce(s.avg_funding_str, 'N/A') AS avg_funding_str
  FROM valid v LEFT JOIN stats s ON s.idea_id = v.idea_id)""",
    ])
