"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id.  What a source contributes
beyond whole repeats is the documents whose hash lies below a threshold.  The
threshold is found without sorting documents: words are summed by (source, top
ten hash bits), the bucket in which the budget ends is found from the running
sums, and only that bucket is divided again by the next ten bits, six times,
until single hash values are left.  The thresholds nest: a larger budget of the
same source keeps every document that a smaller one keeps.

Rules: a null text has size 0; a null source is a source of its own, after all
others; documents that share an id (repeated rows) and a null id share a hash
and are taken or left together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venturelens.llm.textkit import free_name
from venturelens.session import written

LEVEL_BITS, LEVELS = 10, 6
WORD = r"[^\x20\x09-\x0D]+"


def doc_hash(doc_id) -> Column:
    """60 bits of the md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the 60-bit hash of every document."""
    return docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        doc_hash(F.col("doc_id")).alias("h"))


def targets(per_source: DataFrame, max_repeat: float = 3.0) -> DataFrame:
    """Adds ``weight`` and ``target`` to (source, source_size); one row per source.

    Weights 1, 2, 3 repeat over the sources in code point order, null last.  The
    shares of all words are capped at ``max_repeat`` times the source; what the
    caps leave goes to the others by weight.  That is one water level: target =
    min(cap, level * weight), and sources reach their caps in order of cap /
    weight, so running sums in that order give the level.  The frame has a row
    per source, not per document.
    """
    w = (per_source
         .withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
         .withColumn("weight", ((F.col("_i") - 1) % 3 + 1).cast("double"))
         .withColumn("_cap", F.col("source_size") * F.lit(max_repeat))
         .withColumn("_fill", F.col("_cap") / F.col("weight")))
    order = Window.orderBy("_fill", "_i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (w.withColumn("_total", F.sum("source_size").over(every))
         .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
         .withColumn("_open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
         # the level is right at the first source that it leaves below its cap
         .withColumn("level", F.min(F.when(F.col("_fill") >= F.col("_level"), F.struct("_fill", "_i", "_level"))).over(every)["_level"]))
    return w.select("source", "source_size", "weight",
                    F.least("_cap", F.coalesce("level", F.col("_fill")) * F.col("weight")).alias("target"))


def plan(docs: DataFrame, max_repeat: float = 3.0) -> DataFrame:
    """What the mix takes of each source: source_size, target, whole (repeats of all) and threshold.

    Documents of the source whose hash is below the threshold are taken once more.
    """
    return _plan(written(sizes(docs), "mix-sizes"), max_repeat)


def _plan(d: DataFrame, max_repeat: float) -> DataFrame:
    per = written(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeat)
                  .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                              .otherwise(F.lit(0)).cast("long"))
                  .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    # prefix: the hash bits fixed so far; left: the budget that remains inside that prefix
    state = per.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        inside = d.join(state,
                        F.col("source").eqNullSafe(F.col("s"))
                        & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
        hist = (inside.groupBy("s", "left", F.shiftright("h", shift).alias("bucket"))
                .agg(F.sum("size").alias("words")))
        upto = Window.partitionBy("s").orderBy("bucket")
        run = hist.withColumn("run", F.sum("words").over(upto))
        # the first bucket that passes the budget; where none does, beyond the last one
        edge = run.groupBy("s").agg(
            F.min(F.when(F.col("run") > F.col("left"), F.struct("bucket", F.col("run") - F.col("words"), "words"))).alias("e"),
            F.max("bucket").alias("last"), F.first("left").alias("left"))
        state = written(edge.select(
            "s", F.coalesce("e.bucket", F.col("last") + 1).alias("prefix"),
            F.when(F.col("e").isNotNull(), F.col("left") - F.col("e.col2")).otherwise(F.lit(0.0)).alias("left"),
            F.coalesce("e.words", F.lit(0)).alias("edge")), f"mix-level{level}").select(
                "s", "prefix", "left", *(["edge"] if level == LEVELS else []))
    # the hash value on the threshold comes in when that is the nearer side
    cut = state.select("s", (F.col("prefix") + F.when(F.col("edge") <= 2 * F.col("left"), F.when(F.col("edge") > 0, 1).otherwise(0))
                             .otherwise(0)).alias("threshold"))
    return written(per.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold")), "mix-plan")


def _copies(h, max_repeat: float):
    return F.least(F.col("whole") + F.when(h < F.col("threshold"), 1).otherwise(0), F.lit(int(max_repeat)).cast("long"))


def mix(docs: DataFrame, max_repeat: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document.

    ``copies`` is how often the mix holds the document, ``taken`` the words of
    these copies.  A source's taken words differ from its target by less than
    the size of one document (of one hash value).
    """
    d = written(sizes(docs), "mix-sizes")
    return (d.join(_plan(d, max_repeat), F.col("source").eqNullSafe(F.col("s")))
            .withColumn("copies", _copies(F.col("h"), max_repeat))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken")))


def mixed(docs: DataFrame, max_repeat: float = 3.0) -> DataFrame:
    """The rows of the mix: ``docs`` filtered, and repeated as often as the mix holds them."""
    p, copy = free_name("_mix_plan", docs.columns), free_name("_mix_copy", docs.columns)
    take = plan(docs, max_repeat).select(F.struct("s", "whole", "threshold").alias(p))
    joined = docs.join(take, docs["source"].eqNullSafe(take[p]["s"]))
    h = doc_hash(docs["doc_id"])
    copies = F.least(take[p]["whole"] + F.when(h < take[p]["threshold"], 1).otherwise(0), F.lit(int(max_repeat)).cast("long"))
    return (joined.withColumn(copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies))))
            .select(*(docs[c] for c in docs.columns)))


#: The same computation in DuckDB, by sorting.
ORACLE = """
WITH d AS (SELECT doc_id, source,
                  CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
                  ('0x' || substr(md5(coalesce(cast(doc_id AS varchar), '')), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM p),
v AS (SELECT *, ((i - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM w),
l AS (SELECT *, cap / weight AS fill,
             (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
      FROM v),
t AS (SELECT source, source_size, least(cap, coalesce(arg_min(lev, pos) FILTER (WHERE fill >= lev) OVER (), fill) * weight) AS target FROM (SELECT *, row_number() OVER (ORDER BY fill, i) AS pos FROM l)),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.h, d.size, b.source_size, b.target, b.whole, target - whole * b.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS run,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * least(3, whole + CASE WHEN run <= budget OR (run - same <= budget AND same <= 2 * (budget - (run - same))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
