"""Exact dedup with a stateful stream.

Three steps, all of them DataFrame operations:

1. *Landing*: every row of the documents becomes a narrow row: digest of the
   normalised text, number of code points, stable identifier (doc_id) and
   content locator (file and row in it).
2. *State*: a stream reads the landed rows and aggregates them by digest.  Its
   keyed state lives in RocksDB on the executors' disks, is checkpointed to the
   shared folder and never expires.  Per digest it retains the locator and
   identifier of the row that stays, and the size of the group.  Map-side
   partial aggregation folds a group of copies before the shuffle, however
   large the group is.  Further rows landed later update the same state.
3. *Hits*: rows whose digest the state has seen more than once are compared by
   their full normalised bytes: the class of a hit row is (digest, bytes), so
   two texts that only share a digest are never merged.

Texts are equal when identical after deleting [\\x20\\x09-\\x0D]; null counts as
empty.  The row with the most code points in the original text stays, then the
smallest doc_id (a null id after all others), then the first by locator, so
that of identical repeated rows exactly one stays.  Extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venturelens.llm.textkit import free_name
from venturelens.session import scratch_path, written

#: Tasks over which the rows of one digest are spread while their bytes are compared.
SALTS = 16
#: State on disk; changes are checkpointed as logs, and small stores do not reserve space ahead.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with the locator of each row; frames that are no file scan are written first."""
    def add(df):
        place = df.metadataColumn("_metadata")         # the scan's own, also where a column has its name
        return df.select("doc_id", "text", place["file_path"].alias("file"), place["row_index"].alias("row"))
    try:
        return add(docs)
    except AnalysisException:
        return add(written(docs.select("doc_id", "text"), "dedup-input"))


def land(docs: DataFrame, path: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Appends the narrow rows of ``docs`` (with locators) to the landing table at ``path``."""
    rows = docs.select("doc_id", "file", "row", digest(normalised()).alias("digest"),
                       F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"))
    rows.write.mode("append").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def _best() -> Column:
    """The row that stays, as the largest in this order."""
    return F.struct(F.col("n_points").alias("n_points"), F.col("doc_id").isNotNull().alias("has_id"),
                    (-F.col("doc_id")).alias("minus_id"), F.col("file").alias("file"), F.col("row").alias("row"))


def advance(spark: SparkSession, landing: DataFrame, landing_path: str, state_path: str) -> DataFrame:
    """Runs the stream over what has landed since the last call and returns the whole state.

    digest, group_size and ``keep`` (identifier and locator of the row that stays).
    """
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        query = (spark.readStream.schema(landing.schema).parquet(landing_path)
                 .groupBy("digest").agg(F.max(_best()).alias("keep"), F.count(F.lit(1)).alias("group_size"))
                 .writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", state_path).start())
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    state = spark.read.format("statestore").load(state_path)
    keep, size = state.schema["value"].dataType.names[:2]
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.{keep}").alias("keep"),
                        F.col(f"value.{size}").alias("group_size"))


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, file, row, digest, keep_id, keep_file, keep_row, group_size, kept."""
    spark = docs.sparkSession
    docs = located(docs)
    base = scratch_path(spark, "dedup")
    landing = land(docs, f"{base}/landing", digest)
    state = advance(spark, landing, f"{base}/landing", f"{base}/state")
    state = written(state, "dedup-state")
    # hits: every byte of the normalised text counts.  The salt spreads the rows of one digest over
    # tasks, each of which folds its copies before (digest, bytes) are gathered.
    seen = (state.where("group_size > 1").select("digest")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    # of the texts only the normalised bytes are shuffled
    hits = (docs.select("doc_id", "file", "row", normalised().cast("binary").alias("bytes"),
                        F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"))
            .withColumn("digest", digest(F.col("bytes").cast("string")))
            .withColumn("salt", F.pmod(F.xxhash64("file", "row"), F.lit(SALTS)).cast("int"))
            .join(seen, ["digest", "salt"], "left_semi"))
    classes = hits.groupBy("digest", "bytes").agg(F.max(_best()).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    proven = written(classes.groupBy("digest").agg(
        F.count(F.lit(1)).alias("classes"), F.max("keep").alias("keep"), F.sum("group_size").alias("group_size")),
        "dedup-proven")
    resolved = (state.where("group_size = 1").select("digest", "keep", "group_size")
                .unionByName(proven.where("classes = 1").select("digest", "keep", "group_size")))
    rows = landing.select("doc_id", "file", "row", "digest").join(resolved, "digest")
    if not proven.where("classes > 1").isEmpty():
        # texts that share a digest and differ: their rows go by (digest, bytes)
        shared = proven.where("classes > 1").select("digest")
        rows = rows.unionByName(
            hits.join(shared, "digest", "left_semi").select("doc_id", "file", "row", "digest", "bytes")
            .join(classes, ["digest", "bytes"]).drop("bytes"))
    return rows.select("doc_id", "file", "row", "digest", (-F.col("keep.minus_id")).alias("keep_id"),
                       F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"), "group_size",
                       ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are dropped as copies; all columns stay."""
    names = docs.columns
    file, row = free_name("_dedup_file", names), free_name("_dedup_row", names)

    def placed(df: DataFrame) -> DataFrame:
        place = df.metadataColumn("_metadata")
        return df.select("*", place["file_path"].alias(file), place["row_index"].alias(row))

    try:
        rows = placed(docs)
    except AnalysisException:
        docs = written(docs, "dedup-input")
        rows = placed(docs)
    gone = dedup(docs).where(~F.col("kept")).select(F.col("file").alias(file), F.col("row").alias(row))
    return rows.join(gone, [file, row], "left_anti").select(*names)


ORACLE = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
