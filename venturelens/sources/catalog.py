"""Catalog and request sources, the cleaning projection, and result sinks.

S1 scan_catalog, S2 select_columns, S3 assign_row_id, S4 scan_requests,
S5 write_results, plus ``clean_catalog`` (the C-expressions as one projection).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venturelens.functions import cleaning as C
from venturelens.schema import (
    CATALOG_HEADERS, CORRUPT_RECORD, OPTIONAL_HEADERS, RAW_CATALOG_SCHEMA, REQUEST_SCHEMA, SERVING_DEFAULTS, CatalogDefaults,
)


class CatalogNotFound(FileNotFoundError):
    """Raised with a clear message when the catalog path does not exist."""


def normalize_nulls(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Turn CSV missing-value tokens into null in every string column."""
    string_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = set(cols) if cols is not None else string_cols
    return df.select(*[C.null_tokens_to_null(c).alias(c) if c in targets & string_cols else F.col(c)
                       for c in df.columns])


def _by_header(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """A CSV catalog with its columns found by header name, whatever their order."""
    reader = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
              .option("enforceSchema", False))
    df = reader.option("inferSchema", False).csv(path)          # reads the header; all columns are text
    raw = set(CATALOG_HEADERS.values()) | {"id"}
    names = {c: CATALOG_HEADERS.get(c.strip(), c.strip()) for c in df.columns}
    unknown = [c for c, n in names.items() if n not in raw]
    if unknown:
        raise ValueError(f"unknown catalog headers: {unknown}")
    if len(set(names.values())) < len(names):
        raise ValueError("a catalog column appears twice")
    optional = {CATALOG_HEADERS[h] for h in OPTIONAL_HEADERS} | {"id"}
    missing = sorted(raw - optional - set(names.values()))
    if missing:
        raise ValueError(f"catalog columns missing: {missing}")
    df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    if "id" in df.columns:
        df = df.withColumn("id", F.col("id").cast("long"))
    else:
        df = assign_row_id(df, out_col="id")
    for name in ("starting_year_raw", "employees_raw", "founders_raw"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    extra = ["founders_count_raw"] if "founders_count_raw" in df.columns else []
    return df.select(*RAW_CATALOG_SCHEMA.fieldNames(), *extra)


def scan_catalog(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = True) -> DataFrame:
    """Read a headered CSV (or Parquet) catalog; every raw column is text.

    Columns are found by header name (``CATALOG_HEADERS`` or the raw names).
    Optional ones may be absent: they are null, and without ``id`` rows are
    numbered in file order.  An unknown or missing header raises, a missing path
    raises ``CatalogNotFound``.  A quoted field may span lines, which makes each
    file one task; ``multi_line=False`` splits large files without such fields.
    """
    try:
        if fmt == "csv":
            df = _by_header(spark, path, multi_line)
        else:
            df = spark.read.format(fmt).load(path)
        df.schema  # noqa: B018 - forces path resolution now, not at the first action
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise CatalogNotFound(f"catalog not found: {path}") from exc
        raise
    return normalize_nulls(df)


def select_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep the named columns (pruned down to the scan)."""
    return df.select(*cols)


def assign_row_id(df: DataFrame, order_by: list[str] | None = None, key: str | None = None,
                  out_col: str = "row_id") -> DataFrame:
    """S3: a stable 0..n-1 id.

    A natural key is used as is when given.  Otherwise rows are sorted by
    ``order_by`` with a distributed range sort and numbered from per-partition
    counts: each row gets its partition's offset (a running sum over a table of
    one row per partition, broadcast back) plus its position inside the
    partition.  No row passes through Python and no window spans all rows.
    The numbered rows are cut with a reliable checkpoint in the shared folder
    before they are read twice, so a lost executor cannot renumber them.
    """
    from pyspark.sql import Window

    from venturelens.session import ensure_checkpoint_dir

    if key is not None:
        return df.withColumn(out_col, F.col(key).cast("long"))
    ordered = df.orderBy(*order_by) if order_by else df
    numbered = (ordered.withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    ensure_checkpoint_dir(df.sparkSession)
    numbered = numbered.checkpoint(eager=True)
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    # one row per partition of ``numbered``: a bound fixed before any job runs
    within = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (numbered.join(F.broadcast(offsets), "_pid")
            .select(*df.columns, (F.col("_off") + within).cast("long").alias(out_col)))


def clean_catalog(raw: DataFrame, defaults: CatalogDefaults = SERVING_DEFAULTS) -> DataFrame:
    """The cleaning projection: one narrow select, no shuffle, no UDF.

    Optional columns (C9) absent from ``raw`` become constant zero.
    """
    cols = set(raw.columns)

    def opt(name: str, expr):
        return expr(F.col(name)) if name in cols else F.lit(0.0)

    return raw.select(
        F.col("id").cast("long").alias("id"),
        F.col("company"),
        C.fill_text("description_raw", defaults.description).alias("description"),
        C.fill_text("industries_raw", defaults.industries).alias("industries"),
        F.col("city"),
        C.clean_currency("funding_raw").alias("funding"),
        F.col("funding_round"),
        opt("starting_year_raw", C.coerce_number).alias("starting_year"),
        opt("founders_count_raw", C.coerce_number).alias("founders_count"),
        opt("employees_raw", C.first_integer).alias("employees_count"),
        (C.range_midpoint(C.sentinel_to_null("employees_raw")) if "employees_raw" in cols
         else F.lit(None).cast("double")).alias("employees_mid"),
        C.list_count("founders_raw" if "founders_raw" in cols else F.lit(None).cast("string"))
        .alias("founders"),
    )


def scan_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request records (JSON lines) with the fixed request schema."""
    return spark.read.schema(REQUEST_SCHEMA).json(path)


def checked_schema() -> T.StructType:
    """The request schema and a column for the text of lines that are no such record."""
    return T.StructType([*REQUEST_SCHEMA.fields, T.StructField(CORRUPT_RECORD, T.StringType())])


def scan_checked_requests(spark: SparkSession, path: str) -> DataFrame:
    """S4 with malformed lines kept: their text is in ``_corrupt_record``, and C15 rejects them with a reason."""
    return spark.read.schema(checked_schema()).option("columnNameOfCorruptRecord", CORRUPT_RECORD).json(path)


def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write one nested record per request (idempotent overwrite)."""
    df.write.mode("overwrite").format(fmt).save(path)
