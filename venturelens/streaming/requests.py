"""T1 evaluate_stream: the request loop as a Structured Streaming query.

Requests arrive as JSON-lines files.  Every micro-batch is validated (C15) and
evaluated against the static catalog with the batch plan of Q1 through
``foreachBatch`` (a non-time ``row_number`` window is not allowed directly on a
streaming frame).  Each batch overwrites its own ``epoch=<id>`` folder, so a
replay after a failure rewrites the same output: with the checkpoint this is
effectively exactly-once.  Catalog vectors are computed once and stored as
Parquet before the stream starts, not once per micro-batch.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from venturelens.operators.guards import split_requests
from venturelens.plans.evaluate import catalog_vectors, evaluate_ideas
from venturelens.schema import CORRUPT_RECORD, DEFAULT_K, YearBounds
from venturelens.sources.catalog import checked_schema


def materialize_vectors(catalog: DataFrame, path: str, encoder=None) -> DataFrame:
    """Write (id, embedding) of the catalog once and read it back."""
    catalog_vectors(catalog, encoder).write.mode("overwrite").parquet(path)
    return catalog.sparkSession.read.parquet(path)


def request_key() -> Column:
    """What makes two requests the same one."""
    content = F.sha2(F.to_json(F.struct("user_idea", "user_city", "founding_year", CORRUPT_RECORD)), 256)
    return F.coalesce(F.concat(F.lit("id "), F.col("idea_id").cast("string")), F.concat(F.lit("text "), content))


def evaluate_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                    catalog: DataFrame, k: int = DEFAULT_K, bounds: YearBounds | None = None,
                    available_now: bool = True, processing_time: str | None = None,
                    cat_vectors: DataFrame | None = None, encoder=None) -> StreamingQuery:
    """Start the stream; results go to ``out_dir/evaluated``, rejects to ``out_dir/rejected``.

    A request is known by its ``idea_id`` (without one, by its content; a malformed line by its text):
    one that has been taken up before, in any file or before a restart, is not evaluated again.
    The state is one key per request and does not expire; it lives with the checkpoint.
    """
    if cat_vectors is None:
        cat_vectors = materialize_vectors(catalog, os.path.join(out_dir, "_catalog_vectors"), encoder)
    requests = (spark.readStream.schema(checked_schema()).option("columnNameOfCorruptRecord", CORRUPT_RECORD).json(in_dir)
                .withColumn("_key", request_key()).dropDuplicates(["_key"]).drop("_key"))

    def run_batch(batch: DataFrame, epoch_id: int) -> None:
        _, rejected = split_requests(batch, bounds)
        result = evaluate_ideas(batch, catalog, k=k, bounds=bounds, encoder=encoder,
                                cat_vectors=cat_vectors)
        result.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite") \
            .parquet(os.path.join(out_dir, "evaluated", f"epoch={epoch_id}"))
        rejected.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite") \
            .parquet(os.path.join(out_dir, "rejected", f"epoch={epoch_id}"))

    writer = requests.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
