"""Join helper for small per-group tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from venturelens.session import written


def computed_once(df: DataFrame, name: str = "small") -> DataFrame:
    """``df`` written to the shared folder and read back.

    It is computed once however often it is used, and its size in bytes is then
    known: Spark broadcasts it below ``spark.sql.autoBroadcastJoinThreshold``
    and shuffles beyond (AQE then splits hot keys).
    """
    return written(df, name)
