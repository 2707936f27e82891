"""Exact quantiles (linear interpolation) without gathering a group in one task.

Spark's exact ``percentile`` aggregate merges every distinct value of a group
in one buffer, so one hot group (or a global quantile) lands on one task.
This operator instead:

1. counts rows per distinct (group, value) with map-side partial aggregation,
   so however many rows share one value, they are one row with a weight;
2. range-partitions these distinct values and sums the weights inside each
   partition, so a hot group is split over many partitions by value;
3. turns the weights per (partition, group), a table of at most partitions x
   groups rows, into rank offsets, and finds for every group and probability
   the partition that holds ranks floor((n-1)p) and ceil((n-1)p);
4. fetches the values whose running weight covers those ranks, and interpolates.

The partitioned values are checkpointed (reliable checkpoint in the shared
folder) before they are used twice.

The result equals ``percentile`` / DuckDB ``quantile_cont``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venturelens.session import ensure_checkpoint_dir


def exact_quantiles(df: DataFrame, value: str, probs: list[float], group_cols: list[str] | None = None,
                    partitions: int | None = None, prefix: str = "q") -> DataFrame:
    """Per group: ``n`` and one column ``{prefix}_{i}`` per probability."""
    g = list(group_cols or [])
    spark = df.sparkSession
    nparts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = (df.select(*g, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
         .groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_w"))
         .repartitionByRange(nparts, *g, "_v")
         .withColumn("_pid", F.spark_partition_id()))
    # The partition numbers are used twice (rank offsets, value lookup).  A reliable
    # checkpoint in the shared folder fixes them once: a re-run or a lost
    # executor cannot re-sample the range bounds and renumber partitions.
    ensure_checkpoint_dir(spark)
    s = s.checkpoint(eager=True)
    stats = s.groupBy("_pid", *g).agg(F.sum("_w").alias("_c"))
    by_group = Window.partitionBy(*g) if g else Window.partitionBy()
    before = by_group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = (stats.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
             .withColumn("_n", F.sum("_c").over(by_group)))
    wanted = []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        for kind, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            wanted.append(F.struct(F.lit(i).alias("_i"), F.lit(kind).alias("_k"),
                                   rank.cast("long").alias("_r"), (pos - F.floor(pos)).alias("_f")))
    targets = (stats.select(*g, "_pid", "_n", "_off", "_c", F.explode(F.array(*wanted)).alias("_t"))
               .select(*g, "_pid", "_n", "_off", "_c", "_t.*")
               .where((F.col("_r") >= F.col("_off")) & (F.col("_r") < F.col("_off") + F.col("_c")))
               .select(*[F.col(c).alias(f"_t_{c}") for c in g], F.col("_pid").alias("_t_pid"), "_n", "_i", "_k", "_f",
                       (F.col("_r") - F.col("_off")).alias("_at")))
    in_part = Window.partitionBy("_pid", *g).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = s.withColumn("_end", F.sum("_w").over(in_part))
    same = F.col("_pid") == F.col("_t_pid")
    for c in g:
        same &= F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    vals = ranked.join(targets, same & (F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_w")))
    per_p = vals.groupBy(*g, "_n", "_i").agg(
        F.max(F.when(F.col("_k") == "lo", F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_k") == "hi", F.col("_v"))).alias("_hi"),
        F.max("_f").alias("_f"))
    per_p = per_p.withColumn("_q", F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo")))
    return per_p.groupBy(*g).agg(
        F.max("_n").cast("bigint").alias("n"),
        *[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"{prefix}_{i}") for i in range(len(probs))])
