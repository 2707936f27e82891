"""A stored catalog of vectors that is refreshed, not rebuilt.

Below its folder a store has versions ``v=<n>``: Parquet rows (id, digest, encoder, embedding,
fresh) with one row per id.  ``refresh`` compares the catalog with the last complete version by
id, SHA-256 of the text and name of the encoder: rows that agree are carried over, only the others
are encoded (an anti join), and ids that left the catalog are not carried over.  If nothing changed no version is
written.  A version counts once Spark has committed it, so a run that dies leaves the
store as it was, and a reader keeps the version that it opened.  One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venturelens.operators.model import encoder_id
from venturelens.operators.vectors import with_embedding

_ROWS = "id long, digest string, encoder string, embedding array<float>, fresh boolean"


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: rows encoded, carried over and removed, and the version that holds them."""

    encoded: int
    kept: int
    removed: int
    version: int


class VectorStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        p, fs = self._folder()
        if not fs.exists(p):
            return []
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()
                      and fs.exists(hadoop(f"{self.path}/{n}/_SUCCESS")))

    def rows(self, version: int | None = None) -> DataFrame:
        """Rows of a version, of the last one by default; none where there is no version."""
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], _ROWS)
        return self.spark.read.schema(_ROWS).parquet(f"{self.path}/v={have[-1] if version is None else version}")

    def vectors(self) -> DataFrame:
        """(id, embedding) as ``evaluate_ideas(cat_vectors=)`` takes them."""
        return self.rows().select("id", "embedding")

    def refresh(self, catalog: DataFrame, text_col: str = "description", id_col: str = "id", encoder=None) -> Refresh:
        """Bring the store up to the catalog; a null text is encoded as an empty one."""
        name = encoder_id(encoder)
        have = self.versions()
        old = self.rows()
        now = catalog.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        now = now.withColumn("digest", F.sha2("text", 256))
        # one row per id: repeated rows of an id are one, of different texts the least digest stands
        now = now.groupBy("id").agg(F.min(F.struct("digest", "text")).alias("r")).select("id", "r.digest", "r.text")
        known = old.where(F.col("encoder") == name).select("id", "digest")
        kept = old.where(F.col("encoder") == name).join(now.select("id", "digest"), ["id", "digest"], "left_semi").withColumn("fresh", F.lit(False))
        changed = now.join(known, ["id", "digest"], "left_anti")
        fresh = with_embedding(changed, "text", "embedding", encoder=encoder).select(
            "id", "digest", F.lit(name).alias("encoder"), "embedding", F.lit(True).alias("fresh"))
        n_old = old.count()
        n_kept = kept.count() if have else 0
        if have and n_kept == n_old and changed.isEmpty():
            return Refresh(0, n_kept, 0, have[-1])
        version = have[-1] + 1 if have else 1
        target = f"{self.path}/v={version}"
        kept.select("id", "digest", "encoder", "embedding", "fresh").unionByName(fresh).write.mode("overwrite").parquet(target)
        encoded = self.rows(version).where("fresh").count()
        return Refresh(encoded, n_kept, n_old - n_kept, version)

    def prune(self, keep: int = 2) -> list[int]:
        """Remove all but the last ``keep`` versions; returns those removed."""
        gone = self.versions()[:-keep] if keep > 0 else self.versions()
        _, fs = self._folder()
        for v in gone:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}"), True)
        return gone
