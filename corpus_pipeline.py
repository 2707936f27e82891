"""Training-data pipeline: quality, exact dedup, near dedup, source mix, token ids.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame.  Each result is written as Parquet and read again as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venturelens.llm import byte_bpe, mixing, parity_join, pu_quality, stream_dedup
from venturelens.llm.registry import table, tokenizer_file, tokenizer_pattern
from venturelens.llm.textkit import remainder
from venturelens.session import ship_package, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the classifier rejects (score below 0.3) go."""
    labels = table(spark, sf_dir, "labels")
    model = pu_quality.fit(docs, labels.where((F.col("quality") == 1) & (remainder("doc_id", 5) != 0)))
    return pu_quality.keep_good(docs, model, 0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of texts equal but for white space, one stays."""
    return stream_dedup.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group linked by 80 % of five-word shingles, the smallest doc_id stays."""
    return parity_join.keep_one(docs, parity_join.Similarity(n=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents are left out or repeated until the sources have their target weights."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: doc_id, n_tokens and ids of every document."""
    ranks = byte_bpe.read_ranks(spark, tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(docs, ranks, tokenizer_pattern())


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("mix_sources", mix_sources), ("token_ids", token_ids)]

#: Two stages (a trained network, byte-pair merges) have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
