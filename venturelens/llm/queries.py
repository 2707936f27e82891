"""One query per numbered operator: the whole intended table, the whole result."""

from __future__ import annotations

from pyspark.sql import functions as F  # noqa: F401

from venturelens.llm import byte_bpe, conversation, impact_search, mincut_html, mixing, parity_join, ppm, projected_ann, pu_quality, rans, secret_scan, stream_dedup, toxicity
from venturelens.llm.textkit import held_out, remainder
from venturelens.llm.registry import ORACLES, QUERIES, register, table, tokenizer_file, tokenizer_pattern  # noqa: F401


@register("op4_mix_sources", mixing.ORACLE)
def op4_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@register("op5_exact_dedup", stream_dedup.ORACLE)
def op5_exact_dedup(spark, sf_dir):
    return stream_dedup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@register("op3_byte_bpe")
def op3_byte_bpe(spark, sf_dir):
    ranks = byte_bpe.read_ranks(spark, tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, tokenizer_pattern(), digests=True)


@register("op10_ngram_join", parity_join.ORACLE)
def op10_ngram_join(spark, sf_dir):
    return parity_join.join(table(spark, sf_dir, "documents"), parity_join.Similarity(n=3, percent=90))


@register("op6_language_id")
def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    trees = ppm.fit(docs.where(remainder("doc_id", 4) != 2))
    return ppm.predict(docs, trees).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@register("op9_quality")
def op9_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = pu_quality.fit(docs, labels.where((F.col("quality") == 1) & (remainder("doc_id", 5) != 0)))
    return pu_quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"))


@register("op8_secrets")
def op8_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(docs))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "model")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"), count("model").alias("n_model"))


@register("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.fit(docs, labels.where(remainder("doc_id", 3) != 1).select("doc_id", F.col("toxic").alias("label")))
    return toxicity.score(docs, net).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@register("op7_token_files")
def op7_token_files(spark, sf_dir):
    return rans.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


@register("op1_nearest")
def op1_nearest(spark, sf_dir):
    index = projected_ann.Index(table(spark, sf_dir, "embeddings"))
    return index.search(index.rows.where("vec_id % 50 = 0"))


@register("op13_lexical", impact_search.ORACLE)
def op13_lexical(spark, sf_dir):
    return impact_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@register("op12_conversations", conversation.ORACLE)
def op12_conversations(spark, sf_dir):
    return conversation.repair(conversation.damaged(table(spark, sf_dir, "conversations")))


@register("op11_main_text")
def op11_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return mincut_html.extract(pages, mincut_html.fit(pages))
