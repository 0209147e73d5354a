"""One query per training-data operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, maxscore, ngram_join, prefix_trie
from .common import cut, table

GPT_JSON = "byte_bpe_50k.json"
MULTI = "byte_bpe_multi_50k.tiktoken"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(GPT_JSON), limit=1024)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import deduplicate

    found = deduplicate(table(spark, sf_dir, "documents"), length=100)
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_topk_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxscore import quantised, top_k

    vectors = cut(quantised(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict, training_rows, with_split

    docs = with_split(table(spark, sf_dir, "documents"))
    found = predict(docs.select("doc_id", "held_out", "text"), fit(training_rows(docs)))
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, read_archives

    return read_archives(spark, archive(table(spark, sf_dir, "pages"), min_bytes=0))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_trees, read_back, replies

    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return digests(read_back(format_trees(replies(rows), unique=True)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(GPT_JSON), capacity=2048)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judge(docs, rules).select("doc_id", *counts, "base_failed", "kept")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import decode, digests, encode

    path = public_tokenizers.path(MULTI)
    return digests(decode(encode(table(spark, sf_dir, "documents"), path), path))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"), words=3, percent=90)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), max_words=5, min_count=100, top=2000)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_suffix_dedup, op3_topk_maxscore, op4_language_id, op5_warc, op6_chat, op7_simhash, op8_packing, op9_quality, op10_byte_bpe,
        op11_ngram_join, op12_prefix_trie, op13_collocations,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op3_topk_maxscore": maxscore.ORACLE_SQL, "op6_chat": chat.ORACLE_SQL, "op11_ngram_join": ngram_join.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL,
}
