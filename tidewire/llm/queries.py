"""The queries of this folder, one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize, small_batches
from .oracles import ORACLES  # noqa: F401
from . import blocks, contamination, divergence, langid, lines, lm, pieces, quality, simhash, suffix, tokens, topk, trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every text."""
    vocabulary = tokens.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), vocabulary)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    return lm.score_documents(_table(spark, sf_dir, "documents"), langid.remainder("doc_id", 5) == 1)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every text."""
    kept = suffix.remove_repeats(_table(spark, sf_dir, "documents"))
    with small_batches(spark):
        return materialize(kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                                       F.sha2("kept", 256).alias("kept_sha256")), "repeats")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every text."""
    kept = blocks.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    coded = pieces.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, keep of every text; trusted: of good quality and not toxic."""
    labels = _table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    return quality.classify(_table(spark, sf_dir, "documents"), labels.select("doc_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every text."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the five best of every fiftieth vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every text."""
    index = contamination.build_index(_table(spark, sf_dir, "documents"))
    found = contamination.phrase_matches(index, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every text."""
    docs = _table(spark, sf_dir, "documents")
    held_out = langid.remainder("doc_id", 4) == 2
    found = langid.identify(docs, langid.fit(docs.filter(~held_out)))
    return found.select("doc_id", (langid.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources of a language, and the ten terms that each overuses most."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every text."""
    kept = lines.drop_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_lm_scoring, op3_suffix_dedup, op4_substring_dedup, op5_sentencepiece, op6_quality,
    op7_simhash, op8_topk, op9_decontamination, op10_language_id, op11_source_divergence, op12_line_dedup,
    op13_conversation_trie)}
