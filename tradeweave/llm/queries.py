"""The registered queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .ann import one_bit_search
from .common import table, text_or_empty
from .jaccard_tree import jaccard_components
from .language_crf import language_model, predict_languages
from .lattice_lm import lattice_scores
from .merge_dropout import encode_with_dropout
from .oracles import OP4, OP6, OP8, OP11, OP13
from .packing import pack
from .prefix_trie import prefix_trie
from .quality_rules import quality_rules
from .secret_forest import find_secrets
from .sharding import sampled_splitters
from .spelling_kd import spelling_variants
from .token_counts import token_counts
from .warc_zip import round_trip


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: eight shards of near equal size, ranges of (text checksum, doc_id)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text_or_empty()).cast("long") + 1).alias("size"), F.crc32(text_or_empty()).alias("text_crc32"))
    placed = sampled_splitters(docs, key="text_crc32", tie="doc_id", size="size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), keep_ids=False)


def op4_jaccard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9 or more."""
    found = jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents with crc32(doc_id) mod 5 not 0; predicts all."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = language_model(docs, may_learn=~held_out & F.col("doc_id").isNotNull())
    return predict_languages(docs, model, spans=False).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_chars")])


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text under one seed; ``lossless`` says that they decode to the text."""
    return encode_with_dropout(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep_ids=False)


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages")).drop("target_uri")


def op9_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return one_bit_search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, with the forest's verdict; the candidate itself only as a checksum."""
    return find_secrets(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of up to five turns come from the first conversation of each hundred."""
    return prefix_trie(table(spark, sf_dir, "conversations"), base=lambda c: c - c % 100, head=lambda c: F.crc32(c.cast("string")) % 6)


def op12_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents with crc32(doc_id) mod 7 not 2; scores all."""
    return lattice_scores(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), held_out=F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six code points and five occurrences or more; a form has at least five times the word's count."""
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sampled_splitters": op1_sampled_splitters,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_jaccard_tree": op4_jaccard_tree,
    "op5_language_crf": op5_language_crf,
    "op6_quality_rules": op6_quality_rules,
    "op7_merge_dropout": op7_merge_dropout,
    "op8_warc_zip": op8_warc_zip,
    "op9_one_bit_search": op9_one_bit_search,
    "op10_secret_forest": op10_secret_forest,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lattice_likelihood": op12_lattice_likelihood,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES: dict[str, str] = {"op4_jaccard_tree": OP4, "op6_quality_rules": OP6, "op8_warc_zip": OP8, "op11_prefix_trie": OP11, "op13_spelling_variants": OP13}
