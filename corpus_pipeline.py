"""A training corpus from raw documents, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as
Parquet in the shared folder and read again as the next stage's ``docs``; all but the last
return the columns of ``documents`` (and whatever further columns came with them).

1. language_id: words are labelled by the conditional random field; documents without a
   letter go, and those whose letter pairs are hardly those of any learned language (by floors that the
   languages' own samples set, however many there are); a missing ``lang`` is filled.
2. quality_rules: lines that fail go, documents that fail or lose too much go.
3. jaccard_join: of each group of near duplicates (five-word shingles, similarity 0.8 or
   more) the document with the smallest id stays.
4. secret_scan: secrets that the forest confirms are replaced in the text.
5. packing: one row per piece of a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeweave.llm.common import fresh_name, staged, table, text_or_empty
from tradeweave.llm.jaccard_tree import jaccard_components
from tradeweave.llm.language_crf import UNKNOWN, language_model, predict_languages
from tradeweave.llm.packing import pack
from tradeweave.llm.quality_rules import quality_rules
from tradeweave.llm.queries import tokenizer_path
from tradeweave.llm.secret_forest import redact

#: Models are learned on the way, so no SQL gives these rows; tests hold the run to a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_model(docs, may_learn=F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    # the other columns ride along as one struct
    rest = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"), "text")
    told = predict_languages(rest, model, key="rest", spans=False, with_text=True, with_fit=True)
    kept = told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("fit") >= 0))
    out = {"text": F.col("text"), "lang": F.coalesce(F.col("rest")["lang"], F.col("lang_pred"))}
    return kept.select(*[out.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def _with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """``columns`` with another text and its length."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return docs.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules(docs)
    own = next(c for c in judged.columns if c not in docs.columns)
    return _with_text(judged.filter(F.col(own)["kept"]), docs.columns, F.col(own)["cleaned"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_components(docs, size=5, percent=80)
    first = found.filter("first").select(F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash")).distinct()
    own = fresh_name(docs.columns, "hash")
    hashed = docs.withColumn(own, F.xxhash64(text_or_empty()))
    kept = hashed.join(first, hashed["doc_id"].eqNullSafe(first["first_id"]) & (hashed[own] == first["first_hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(redact(docs), docs.columns, F.col("text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), keep_ids=False)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", rules),
    ("jaccard_join", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
