"""A training-data pipeline over `documents`: each stage applies one operator of maskwright.llm to all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents. SQL can't express these stages; tests/llm holds them against brute-force versions. Texts may be of any length: no stage cuts one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import fresh, stored, table
from maskwright.llm.decontaminate import remove_contaminated
from maskwright.llm.jaccard_join import keep_one
from maskwright.llm.language_id import fit, predict
from maskwright.llm.pii import mask_pii
from maskwright.llm.sentence_pieces import encode_documents

#: Documents whose language filters hold less than this part of their n-grams are in none of the learned languages. The part is known only
#: up to about DOUBT / sqrt(n) of n characters, in which a document is kept.
LEAST_LANGUAGE_SCORE, DOUBT = 0.1, 0.5

#: The stages share their executors' memory, so the last one keeps fewer parts than the operator alone does.
PIECE_MEMO = 50_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts, too) and those in none of the languages that `documents` teaches; `lang`
    becomes the predicted language. Repeated rows stay; an empty table gives none; other columns stay, whatever their names."""
    columns, (lang, score) = docs.columns, fresh(docs, "lang_pred", "score")
    found = predict(docs, fit(docs), columns, (lang, score))
    kept = found.where((F.col(lang) != "und") & (F.col(score) + DOUBT / F.sqrt(F.length("text")) >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col(lang)).select(*columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates; null and empty texts and null ids stay, and so do all
    rows of a kept doc_id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of documents, and drops documents that are mostly benchmark. Null texts stay null; of rows that repeat a
    doc_id each is taken by its own text; an empty benchmark changes nothing."""
    return with_length(remove_contaminated(docs, table(spark, sf_dir, "benchmark")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data and secrets; each row stays, null texts stay null."""
    return with_length(mask_pii(docs))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' SentencePiece ids, one row for each row; a null text has none."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), PIECE_MEMO)


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontaminate),
    ("PII", pii),
    ("SentencePiece encoding", sentence_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs


ORACLE_SQL: str | None = None
