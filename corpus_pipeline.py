"""A corpus preparation pipeline over ``documents``.

Stages, in order: language identification (documents without an identified
language go), near-duplicate removal (one document of each group stays), secret
redaction, mixing of sources to target weights, sampled SentencePiece encoding.
Every stage takes what its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.llm import crf_langid, entropy_mix, markov_secrets, odd_minhash, sp_lattice
from traitloom.llm._common import cut, fresh

#: Share of its words' features that a text in a learned language has at least.
LEAST_KNOWN = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in none of the learned languages.

    These have no letters, or are made of words whose affixes and n-grams the
    labelled texts hardly know.  That share depends neither on the number of
    languages nor on how a text mixes them.
    """
    model = crf_langid.train(docs.select("doc_id", "text", "lang"))
    (found,) = fresh(docs, "found")
    judged = docs.withColumn(found, crf_langid.verdict(F.col("text"), model))
    known = (F.col(found)["lang_pred"] != "und") & (F.col(found)["known"] >= LEAST_KNOWN)
    return judged.where(known).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near duplicates (five-word shingles, 0.8)."""
    judged = odd_minhash.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    return docs.join(judged.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret span by a mark; documents stay."""
    (found,) = fresh(docs, "found")
    spans = docs.withColumn(found, markov_secrets.all_spans(F.col("text"), *markov_secrets.learn(docs.select("doc_id", "text"))))
    clean = spans.withColumn("text", markov_secrets.redacted(F.col("text"), F.col(found)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents such that sources reach their target weights."""
    return entropy_mix.take(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, with the digest of the text they decode to."""
    decoded = sp_lattice.round_trip(docs.select("doc_id", "text"))
    return decoded.select("doc_id", "pieces", F.size("pieces").alias("n_pieces"), F.sha2("text", 256).alias("text_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Learned language models and sampled segmentations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is materialised before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
