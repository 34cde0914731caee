"""Corpus pipeline: toxicity, language ID, n-gram Jaccard join, decontamination, BPE round trip.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``.  All but the last return the columns of
``documents``; the last adds the token ids and whether they decode to the text.

Nulls: a null text has the toxicity model's base score (kept), the language ``und``
(rejected), so it never reaches the later stages.  A null id takes part like any other.  Of
repeated rows one stays (third stage); rows that share an id but not the text are told apart.
Among the documents of a group that tie in the id, the smaller hash of the text stays.
Columns of ``documents`` keep their values whatever their names; a new column of the last stage
whose name is taken gets underscores behind it.  Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import bpe, decontaminate, langid, ngram_jaccard, toxicity
from ferrule.llm import text_arrays as ta

#: A document this likely to be toxic is rejected.
TOXIC = 0.5
#: A document whose language is less certain than this is rejected.
CERTAIN = 0.5


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores behind it as long as a column has it."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the factorization machine calls toxic."""
    fold = ta.crc_mod(F.col("doc_id"), 5)
    labels = ta.table(spark, sf_dir, "labels")
    model = toxicity.train(docs.where(fold != 0), labels.where(fold != 0))
    name = free_name(docs, "toxic_share")
    return toxicity.score_toxicity(docs, model, name=name).where(F.col(name) < TOXIC).select(docs.columns)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a clear language."""
    fold = ta.crc_mod(F.col("doc_id"), 4)
    model = langid.train(docs.where(fold != 2))
    lang, share = free_name(docs, "lang_found"), free_name(docs, "lang_share")
    scored = langid.identify_language(docs, model, names=(lang, share))
    return scored.where((F.col(lang) != langid.UND) & (F.col(share) >= CERTAIN)).select(docs.columns)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are not in ``gone`` (gone_id, gone_text, a hash of the text)."""
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_text"))
    return docs.join(gone.distinct(), same, "left_anti")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that link to each other, directly or not, the one with the smallest id stays."""
    joined = ngram_jaccard.join(docs).where("not keeper").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text"))
    return without(docs, joined).dropDuplicates(["doc_id", "text"]).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("key"), "text")
    leaks = decontaminate.find_leaks(keyed, ta.table(spark, sf_dir, "benchmark"), id_col="key")
    return without(docs, leaks.select(F.col("doc_id")["doc_id"].alias("gone_id"), F.col("doc_id")["hash"].alias("gone_text"))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each whole text, decoded again as proof."""
    ids, n, proof, decoded = (free_name(docs, x) for x in ("ids", "n_tokens", "round_trip", "decoded"))
    coded = bpe.round_trip(docs, names=(ids, decoded))
    same = F.col(decoded) == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.withColumn(n, F.size(ids).cast("long")).withColumn(proof, same).drop(decoded)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", drop_leaks),
    ("byte_level_bpe", tokens),
]

#: The models of the first two stages are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = ta.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ta.cut(stage(spark, docs, sf_dir), name)
    return docs
