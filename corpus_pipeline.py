"""The corpus pipeline: language ID, n-gram Jaccard deduplication, benchmark decontamination, secret redaction, source mixing.

Every stage is (spark, docs, sf_dir) -> DataFrame.  A row with a null doc_id is told from others by a hash of its text
within a stage.  Rows that repeat a doc_id share its fate; the deduplication leaves one row of those that repeat both
doc_id and text.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.decontam import op9_benchmark_decontamination
from ridgeline.llm.frames import saved, table
from ridgeline.llm.jaccard import op1_ngram_jaccard_join
from ridgeline.llm.langid import detect, fit
from ridgeline.llm.mixing import mix
from ridgeline.llm.secrets import redact

#: A document whose language is less sure than this is rejected, as is one without a letter.  With two families of at most
#: two languages each, no score is lower, so that only documents without a letter are rejected.
MIN_LANGUAGE_SCORE = 0.25
#: Ids of a decision that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _fresh(docs: DataFrame, name: str) -> str:
    """The name, with underscores after it until `docs` has no such column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _key() -> Column:
    return F.coalesce(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("doc_id"), "text", "source")


def _joined(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs with their rows of ids (key, ...): a broadcast up to BROADCAST_ROWS, a shuffled join beyond."""
    ids = saved(ids)
    name = _fresh(docs, "key")
    few = ids.count() <= BROADCAST_ROWS
    ids = ids.withColumnRenamed("key", name)
    return docs.join(F.broadcast(ids) if few else ids, _key() == F.col(name), how).drop(name)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; a text of a language that wasn't learnt stays, under the learnt one that it is nearest to, unless its score is below MIN_LANGUAGE_SCORE.  A missing lang is filled in."""
    model = fit(docs, F.lit(True))
    lang, score = _fresh(docs, "lang_found"), _fresh(docs, "score_found")
    found = detect(docs, model, lang_as=lang, score_as=score).where((F.col(lang) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE))
    return found.withColumn("lang", F.coalesce("lang", lang)).select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.75 or more: that of the smallest doc_id."""
    members = saved(op1_ngram_jaccard_join(_keyed(docs)).select("doc_id", "component_id"))
    copies = members.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("key")).distinct()
    kept = _joined(docs, copies, "left_anti")
    repeated = saved(members.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key"))
    if not repeated.limit(1).count():
        return kept
    return _joined(kept, repeated, "left_anti").unionByName(_joined(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    found = op9_benchmark_decontamination(_keyed(docs), table(spark, sf_dir, "benchmark"), slop=None)
    return _joined(docs, found.where("contaminated").select(F.col("doc_id").alias("key")).distinct(), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by marks and n_chars counted anew; null texts and null n_chars stay null, repeated rows stay."""
    return redact(docs, "text", "n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with copy_no from 1 (or copy_no_ where there is such a column).

    A null text has no words and isn't taken; a null source is a source of its own; rows that repeat a key are all taken
    as often as the one that is taken most."""
    times, number = _fresh(docs, "times"), _fresh(docs, "copy_no")
    copies = mix(_keyed(docs)).where("copies > 0").groupBy(F.col("doc_id").alias("key")).agg(F.max("copies").alias(times))
    taken = _joined(docs, copies, "inner")
    return taken.withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns, number)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: The language model isn't expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet in the shared checkpoint folder and read again."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "ridgeline-checkpoints")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared}/pipeline-{uuid.uuid4().hex}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
