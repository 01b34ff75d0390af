"""A training corpus from ``documents``: five stages, each an operator of runlens.llm.

Every stage takes all rows that its predecessor kept. Stages are written as
Parquet and read again, so a lost executor never costs more than a stage.

Defined results: rows are documents, ids need not be unique and may be null; null and
empty texts have no language and leave at the first stage; of near duplicates the
document with the smallest id stays, and rows alike in id and text stay or go as the
operators say; columns other than the five of ``documents`` are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import langid, mixing, oddsketch, packing, pii
from runlens.llm.common import free, materialise, word_count
from runlens.sources.tables import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words from which a text is long enough to be sure about.
LONG = 20
#: Share of the way from chance to certainty that the score of a short and of a long text must make. Held-out
#: documents of 40 words score 0.98 and more (99 of 100), texts in seven languages never learned 0.74 at most.
SHORT_SURE, LONG_SURE = 0.25, 0.6
#: Score at which a long text's own words are believed against its tag.
CERTAIN = 0.95


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Their tag is filled in where it is missing and
    replaced where a long text certainly is in another language."""
    chance = 1 / max(1, docs.where("lang IS NOT NULL").select("lang").distinct().count())
    words = free(docs, "_words")
    found = langid.identify(docs.withColumn(words, word_count(F.col("text"))))
    long = F.col(words) >= LONG
    least = chance + (1 - chance) * F.when(long, LONG_SURE).otherwise(SHORT_SURE)
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= least - 1e-9))
    own = F.when(long & (F.col("score") >= CERTAIN), F.col("lang_pred")).otherwise(F.coalesce("lang", "lang_pred"))
    return found.withColumn("lang", own).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8)."""
    return oddsketch.drop_near_duplicates(docs, words=5, percent=80).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    found = pii.find(docs)
    masked = found.withColumn("text", F.when(F.col("text").isNotNull(), pii.mask(F.col("text"), F.col("pii_spans"))))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as their source's target asks."""
    return mixing.repeat_rows(mixing.mix_sources(docs)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens. The workers have other stages behind and before them, so they keep
    fewer words, and none beyond a task."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, end_id=2, cache=8 << 20, keep_encoder=False)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("mask_personal_data", mask_personal_data),
    ("mix", mix),
    ("pack", pack),
]

#: Trained models decide in two stages; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
