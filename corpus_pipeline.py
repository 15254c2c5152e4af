"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, BPE. Each stage reads what the one before wrote.

What every stage makes of odd rows: a null or letterless text is rejected by language ID; for later stages it would be an
empty text, equal to other empty ones and near to none. Null ids are values of their own: they are never learned from, and
rank last where the least id stays. Of rows that agree in id and text one stays. A null language or source is a value of its own in
mixing. Long texts are never cut. An empty table passes all stages as an empty table. Columns beside those of
`documents` don't come through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import bpe, exactdedup, langid, mixing, neardup
from talweg.llm.common import fresh_path, table
from talweg.storage import release, staged_so_far

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Predictions below this posterior probability are rejected, as are texts without a letter.
LEAST_SCORE = 0.5
#: The share of the tokens that mixing keeps.
BUDGET = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on; `und` and uncertain ones go."""
    model = langid.fit(docs.where(langid.remainder("doc_id", 3) != 1), F.col("lang"), key=F.col("doc_id"))
    found = langid.predict(docs, model, keep=COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exactdedup.distinct(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return neardup.distinct(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probability."""
    return mixing.sample(docs, keep=BUDGET).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("source", "lang"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: SQL can't express the classifier, the samples or the merges; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and what the stage had staged on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, path = staged_so_far(), fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, before)
        docs = spark.read.parquet(path)
    return docs
