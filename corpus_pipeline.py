"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the last return the columns of documents
(n_chars follows the text). run() writes each stage's rows to the shared folder before the next one reads them.

Defined results: a null text counts as empty; rows repeated with one id and text are decided alike; an empty table passes through every stage as no rows; a document
whose lines are all duplicates keeps its row with an empty text until SimHash, where the empty texts are one group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import decontaminate, linededup, packing, quality, simhash
from strataweave.llm.common import cut, table, tidy

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go."""
    tidy(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return _documents(quality.keep_good(docs, model))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that come again, or nearly so, go from all documents but the first."""
    tidy(spark)
    return _documents(linededup.dedup_lines(docs))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one document stays."""
    tidy(spark)
    return _documents(simhash.near_dedup(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    tidy(spark)
    return _documents(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    tidy(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained classifier, XXH64 with a seed and a tokenizer have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
