"""Training-data pipeline over ``documents``: toxicity, exact duplicates, near duplicates,
benchmark contamination, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read as
the next one's ``docs``. All but the last return the columns of ``docs``; the last
returns the placed pieces of every document that is left.

Edge cases are those of the operators: null texts count as empty, blank documents are
nobody's duplicate by shingles (but equal texts to the exact stage), an empty table
passes through, and extra columns pass under their own names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm.common import ROW_ID, on_files, only_rows, stored, table
from runlake.llm.decontam import contamination
from runlake.llm.exact_dedup import exact_duplicates
from runlake.llm.jaccard import near_duplicates
from runlake.llm.packing import pack_documents
from runlake.llm.toxicity import score_documents, train
from runlake.session import ensure_checkpoint_dir, ship_package

TOXIC = 0.5


def _ready(spark: SparkSession, docs: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return on_files(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``; labels teach as in operator 9."""
    docs = _ready(spark, docs)
    network = train(docs, table(spark, sf_dir, "labels"))
    score = "score"
    while score in docs.columns:
        score += "_"
    return score_documents(docs, network, score_col=score).filter(F.col(score) < TOXIC).drop(score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest document id."""
    docs = _ready(spark, docs)
    return only_rows(docs, exact_duplicates(docs).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest document id."""
    docs = _ready(spark, docs)
    found = stored(near_duplicates(docs), "near-duplicates")
    blank = found.filter("n_shingles = 0").select(*ROW_ID)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW_ID)).alias("first")
    kept = found.filter("n_shingles > 0").groupBy("label").agg(first).select(*[f"first.{c}" for c in ROW_ID])
    return only_rows(docs, kept.unionByName(blank))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    docs = _ready(spark, docs)
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).filter(F.size("spans") > 0)
    return only_rows(docs, hit, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's sequence and place."""
    return pack_documents(_ready(spark, docs))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("packing", packing)]

#: The trained scorer has no SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
