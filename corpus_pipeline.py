"""Corpus pipeline: quality rules, near-dedup, benchmark decontamination, PII redaction, best-fit packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and but for the last returns the columns of
docs. Decisions are made for rows, not for ids: a stage that joins numbers the rows of its input first, so rows without a doc_id,
and rows that share one, are documents like all others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import passing, scratch_path, stored, table
from tidegrid.llm.components import connected_components
from tidegrid.llm.decontamination import contamination
from tidegrid.llm.near import similar_links
from tidegrid.llm.packing import pack
from tidegrid.llm.pii import redact
from tidegrid.llm.quality import rejected_by
from tidegrid.llm.simhash import fingerprints, groups

#: No SQL: the PII stage's added spans come from boosted trees, and bins are packed online.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return docs.filter(rejected_by(docs).isNull())


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a number for each row, and the name of that column."""
    name = "row"
    while name in docs.columns:
        name = f"_{name}"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one of the smallest doc_id, rows without a doc_id last.

    Links are those of op4's fingerprints and those of similar sets of five-word shingles.
    """
    numbered, row = _numbered(docs)
    with passing(spark):
        close = groups(fingerprints(numbered, id_col=row)).filter("doc_id <> component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
        roots = stored(connected_components(close.unionByName(similar_links(numbered, id_col=row))), "near-groups")
        ids = numbered.select(F.col(row).alias("node"), "doc_id")
        members = stored(roots.join(ids, "node"), "near-members")
        kept = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))["node"].alias("node"))
        other = stored(members.select("node").join(kept.select("node"), "node", "left_anti").select(F.col("node").alias(row)), "near-copies", keep=True)
    return numbered.join(other, row, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    numbered, row = _numbered(docs)
    with passing(spark):
        found = contamination(numbered, table(spark, sf_dir, "benchmark"), id_col=row)
        hit = stored(found.filter("n_hit > 0").select(F.col("doc_id").alias(row)), "contaminated", keep=True)
    return numbered.join(hit, row, "left_anti").select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind; n_chars follows the text."""
    redacted = redact(docs)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"]))
        redacted = redacted.withColumn("n_chars", changed)
    return redacted.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_pii", redact_pii),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
