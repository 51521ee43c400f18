"""A corpus from raw documents: quality rules, near-dedup, decontamination, secret scan, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of docs. The last returns what the mix takes of each document.
Filters decide row by row, also where rows share a doc_id or have none.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import decontaminate, mixing, near_dedup, quality, secrets
from cladeframe.llm._common import Scratch, load


def _keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs with a key of each row, which is fixed by writing them, and the key's name."""
    row = next(name for k in count() if (name := f"row{k}") not in docs.columns)
    return scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "docs"), row


def _without(keyed: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows of keyed but for the keys in gone, without the key. Only the keys of what goes, the fewer, meet the texts."""
    return keyed.join(gone, row, "left_anti").drop(row)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row by its own verdict."""
    scratch = Scratch(spark, "quality-stage")
    keyed, row = _keyed(docs, scratch)
    verdicts = quality.quality_rules(keyed.withColumn("doc_id", F.col(row)))
    return _without(keyed, row, scratch.write(verdicts.where("not kept").select(F.col("doc_id").alias(row)), "gone"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, of the smallest doc_id, null last: five-word shingles, similarity 0.8 or more."""
    scratch = Scratch(spark, "dedup-stage")
    keyed, row = _keyed(docs, scratch)
    found = near_dedup.near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    found = scratch.write(found, "components")
    ids = keyed.select(row, F.col("doc_id").cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", row)).alias("first")
    stay = scratch.write(found.join(ids, row).groupBy("component_id").agg(first).select(F.col(f"first.{row}").alias(row)), "stay")
    gone = scratch.write(found.join(stay, row, "left_anti").select(row), "gone")
    scratch.drop("components", "stay")
    return _without(keyed, row, gone)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages to speak of."""
    return decontaminate.remove_contaminated(docs, load(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark."""
    return secrets.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of each document that is left."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("mixing", mixing_stage),
]

#: SQL can express neither the robust ellipsoids nor the automata nor the permutations; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the shared folder and read again."""
    docs, scratch = load(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
