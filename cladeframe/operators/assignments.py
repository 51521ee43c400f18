"""Classifier assignments: parsing, collapsing duplicates, and the joins with records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.names import strip_pair_suffix
from cladeframe.functions.tags import set_taxon

MAX_TAXON = 4294967295


def parse_assignments(lines: DataFrame, column: str = "value") -> DataFrame:
    """classification_code, query_name, taxon_id of tab-separated lines; blank lines are skipped, bad ones fail."""
    part = F.split(F.col(column), "\t", 5)
    code, taxon = F.get(part, F.lit(0)), F.get(part, F.lit(2)).try_cast("long")
    whole = F.get(part, F.lit(2)).rlike(r"^\+?[0-9]+$") & (taxon <= MAX_TAXON)
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col(column)))
    checked = (
        F.when(F.size(part) < 5, fail("expected 5 tab-separated fields"))
        .when(~code.isin("C", "U"), fail("classification code must be C or U"))
        .when(~F.coalesce(whole, F.lit(False)), fail("invalid taxon ID"))
        .when((code == "U") & (taxon != 0), fail("unclassified read with a taxon ID"))
        .when((code == "C") & (taxon == 0), fail("classified read without a taxon ID"))
        .otherwise(taxon)
    )
    rows = lines.where(F.trim(F.regexp_replace(column, r"\s", " ")) != "")
    return rows.select(code.alias("classification_code"), strip_pair_suffix(F.get(part, F.lit(1))).alias("query_name"), checked.alias("taxon_id"))


def collapse(assignments: DataFrame) -> DataFrame:
    """query_name, taxon_id, one row a name; names with conflicting taxa fail."""
    both = assignments.groupBy("query_name").agg(F.min("taxon_id").alias("lo"), F.max("taxon_id").alias("hi"))
    why = F.concat(F.lit("duplicate read name '"), F.col("query_name"), F.lit("' with conflicting taxon IDs"))
    return both.select("query_name", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(why)).alias("taxon_id"))


def is_classified(taxon: Column) -> Column:
    return taxon != 0


def conflicts(assignments: DataFrame) -> DataFrame:
    """Names with more than one taxon: query_name, n_taxa."""
    return assignments.groupBy("query_name").agg(F.count_distinct("taxon_id").alias("n_taxa")).where("n_taxa > 1")


def look_up(records: DataFrame, name: Column, assignments: DataFrame) -> DataFrame:
    """Left join on the name: adds taxon_id, 0 for a miss, and missing. assignments must be one row a name."""
    side = assignments.select(F.col("query_name").alias("_name"), F.col("taxon_id").alias("_taxon"))
    joined = records.join(side, name == F.col("_name"), "left")
    return joined.withColumns({"taxon_id": F.coalesce("_taxon", F.lit(0).cast("long")), "missing": F.col("_taxon").isNull()}).drop("_name", "_taxon")


def unconsumed(assignments: DataFrame, records: DataFrame, name: Column) -> DataFrame:
    """Assignments that no record asks for."""
    return assignments.join(records.select(name.alias("query_name")), "query_name", "left_anti")


def annotate(alignments: DataFrame, assignments: DataFrame) -> DataFrame:
    """Alignments with the ti tag of their read's taxon; a named read without an assignment fails, an unnamed one passes."""
    side = collapse(assignments).select(F.col("query_name").alias("_name"), F.col("taxon_id").alias("_taxon"))
    joined = alignments.join(side, strip_pair_suffix(F.col("qname")) == F.col("_name"), "left")
    why = F.concat(F.lit("read '"), F.col("qname"), F.lit("' is not present in the assignments"))
    unnamed = F.col("qname").isNull() | F.col("qname").isin("", "*")
    tags = F.when(unnamed, F.col("tags")).when(F.col("_taxon").isNull(), F.raise_error(why)).otherwise(set_taxon(F.col("tags"), F.col("_taxon")))
    return joined.withColumn("tags", tags).drop("_name", "_taxon")


def annotate_counters(annotated: DataFrame) -> list[Column]:
    """Aggregates for annotated alignments: total, unnamed (passed as they are) and annotated records."""
    unnamed = F.coalesce(F.col("qname").isin("", "*"), F.lit(True))
    return [F.count("*").alias("total"), F.count_if(unnamed).alias("unnamed"), F.count_if(~unnamed).alias("annotated")]
