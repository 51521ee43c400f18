"""Flat tables of hierarchical reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.taxonomy import SPACES_PER_LEVEL, nearest_parents

#: The columns of the flat table in order.
COLUMNS = (
    "tax_id", "name", "rank", "level", "parent_tax_id", "parent_rank", "clade_count", "direct_count", "descendant_count", "frac_clade", "frac_direct", "frac_descendant", "minimizer_count", "distinct_minimizer_count",
)


def total_sequences(report: DataFrame) -> DataFrame:
    """_total: all sequences, the clade counts of the unindented rows."""
    return report.agg(F.coalesce(F.sum(F.when(F.col("indent") == 0, F.col("num_fragments_clade"))), F.lit(0)).alias("_total"))


def flat_report(report: DataFrame) -> DataFrame:
    """One row an entry with ord: parents, counts, and shares of all sequences (the clade counts of the unindented rows)."""
    total = total_sequences(report)
    rows = nearest_parents(report).join(F.broadcast(total))  # one row
    below = F.greatest(F.col("num_fragments_clade") - F.col("num_fragments_direct"), F.lit(0))
    share = lambda x: F.when(F.col("_total") > 0, x / F.col("_total")).otherwise(F.lit(0.0))
    return rows.select(
        "ord", F.col("taxon_id").alias("tax_id"), "name", F.col("rank_code").alias("rank"), (F.col("indent") / SPACES_PER_LEVEL).cast("int").alias("level"),
        F.col("parent_id").alias("parent_tax_id"), "parent_rank", F.col("num_fragments_clade").alias("clade_count"), F.col("num_fragments_direct").alias("direct_count"), below.alias("descendant_count"),
        share(F.col("num_fragments_clade")).alias("frac_clade"), share(F.col("num_fragments_direct")).alias("frac_direct"), share(below).alias("frac_descendant"), "minimizer_count", "distinct_minimizer_count",
    )


def plain_number(x: Column) -> Column:
    """A double as text without exponent or trailing zeros: 1, 0.5, 0.0000005."""
    text = x.cast("string")
    plain = F.when(text.contains("E"), F.regexp_replace(F.format_string("%.20f", x), r"\.?0+$", "")).otherwise(F.regexp_replace(text, r"\.0$", ""))
    return plain
