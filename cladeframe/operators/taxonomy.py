"""Reports as trees: parents, intervals, descendants, ancestors and target sets.

A report is ord, indent, taxon_id and more; row order is data, so every operator goes by ord. A report has at most
as many rows as a taxonomy has taxa (a few million), whatever the reads are, so its windows may run in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACES_PER_LEVEL = 2


def parse_report(lines: DataFrame, column: str = "value") -> DataFrame:
    """Report entries of tab-separated lines with 6 or 8 columns; lines has ord. Blank lines are skipped, bad ones fail."""
    part = F.split(F.col(column), "\t", -1)
    wide = F.size(part) == 8
    at = lambda narrow, broad: F.when(wide, F.get(part, F.lit(broad))).otherwise(F.get(part, F.lit(narrow)))
    fail = lambda why: F.raise_error(F.concat(F.lit("line "), (F.col("ord") + 1).cast("string"), F.lit(f": {why}: "), F.col(column)))
    number = lambda x, what: F.coalesce(F.trim(x).try_cast("long"), fail(f"invalid {what}"))
    name = at(5, 7)
    indent = F.length(F.regexp_extract(name, "^( *)", 1))
    rows = lines.where(F.trim(F.regexp_replace(column, r"\s", " ")) != "")
    return rows.select(
        "ord",
        F.when(F.size(part).isin(6, 8), F.trim(F.get(part, F.lit(0))).try_cast("double")).otherwise(fail("expected 6 or 8 columns")).alias("pct_fragments"),
        number(F.get(part, F.lit(1)), "clade count").alias("num_fragments_clade"),
        number(F.get(part, F.lit(2)), "direct count").alias("num_fragments_direct"),
        F.trim(at(3, 5)).alias("rank_code"),
        F.when(F.size(part).isin(6, 8), number(at(4, 6), "taxon ID")).otherwise(fail("expected 6 or 8 columns")).alias("taxon_id"),
        F.trim(name).alias("name"),
        F.when(indent % SPACES_PER_LEVEL == 0, indent).otherwise(fail(f"indent is not a multiple of {SPACES_PER_LEVEL}")).alias("indent"),
        F.when(wide, number(F.get(part, F.lit(3)), "minimizer count")).alias("minimizer_count"),
        F.when(wide, number(F.get(part, F.lit(4)), "distinct minimizer count")).alias("distinct_minimizer_count"),
    )


def _all_rows() -> Window:
    return Window.partitionBy(F.lit(0)).orderBy("ord")


def tree(report: DataFrame) -> DataFrame:
    """ord, taxon_id, level, parent_id of the taxa but 0; the first is the root.

    A row's parent is the last row that opened its level: the one before the first deeper row of that depth. A row
    without one fails, as a second root does, and so does a taxon that stands twice.
    """
    rows = report.where("taxon_id <> 0").withColumn("_before", F.lag("indent").over(_all_rows())).withColumn("_taxon", F.lag("taxon_id").over(_all_rows()))
    rows = rows.withColumn("_opener", F.when(F.col("indent") > F.col("_before"), F.col("_taxon")))
    rows = rows.withColumn("_parent", F.last("_opener", ignorenulls=True).over(Window.partitionBy("indent").orderBy("ord")))
    twice = F.count("*").over(Window.partitionBy("taxon_id")) > 1
    name = F.col("taxon_id").cast("string")
    parent = (
        F.when(twice, F.raise_error(F.concat(F.lit("duplicate taxon ID "), name)))
        .when(F.col("_before").isNull(), F.lit(None).cast("long"))
        .otherwise(F.coalesce("_parent", F.raise_error(F.concat(F.lit("could not find parent of taxon "), name)).cast("long")))
    )
    return rows.select("ord", "taxon_id", (F.col("indent") / SPACES_PER_LEVEL).cast("int").alias("level"), parent.alias("parent_id"))


def nearest_parents(report: DataFrame) -> DataFrame:
    """Adds parent_id and parent_rank as flat reports have them: of the nearest row before of smaller indent; null for roots.

    A row stands for each deeper level as what may be a parent there; a row's parent is the last one before it.
    """
    rows = report.withColumn("_deepest", F.max("indent").over(Window.partitionBy(F.lit(0))))
    entry = F.struct("ord", "taxon_id", "rank_code")
    later = F.sequence(F.col("indent") + SPACES_PER_LEVEL, F.greatest(F.col("indent"), F.col("_deepest")) + SPACES_PER_LEVEL, F.lit(SPACES_PER_LEVEL))
    opened = rows.select("ord", F.explode(later).alias("indent"), entry.alias("_p"))
    none = F.lit(None).cast("struct<ord:bigint,taxon_id:bigint,rank_code:string>")
    both = opened.withColumn("_asks", F.lit(False)).unionByName(rows.select("ord", "indent", none.alias("_p"), F.lit(True).alias("_asks")))
    before = Window.partitionBy("indent").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_p", F.last("_p", ignorenulls=True).over(before)).where("_asks").select("ord", "_p")
    return report.join(found, "ord").withColumns({"parent_id": F.col("_p.taxon_id"), "parent_rank": F.col("_p.rank_code")}).drop("_p")


def intervals(nodes: DataFrame) -> DataFrame:
    """Adds subtree_end: taxa below a row are those with ord < x < subtree_end.

    Rows of a well-formed report are in pre-order, so a subtree ends at the next row of no deeper level. A row ends
    the subtrees of its level and of all deeper ones, so each stands once for each of these levels, and a row's end
    is the next one at its level.
    """
    all_ = Window.partitionBy(F.lit(0))
    rows = nodes.withColumn("_deepest", F.max("level").over(all_)).withColumn("_last", F.max("ord").over(all_))
    at = rows.withColumn("_at", F.explode(F.sequence(F.col("level"), F.col("_deepest"))))
    ends = at.withColumn("_end", F.lead("ord").over(Window.partitionBy("_at").orderBy("ord"))).where("_at = level")
    return ends.withColumn("subtree_end", F.coalesce("_end", F.col("_last") + 1)).drop("_at", "_deepest", "_last", "_end")


#: Ordinals of a bucket by which subtrees meet the rows inside them.
_BUCKET = 4096


def descendants(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """target, taxon_id: the strict descendants of the given taxa (taxon_id), as the rows inside their intervals.

    Intervals and rows meet by an equi-join on buckets of ordinals, whatever the depth of the tree is.
    """
    within = intervals(nodes).join(taxa.select("taxon_id").distinct(), "taxon_id").select(F.col("taxon_id").alias("target"), F.col("ord").alias("_from"), F.col("subtree_end").alias("_to"))
    within = within.where(F.col("_to") > F.col("_from") + 1)
    spread = within.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("_from") + 1) / _BUCKET), F.floor((F.col("_to") - 1) / _BUCKET))))
    rows = nodes.select("ord", "taxon_id", F.floor(F.col("ord") / _BUCKET).alias("_bucket"))
    return spread.join(rows, "_bucket").where((F.col("ord") > F.col("_from")) & (F.col("ord") < F.col("_to"))).select("target", "taxon_id")


def ancestors(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """taxon_id: the strict ancestors of any of the given taxa, once each, so that records meet them by an equi-join.

    A row is one if a target stands inside its interval: targets up to its end, less those up to itself.
    """
    marked = intervals(nodes).join(taxa.select("taxon_id").distinct().withColumn("_hit", F.lit(1)), "taxon_id", "left")
    upto = marked.withColumn("_upto", F.sum(F.coalesce("_hit", F.lit(0))).over(_all_rows().rowsBetween(Window.unboundedPreceding, 0)))
    ends = nodes.select("ord", F.coalesce(F.lead("ord").over(_all_rows()), F.col("ord") + 1).alias("subtree_end"))
    last = upto.select("ord", F.col("_upto").alias("_all")).join(ends, "ord").select("subtree_end", "_all")
    return upto.join(last, "subtree_end").where(F.col("_all") > F.col("_upto")).select("taxon_id")


def contains(nodes: DataFrame, taxon_id: int) -> bool:
    """Whether the tree has a taxon."""
    return not nodes.where(F.col("taxon_id") == taxon_id).isEmpty()


def children_of(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """parent_id, taxon_id: the direct children of the given taxa (taxon_id), in the order of the report by ord."""
    return nodes.join(taxa.select(F.col("taxon_id").alias("parent_id")).distinct(), "parent_id").select("parent_id", "taxon_id", "ord")


def unknown_targets(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """taxon_id: targets but 0 that the tree doesn't have."""
    return taxa.where("taxon_id <> 0").select("taxon_id").distinct().join(nodes.select("taxon_id"), "taxon_id", "left_anti")


def check_targets(nodes: DataFrame, taxon_ids: list[int]) -> None:
    """With a tree, each target but 0 must be in it."""
    taxa = nodes.sparkSession.createDataFrame([(t,) for t in sorted(set(taxon_ids))], "taxon_id long")
    if missing := sorted(r[0] for r in unknown_targets(nodes, taxa).collect()):  # a part of what the user gave
        raise ValueError(f"taxon IDs not found in the taxonomy tree: {missing}")


def duplicate_taxa(report: DataFrame) -> DataFrame:
    """taxon_id, n: taxa but 0 that stand more than once, for which tree() fails."""
    return report.where("taxon_id <> 0").groupBy("taxon_id").agg(F.count("*").alias("n")).where("n > 1")


def target_set(nodes: DataFrame | None, taxa: DataFrame, include_descendants: bool = False, include_unclassified: bool = False) -> DataFrame:
    """taxon_id: the targets, with what is below them and with 0 if asked for."""
    out = taxa.select(F.col("taxon_id").cast("long").alias("taxon_id"))
    if include_descendants:
        if nodes is None:
            raise ValueError("including descendants needs a taxonomy tree")
        out = out.union(descendants(nodes, out).select("taxon_id"))
    if include_unclassified:
        out = out.union(taxa.sparkSession.range(1).select(F.lit(0).cast("long").alias("taxon_id")))
    return out.distinct()


def node_count(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n_taxa"))
