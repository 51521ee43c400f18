"""Decisions on reads, records and templates, and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.names import is_primary

ON_TAXA, ANCESTOR, EDIT, UNANNOTATED, REJECT = "OnTaxa", "AncestorRescue", "EditRescue", "UnannotatedKeep", "Reject"
#: The columns of the metrics in order.
METRICS = (
    "template", "on_taxa", "rescued_ancestors", "rescued_variants", "unannotated_but_kept", "num_kept", "num_filtered", "total", "frac_removed",
    "rescue_max_edit_distance", "rescue_max_indels", "rescue_max_indel_length", "rescue_n_adjustment", "missing_ti_tag", "missing_classifications",
)
RESCUE = ("rescue_max_edit_distance", "rescue_max_indels", "rescue_max_indel_length", "rescue_n_adjustment")


def mark_taxa(rows: DataFrame, taxon: Column, targets: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Adds on_target and is_ancestor by equi-joins with the target set and with its ancestors; a null taxon is neither.

    Both sides hold each taxon once, so no row multiplies. They are small as a rule; Spark broadcasts them where
    their size allows it and shuffles otherwise.
    """
    out = rows.join(targets.select(F.col("taxon_id").alias("_t"), F.lit(True).alias("_on")), taxon == F.col("_t"), "left").withColumn("on_target", F.coalesce("_on", F.lit(False))).drop("_t", "_on")
    if above is None:
        return out.withColumn("is_ancestor", F.lit(False))
    out = out.join(above.select(F.col("taxon_id").alias("_t"), F.lit(True).alias("_up")), taxon == F.col("_t"), "left")
    return out.withColumn("is_ancestor", F.coalesce("_up", F.lit(False))).drop("_t", "_up")


def decide_read(on_target: Column, is_ancestor: Column) -> Column:
    return F.when(on_target, ON_TAXA).when(is_ancestor, ANCESTOR).otherwise(REJECT)


def decide_record(taxon: Column, on_target: Column, is_ancestor: Column, within: Column, keep_unannotated: bool) -> Column:
    """An untagged record is kept or not as asked; a tagged one by taxon, then ancestor, then edits, which are only counted if it comes to that."""
    untagged = F.lit(UNANNOTATED if keep_unannotated else REJECT)
    return F.when(taxon.isNull(), untagged).when(on_target, ON_TAXA).when(is_ancestor, ANCESTOR).when(within, EDIT).otherwise(REJECT)


def decide_templates(rows: DataFrame, key: str, taxon: str, within: Column, keep_unannotated: bool) -> DataFrame:
    """key, decision, n_records, untagged: one row a template, decided on its primary records.

    rows has flag, on_target and is_ancestor. One grouped aggregate of flags, so a template of any size costs a few
    bits. Edit rescue needs a tagged primary and asks it of all; a template without primaries is unannotated.
    """
    primary, tagged = is_primary(F.col("flag")), F.col(taxon).isNotNull()
    any_ = lambda c: F.coalesce(F.bool_or(F.when(primary, c)), F.lit(False))
    flags = rows.groupBy(key).agg(
        any_(F.col("on_target")).alias("_on"),
        any_(F.col("is_ancestor")).alias("_up"),
        any_(tagged).alias("_tagged"),
        F.coalesce(F.bool_and(F.when(primary, within)), F.lit(False)).alias("_within"),
        F.count("*").alias("n_records"),
        F.bool_or(~tagged).alias("untagged"),
    )
    decision = (
        F.when(F.col("_on"), ON_TAXA).when(F.col("_up"), ANCESTOR).when(F.col("_tagged") & F.col("_within"), EDIT).when(~F.col("_tagged") & F.lit(keep_unannotated), UNANNOTATED).otherwise(REJECT)
    )
    return flags.select(key, decision.alias("decision"), "n_records", "untagged")


def _finish(counts: DataFrame, limits: dict, keep_unannotated: bool, kind: str) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    kept = zero("on_taxa") + zero("rescued_ancestors") + zero("rescued_variants") + (zero("unannotated_but_kept") if keep_unannotated else F.lit(0))
    rows = counts.withColumns({"num_kept": kept.cast("long"), "num_filtered": (zero("total") - kept).cast("long")})
    rows = rows.withColumn("frac_removed", F.when(F.col("total") > 0, F.col("num_filtered") / F.col("total")).otherwise(F.lit(0.0)))
    for name in RESCUE:
        rows = rows.withColumn(name, F.lit(limits.get(name) if kind == "alignment" else None).cast("long"))
    return rows.select(*METRICS)


def read_metrics(rows: DataFrame, records: Column) -> DataFrame:
    """One row for reads with decision and missing; records is how many reads a row stands for. Misses count rows, the rest reads."""
    count = lambda d: F.coalesce(F.sum(F.when(F.col("decision") == d, records)), F.lit(0)).cast("long")
    none = F.lit(None).cast("long")
    counts = rows.agg(
        count(ON_TAXA).alias("on_taxa"), count(ANCESTOR).alias("rescued_ancestors"), F.coalesce(F.sum(records), F.lit(0)).cast("long").alias("total"), F.count_if("missing").alias("missing_classifications")
    )
    counts = counts.withColumns({"template": F.lit(False), "rescued_variants": none, "unannotated_but_kept": none, "missing_ti_tag": none})
    return _finish(counts, {}, False, "reads")


def _alignment_counts(rows: DataFrame, weight: Column, untagged: Column, template: bool) -> DataFrame:
    count = lambda d: F.coalesce(F.sum(F.when(F.col("decision") == d, weight)), F.lit(0)).cast("long")
    return rows.agg(
        F.lit(template).alias("template"), count(ON_TAXA).alias("on_taxa"), count(ANCESTOR).alias("rescued_ancestors"), count(EDIT).alias("rescued_variants"), count(UNANNOTATED).alias("unannotated_but_kept"),
        F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("total"), F.coalesce(F.sum(untagged.cast("long")), F.lit(0)).alias("missing_ti_tag"), F.lit(None).cast("long").alias("missing_classifications"),
    )


def record_metrics(rows: DataFrame, taxon: Column, limits: dict | None = None, keep_unannotated: bool = False) -> DataFrame:
    """One row for records with decision."""
    return _finish(_alignment_counts(rows, F.lit(1), taxon.isNull(), False), limits or {}, keep_unannotated, "alignment")


def template_metrics(templates: DataFrame, untagged_records: DataFrame, limits: dict | None = None, keep_unannotated: bool = False) -> DataFrame:
    """Two rows: records, then templates. untagged_records has one row, n."""
    records = _alignment_counts(templates, F.col("n_records"), F.lit(False), False).drop("missing_ti_tag").join(F.broadcast(untagged_records.select(F.col("n").alias("missing_ti_tag"))))
    both = records.unionByName(_alignment_counts(templates, F.lit(1), F.col("untagged"), True))
    return _finish(both, limits or {}, keep_unannotated, "alignment")
