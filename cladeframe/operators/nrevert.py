"""Restoring uncalled bases from a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.cigar import reference_span, reverted, with_quality
from cladeframe.functions.names import is_mapped

#: Reference bases a chunk holds.
CHUNK = 16384


def chunked(reference: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """contig, chunk, bases of a reference (contig, seq), in pieces that join by equality."""
    pieces = reference.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / chunk))))
    return pieces.select("contig", "chunk", F.substring("seq", (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk)).alias("bases"))


def revert_n_calls(records: DataFrame, reference: DataFrame, quality: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """records with aligned uncalled bases of mapped records restored, and converted, how many.

    Needs ord (unique), flag, rname, pos, cigar, seq and qual. Mapped records need a reference name that the
    reference has and a start. Only records with an uncalled base meet the reference, by (contig, chunk); the pieces
    of one record are put together by its ordinal, so neither a contig nor a hot one is ever broadcast whole.
    """
    mapped = is_mapped(F.col("flag"))
    known = reference.select(F.col("contig").alias("_contig")).distinct()
    rows = records.join(known, F.col("rname") == F.col("_contig"), "left")
    who = F.coalesce(F.col("qname"), F.lit("*")) if "qname" in records.columns else F.lit("*")
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), who)).cast("string")
    seq = (
        F.when(mapped & (F.col("rname").isNull() | (F.col("rname") == "*")), fail("mapped record has no reference sequence ID"))
        .when(mapped & F.coalesce(F.col("pos") < 1, F.lit(True)), fail("mapped record has no alignment start"))
        .when(mapped & F.col("_contig").isNull(), fail("reference sequence not found"))
        .otherwise(F.col("seq"))
    )
    rows = rows.withColumn("seq", seq).drop("_contig").withColumn("_span", F.when(mapped & F.upper("seq").contains("N"), reference_span(F.col("cigar"))))
    todo = F.coalesce(F.col("_span") > 0, F.lit(False))
    first, last = F.floor((F.col("pos") - 1) / chunk), F.floor((F.col("pos") + F.col("_span") - 2) / chunk)
    wanted = rows.where(todo).select("ord", "rname", "pos", "_span", F.explode(F.sequence(first, last)).alias("chunk"))
    pieces = wanted.join(chunked(reference, chunk).withColumnRenamed("contig", "rname"), ["rname", "chunk"])
    joined = pieces.groupBy("ord").agg(F.min(F.struct("pos", "_span")).alias("_at"), F.sort_array(F.collect_list(F.struct("chunk", "bases"))).alias("_parts"))
    whole = F.array_join(F.transform("_parts", lambda p: p["bases"]), "")
    start = (F.col("_at.pos") - F.get("_parts", F.lit(0))["chunk"] * chunk).cast("int")
    bases = joined.select(F.col("ord").alias("_ord"), F.substring(whole, start, F.col("_at._span").cast("int")).alias("_bases"))
    out = rows.join(bases, F.col("ord") == F.col("_ord"), "left").withColumn("_r", F.when(F.col("_bases").isNotNull(), reverted(F.col("seq"), F.col("cigar"), F.col("_bases"))))
    places = F.coalesce("_r.places", F.array().cast("array<int>"))
    changed = {"seq": F.coalesce("_r.seq", "seq"), "converted": F.size(places).cast("long")}
    if quality is not None:
        changed["qual"] = with_quality(F.col("qual"), places, quality)
    return out.withColumns(changed).drop("_ord", "_bases", "_r", "_span")


def revert_counters() -> list[Column]:
    """Aggregates for the rows of revert_n_calls: all records and the bases restored."""
    return [F.count("*").alias("records"), F.coalesce(F.sum("converted"), F.lit(0)).alias("converted")]
