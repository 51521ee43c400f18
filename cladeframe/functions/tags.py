"""Optional alignment tags: an ordered array of struct<tag, type, value>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = "array<struct<tag:string,type:string,value:string>>"


def parse_tags(text: Column) -> Column:
    """Tags of the tab-separated rest of a SAM line."""
    part = lambda x: F.split(x, ":", 3)
    each = F.transform(F.split(text, "\t"), lambda x: F.struct(F.get(part(x), F.lit(0)).alias("tag"), F.get(part(x), F.lit(1)).alias("type"), F.get(part(x), F.lit(2)).alias("value")))
    return F.when(text.isNull() | (text == ""), F.array().cast(TAGS)).otherwise(each.cast(TAGS))


def format_tags(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.concat_ws(":", t["tag"], t["type"], t["value"])), "\t")


def tag_value(tags: Column, tag: str, kind: str) -> Column:
    return F.get(F.filter(tags, lambda t: (t["tag"] == tag) & (t["type"] == kind)), F.lit(0))["value"]


def read_taxon(tags: Column) -> Column:
    """The ti tag as a long; null where it is missing, no integer or negative."""
    n = tag_value(tags, "ti", "i").try_cast("long")
    return F.when(n >= 0, n)


def set_taxon(tags: Column, taxon: Column) -> Column:
    """The tags with ti set, in its place if it was there, else last; a taxon beyond 32 signed bits fails."""
    text = F.when(taxon <= 2147483647, taxon.cast("string")).otherwise(F.raise_error(F.lit("taxon ID does not fit into a 32-bit tag")))
    value = F.struct(F.lit("ti").alias("tag"), F.lit("i").alias("type"), text.alias("value"))
    has = F.exists(tags, lambda t: t["tag"] == "ti")
    return F.when(has, F.transform(tags, lambda t: F.when(t["tag"] == "ti", value).otherwise(t))).otherwise(F.concat(tags, F.array(value)))
