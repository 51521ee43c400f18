"""Templates out of single reads, interleaved reads, files that go together, and grouped alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.names import checked_pair_name, checked_record_name, flag_is, forward_sequence, is_primary, with_record_suffix


#: Ordinals whose rows are walked by one task.
RUN_CHUNK = 1 << 20


def runs(rows: DataFrame, name: str = "qname", ordinal: str = "ord") -> DataFrame:
    """Adds run: consecutive rows of a name, counted from 1. For input that is only grouped by name; where equal names
    are contiguous by contract, group by the name instead, which needs no order.

    Rows are walked in chunks of RUN_CHUNK ordinals; one row a chunk, its end names and its changes, tells where the
    count of the next one starts.
    """
    order = Window.partitionBy("_chunk").orderBy(ordinal)
    new = F.when(F.row_number().over(order) > 1, ~F.col(name).eqNullSafe(F.lag(name).over(order))).otherwise(F.lit(False)).cast("long")
    marked = rows.withColumn("_chunk", F.floor(F.col(ordinal) / RUN_CHUNK)).withColumn("_new", new)
    chunks = marked.groupBy("_chunk").agg(F.min_by(name, ordinal).alias("_head"), F.max_by(name, ordinal).alias("_tail"), F.sum("_new").alias("_changes"))
    each = Window.partitionBy(F.lit(0)).orderBy("_chunk")
    begins = F.when(F.row_number().over(each) > 1, ~F.col("_head").eqNullSafe(F.lag("_tail").over(each))).otherwise(F.lit(True)).cast("long")
    chunks = chunks.withColumn("_begins", begins)
    start = F.sum(F.col("_begins") + F.col("_changes")).over(each.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_changes")
    within = F.sum("_new").over(order)
    return marked.withColumn("_within", within).join(chunks.select("_chunk", start.alias("_start")), "_chunk").withColumn("run", F.col("_start") + F.col("_within")).drop("_chunk", "_new", "_within", "_start")


def single_templates(records: DataFrame, query_grouped: bool = False, per_record: bool = False) -> DataFrame:
    """ord, name, r1, r2 of primary alignments, one template a record, turned to the read's strand."""
    paired = flag_is(F.col("flag"), 0x1)
    name = with_record_suffix(checked_record_name(F.col("qname")), F.col("flag"))
    if not query_grouped and not per_record:
        name = F.when(paired, F.raise_error(F.lit("paired reads need input grouped by query name"))).otherwise(name)
    return records.where(is_primary(F.col("flag"))).select("ord", name.alias("name"), forward_sequence(F.col("seq"), F.col("flag")).alias("r1"), F.lit(None).cast("string").alias("r2"))


def grouped_templates(records: DataFrame, key: str = "qname") -> DataFrame:
    """ord, name, r1, r2 of primary alignments grouped by key: first segments are R1, last R2, others fill the free slot.

    Two firsts, two lasts, more than two records and an R2 alone fail. The columns of a template are picked by one
    aggregate with map-side partial states.
    """
    first, last = flag_is(F.col("flag"), 0x40), flag_is(F.col("flag"), 0x80) & ~flag_is(F.col("flag"), 0x40)
    rows = records.where(is_primary(F.col("flag"))).select(key, "ord", checked_record_name(F.col("qname")).alias("name"), forward_sequence(F.col("seq"), F.col("flag")).alias("s"), F.when(first, 1).when(last, 2).alias("slot"))
    entry = F.struct("ord", "s")
    got = rows.groupBy(key).agg(
        F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name"), F.count("*").alias("n"), F.count_if(F.col("slot") == 1).alias("n1"), F.count_if(F.col("slot") == 2).alias("n2"),
        F.min(F.when(F.col("slot") == 1, entry))["s"].alias("s1"), F.min(F.when(F.col("slot") == 2, entry))["s"].alias("s2"), F.min(F.when(F.col("slot").isNull(), entry))["s"].alias("f1"), F.max(F.when(F.col("slot").isNull(), entry))["s"].alias("f2"),
    )
    free = F.col("n") - F.col("n1") - F.col("n2")
    r1 = F.when(F.col("n1") == 1, F.col("s1")).when(free > 0, F.col("f1"))
    r2 = F.when(F.col("n2") == 1, F.col("s2")).when(F.col("n1") == 1, F.when(free > 0, F.col("f1"))).when(free == 2, F.col("f2"))
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col("name")))
    checked = (
        F.when(F.col("n") > 2, fail("more than two primary records in a template"))
        .when(F.col("n1") > 1, fail("two R1 records in a template"))
        .when(F.col("n2") > 1, fail("two R2 records in a template"))
        .when((F.col("n") == 1) & (F.col("n2") == 1), fail("R2 without an R1"))
        .otherwise(r1)
    )
    return got.select("ord", "name", checked.alias("r1"), r2.alias("r2"))


def is_interleaved(first_names: list[str], match_names: bool = True) -> bool:
    """Whether reads are pairs in turn, told by the first two names; a /2 first fails."""
    if not first_names:
        return False
    if first_names[0].endswith("/2"):
        raise ValueError("the first read of interleaved input ends in /2")
    return first_names[0].endswith("/1") or match_names and len(first_names) > 1 and first_names[0] == first_names[1]


def interleaved_pairs(reads: DataFrame, name: str = "name") -> DataFrame:
    """ord, name, r1, r2 of rows (2k, 2k+1); ord counts from 0. An odd row and names that don't pair fail."""
    rows = reads.withColumn("_k", F.floor(F.col("ord") / 2))
    entry = F.struct(F.col("ord").alias("o"), F.col(name).alias("n"), F.col("seq").alias("s"))
    got = rows.groupBy("_k").agg(F.min(entry).alias("a"), F.max(entry).alias("b"), F.count("*").alias("c"))
    base = F.when(F.col("c") == 2, checked_pair_name(F.col("a.n"), F.col("b.n"))).otherwise(F.raise_error(F.lit("odd number of interleaved reads")))
    return got.select(F.col("_k").alias("ord"), base.alias("name"), F.col("a.s").alias("r1"), F.col("b.s").alias("r2"))


def zip_pairs(first: DataFrame, second: DataFrame, name_of: Column | None = None) -> DataFrame:
    """ord, name, r1, r2 of the i-th rows of two inputs (ord, name, seq); unequal counts and names that don't pair fail."""
    a = first.select("ord", F.col("name").alias("_n1"), F.col("seq").alias("r1"))
    b = second.select("ord", F.col("name").alias("_n2"), F.col("seq").alias("r2"))
    both = a.join(b, "ord", "full_outer")
    one_sided = F.col("_n1").isNull() | F.col("_n2").isNull()
    name = F.when(one_sided, F.raise_error(F.lit("paired inputs have unequal record counts"))).otherwise(checked_pair_name(F.col("_n1"), F.col("_n2")))
    return both.select("ord", name.alias("name"), "r1", "r2")


def single_reads(reads: DataFrame) -> DataFrame:
    return reads.select("ord", "name", F.col("seq").alias("r1"), F.lit(None).cast("string").alias("r2"))


def alignment_templates(rows: DataFrame, grouped: bool, by_name: bool, per_record: bool = False) -> DataFrame:
    """Templates of alignments: put together where input is grouped by name and not taken record by record, else one a record."""
    if not grouped or per_record:
        return single_templates(rows, grouped, per_record)
    primary = rows.where(is_primary(F.col("flag")))
    return grouped_templates(primary if by_name else runs(primary), "qname" if by_name else "run")
