"""Vectors of the scalar functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladeframe.functions import cigar, names, tags

EDITS = [
    ("5A4", "10M", "ACGTACGTAC", 1, []), ("5A2G2", "10M", "ACGTACGTAC", 2, []), ("4A5", "10M", "ACGTNACGTA", 0, []), ("8", "5M2I3M", "ACGTACCGTA", 0, [2]), ("5^AC5", "5M2D5M", "ACGTAACGTA", 0, [-2]),
    ("5A4", "5S10M", "NNNNNACGTAC", 1, []), ("4A0", "5M2I3M", "ACGTANNACG", 1, [2]), ("1A2T2", "3S7M", "NNNANCGNAT", 0, []), ("2A1T2", "3S7M", "NNNAAGAGAT", 2, []), ("5A4", "10M", "NNNNACGTAC", 1, []), ("5A4", "10M", "", 0, []),
]
REVERTS = [("ANNT", "4M", "ACGTACGT", "ACGT", 2), ("AANNG", "3M2I", "AATXYZ", "AATNG", 1), ("NNACGT", "2S4M", "ACGT", "NNACGT", 0), ("NNT", "1M2D2M", "ANNGT", "AGT", 2), ("AnGT", "4M", "ACGT", "ACGT", 1), ("", "4M", "ACGT", "", 0)]


def test_edit_counts(spark):
    rows = spark.createDataFrame([(k, m, c, s) for k, (m, c, s, _, _) in enumerate(EDITS)], "k int, md string, cigar string, seq string")
    got = {r.k: r.e for r in rows.select("k", cigar.edit_counts(F.col("seq"), F.col("cigar"), F.col("md")).alias("e")).collect()}
    for k, (_, _, _, subs, indels) in enumerate(EDITS):
        assert (got[k].substitutions, got[k].indels) == (subs, indels), EDITS[k]


def test_no_md_is_null(spark):
    row = spark.createDataFrame([("4M", "ACGT")], "c string, s string").select(cigar.edit_counts(F.col("s"), F.col("c"), F.lit(None).cast("string")).alias("e"), cigar.within_edit_limits(F.col("s"), F.col("c"), F.lit(None).cast("string"), F.lit(0), 1).alias("w")).first()
    assert row.e is None and row.w is False


def test_reverted(spark):
    rows = spark.createDataFrame([(k, *x[:3]) for k, x in enumerate(REVERTS)], "k int, seq string, cigar string, ref string")
    got = {r.k: (r.r.seq, len(r.r.places)) for r in rows.select("k", cigar.reverted(F.col("seq"), F.col("cigar"), F.col("ref")).alias("r")).collect()}
    assert got == {k: (x[3], x[4]) for k, x in enumerate(REVERTS)}


def test_limits(spark):
    row = spark.createDataFrame([("NNNNAACGTA", "10M", "5A4", 0, 4)], "s string, c string, m string, f int, u int")
    args = F.col("s"), F.col("c"), F.col("m"), F.col("f")
    got = row.select(
        cigar.within_edit_limits(*args, 1, None, None, 8).alias("a"), cigar.within_edit_limits(*args, 1, None, None, 2).alias("b"), cigar.within_edit_limits(*args).alias("c0"),
        cigar.within_edit_limits(*args, None, None, None, 1).alias("d"), cigar.within_edit_limits(*args[:3], F.col("u"), 9).alias("e"),
    ).first()
    assert tuple(got) == (True, False, False, True, False)


def _walk(ops, md, seq):
    """A literal walk: places of aligned bases, then MD against them."""
    places, at = [], 0
    for n, op in ops:
        if op in "M=X":
            places += range(at, at + n)
        at += n if op in "M=XIS" else 0
    return sum(p >= len(places) or (seq[places[p] : places[p] + 1].upper() not in ("N", "")) for p in md), [n if o == "I" else -n for n, o in ops if o in "ID"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 6), st.sampled_from("MIDNSHP=X")), min_size=1, max_size=6), min_size=1, max_size=5), st.text("ACGTN", max_size=30), st.lists(st.integers(0, 4), max_size=5))
def test_edit_counts_property(spark, cigars, seq, gaps):
    md, letters, at = "", [], 0
    for g in gaps:
        md, at = f"{md}{g}A", at + g
        letters.append(at)
        at += 1
    rows = spark.createDataFrame([(k, "".join(f"{n}{o}" for n, o in c)) for k, c in enumerate(cigars)], "k int, c string")
    for r in rows.select("k", cigar.edit_counts(F.lit(seq), F.col("c"), F.lit(md + "0")).alias("e")).collect():
        assert (r.e.substitutions, r.e.indels) == _walk(cigars[r.k], letters, seq)


def test_names(spark):
    got = spark.range(1).select(
        names.strip_pair_suffix(F.lit("a/1/2")).alias("a"), names.fastq_base_name(F.lit(" r1/2\tx")).alias("b"), names.fastq_name(F.lit("r1/1 1:N:0")).alias("c"), names.fasta_name(F.lit(">>s1 desc")).alias("d"),
        names.reverse_complement(F.lit("ACGTNacgtR")).alias("e"), names.template_sequence(F.lit("acg"), F.lit("tt")).alias("f"), names.with_record_suffix(F.lit("r"), F.lit(0x41)).alias("g"), names.rank_code(F.lit("nope")).alias("h"),
    ).first()
    assert tuple(got) == ("a/1", "r1", "r1/1", "s1", "RacgtNACGT", "ACGNTT", "r/1", "--")


def test_tags(spark):
    row = spark.range(1).select(tags.parse_tags(F.lit("ti:i:5\tMD:Z:3:4")).alias("t"))
    got = row.select(tags.format_tags(tags.set_taxon(F.col("t"), F.lit(9))).alias("a"), tags.read_taxon(F.col("t")).alias("b"), tags.tag_value(F.col("t"), "MD", "Z").alias("c"), tags.read_taxon(tags.parse_tags(F.lit("ti:Z:5"))).alias("d"), tags.read_taxon(tags.parse_tags(F.lit("ti:i:-5"))).alias("e")).first()
    assert tuple(got) == ("ti:i:9\tMD:Z:3:4", 5, "3:4", None, None)
    with pytest.raises(Exception, match="32-bit"):
        row.select(tags.set_taxon(F.col("t"), F.lit(2**31))).collect()
