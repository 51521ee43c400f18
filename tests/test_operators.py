"""Vectors of the operators, with the errors."""

import pytest
from pyspark.sql import functions as F

from cladeframe.operators import assignments as asg
from cladeframe.operators import classify, nrevert, pairing, taxonomy
from cladeframe.operators.report import flat_report, plain_number

LINES = "value string, ord long"


def report(spark, *rows):
    return taxonomy.parse_report(spark.createDataFrame([(r, k) for k, r in enumerate(rows)], LINES))


def test_assignment_lines(spark):
    rows = spark.createDataFrame([("C\tread1\t9606\t150\t9606:10",), ("U\tread2\t0\t100\t0:70",), ("C\tread3/1\t9606\t150\t9606:75",), ("  ",), ("C\tread3/2\t9606\t1\tx",)], "value string")
    got = sorted(tuple(r) for r in asg.parse_assignments(rows).collect())
    assert got == [("C", "read1", 9606), ("C", "read3", 9606), ("C", "read3", 9606), ("U", "read2", 0)]
    assert asg.collapse(asg.parse_assignments(rows)).count() == 3


@pytest.mark.parametrize("line", ["X\ta\t1\t1\t1", "U\ta\t9606\t1\t1", "C\ta\t0\t1\t1", "C\ta\t1\t1", "C\ta\t 12 \t1\t1", "C\ta\t4294967296\t1\t1"])
def test_bad_assignment_lines(spark, line):
    with pytest.raises(Exception, match="USER_RAISED"):
        asg.parse_assignments(spark.createDataFrame([(line,)], "value string")).collect()


def test_conflicting_assignments(spark):
    with pytest.raises(Exception, match="conflicting taxon IDs"):
        asg.collapse(spark.createDataFrame([("r", 1), ("r", 2)], "query_name string, taxon_id long")).collect()


def test_annotate_misses_fail(spark):
    rows = spark.createDataFrame([("r1", []), (None, [])], "qname string, tags array<struct<tag:string,type:string,value:string>>")
    side = spark.createDataFrame([("r1", 7)], "query_name string, taxon_id long")
    assert {r.qname: [t.value for t in r.tags] for r in asg.annotate(rows, side).collect()} == {"r1": ["7"], None: []}
    with pytest.raises(Exception, match="not present in the assignments"):
        asg.annotate(rows, side.where("false")).collect()


def test_tree_and_flat_report(spark):
    rows = report(spark, "  2.44\t50\t50\tU\t0\tunclassified", " 97.56\t2000\t0\tR\t1\troot", " 97.51\t1999\t50\tD\t2\t  Bacteria", "  0.05\t1\t1\tS\t9606\t    Homo sapiens")
    assert [(r.taxon_id, r.parent_id) for r in taxonomy.tree(rows).orderBy("ord").collect()] == [(1, None), (2, 1), (9606, 2)]
    flat = {r.tax_id: r for r in flat_report(rows).collect()}
    assert flat[2].frac_clade == 1999 / 2050 and flat[2].parent_rank == "R" and flat[2].descendant_count == 1949 and flat[0].parent_tax_id is None


@pytest.mark.parametrize(
    ("lines", "why"),
    [
        (("1\t1\t0\tR\t1\troot", "1\t1\t0\tD\t2\t    a", "1\t1\t0\tD\t3\t  b"), "could not find parent"),
        (("1\t1\t0\tR\t1\troot", "1\t1\t0\tD\t1\t  a"), "duplicate taxon ID"),
        (("1\t1\t0\tR\t1\t root",), "not a multiple"),
        (("1\t1\t0\tR\t1\tx\ty",), "6 or 8"),
    ],
)
def test_bad_reports(spark, lines, why):
    with pytest.raises(Exception, match=why):
        taxonomy.tree(report(spark, *lines)).collect()


def test_descendants_and_ancestors(spark):
    nodes = taxonomy.tree(report(spark, *(f"1\t1\t0\tX\t{t}\t{' ' * 2 * d}n" for t, d in ((1, 0), (2, 1), (3, 2), (4, 1), (5, 2)))))
    taxa = lambda *ids: spark.createDataFrame([(i,) for i in ids], "taxon_id long")
    ids = lambda df: sorted(r.taxon_id for r in df.collect())
    assert ids(taxonomy.descendants(nodes, taxa(1))) == [2, 3, 4, 5] and ids(taxonomy.descendants(nodes, taxa(4))) == [5] and ids(taxonomy.descendants(nodes, taxa(77))) == []
    assert ids(taxonomy.ancestors(nodes, taxa(5))) == [1, 4]
    assert ids(taxonomy.target_set(nodes, taxa(2), True, True)) == [0, 2, 3]
    assert {r.taxon_id: r.subtree_end for r in taxonomy.intervals(nodes).where("taxon_id in (2, 3)").collect()} == {2: 3, 3: 3}
    with pytest.raises(ValueError, match="taxonomy tree"):
        taxonomy.check_targets(nodes, [0, 99])


P, SUPP, SEC = 65, 2113, 321
TEMPLATES = [
    ([(P, 9606), (129, 1234)], {}, "OnTaxa"), ([(P, 1234), (SUPP, 9606)], {}, "Reject"), ([(P, 1234), (SEC, 9606)], {}, "Reject"), ([(P, 1234), (129, 1234)], {"within": True}, "EditRescue"), ([(P, 1234), (129, 5678)], {}, "Reject"),
    ([(P, None), (129, None)], {"keep": True}, "UnannotatedKeep"), ([(P, None), (129, None)], {"keep": True, "within": True}, "UnannotatedKeep"), ([(P, None), (129, None)], {"within": True}, "Reject"), ([(P, 1234), (129, None)], {"keep": True}, "Reject"),
    ([(SUPP, 9606)], {"keep": True}, "UnannotatedKeep"), ([(SUPP, 9606)], {}, "Reject"),
]


@pytest.mark.parametrize(("records", "options", "decision"), TEMPLATES)
def test_templates(spark, records, options, decision):
    rows = spark.createDataFrame([("t", f, x) for f, x in records], "q string, flag int, taxon long")
    marked = classify.mark_taxa(rows, F.col("taxon"), spark.createDataFrame([(9606,)], "taxon_id long"))
    got = classify.decide_templates(marked, "q", "taxon", F.lit(options.get("within", False)), options.get("keep", False)).first()
    assert got.decision == decision and got.n_records == len(records)


def test_pairs(spark):
    reads = spark.createDataFrame([(0, "p/1", "AA"), (1, "p/2", "CC")], "ord long, name string, seq string")
    assert tuple(pairing.interleaved_pairs(reads).first()) == (0, "p", "AA", "CC")
    with pytest.raises(Exception, match="odd number"):
        pairing.interleaved_pairs(reads.limit(1)).collect()
    with pytest.raises(Exception, match="no pair"):
        pairing.interleaved_pairs(reads.withColumn("name", F.concat("name", F.col("ord").cast("string")))).collect()
    with pytest.raises(Exception, match="unequal record counts"):
        bare = reads.withColumn("name", F.lit("p"))
        pairing.zip_pairs(bare, bare.where("ord = 0")).collect()
    assert pairing.is_interleaved(["a/1", "a/2"]) and pairing.is_interleaved(["a", "a"]) and not pairing.is_interleaved(["a", "a"], False) and not pairing.is_interleaved(["a", "b"])
    with pytest.raises(ValueError):
        pairing.is_interleaved(["a/2"])


def test_grouped_templates(spark):
    rows = lambda *x: spark.createDataFrame([(k, "q", f, s) for k, (f, s) in enumerate(x)], "ord long, qname string, flag int, seq string")
    assert tuple(pairing.grouped_templates(rows((129 | 16, "AACC"), (65, "GG"), (65 | 256, "T"))).first())[1:] == ("q", "GG", "GGTT")
    assert tuple(pairing.grouped_templates(rows((1, "A"), (1, "C"))).first())[2:] == ("A", "C")
    for bad, why in ((((65, "A"), (65, "C")), "two R1"), (((129, "A"), (129, "C")), "two R2"), (((129, "A"),), "without an R1"), (((1, "A"), (1, "C"), (1, "G")), "more than two")):
        with pytest.raises(Exception, match=why):
            pairing.grouped_templates(rows(*bad)).collect()


def test_revert_over_chunks(spark):
    ref = spark.createDataFrame([("chr1", "ACGTACGTAC"), ("chr2", "A")], "contig string, seq string")
    schema = "ord long, qname string, flag int, rname string, pos int, cigar string, seq string, qual string"
    rows = spark.createDataFrame([(0, "a", 0, "chr1", 3, "6M", "NNNNNN", "IIIIII"), (1, "b", 4, None, None, None, "NN", "II"), (2, "c", 0, "chr1", 9, "4M", "NNNN", "IIII")], schema)
    got = {r.ord: (r.seq, r.converted, r.qual) for r in nrevert.revert_n_calls(rows, ref, 0, chunk=4).collect()}
    assert got == {0: ("GTACGT", 6, "!!!!!!"), 1: ("NN", 0, "II"), 2: ("ACNN", 2, "!!II")}
    for bad, why in (((0, "a", 0, None, 3, "1M", "A", "I"), "no reference sequence ID"), ((0, "a", 0, "chr1", None, "1M", "A", "I"), "no alignment start"), ((0, "a", 0, "chrX", 1, "1M", "A", "I"), "not found")):
        with pytest.raises(Exception, match=why):
            nrevert.revert_n_calls(spark.createDataFrame([bad], schema), ref).collect()


def test_plain_numbers(spark):
    rows = spark.createDataFrame([(1.0,), (0.0,), (0.5,), (5e-7,), (0.9751219512195122,)], "x double")
    assert [r[0] for r in rows.select(plain_number(F.col("x"))).collect()] == ["1", "0", "0.5", "0.0000005", "0.9751219512195122"]


def test_runs_over_chunks(spark, monkeypatch):
    given = [None, None, "a", "a", "b", "b", "b", "b", "b", "b", "a", None, "a", "a", "c"]
    rows = spark.createDataFrame([(7 * k % 15, given[7 * k % 15]) for k in range(15)] + [(90, "c"), (91, "d")], "ord long, qname string")
    for chunk in (1, 2, 4, 1 << 20):
        monkeypatch.setattr(pairing, "RUN_CHUNK", chunk)
        got = [tuple(r) for r in pairing.runs(rows).orderBy("ord").select("ord", "qname", "run").collect()]
        want, n = [], 0
        for k, (at, name) in enumerate([*enumerate(given), (90, "c"), (91, "d")]):
            n += k == 0 or name != want[-1][1]
            want.append((at, name, n))
        assert got == want
    assert pairing.runs(rows.where("false")).count() == 0
