"""The commands, file to file."""

import gzip
import random
import struct

import pytest

from cladeframe.plans import commands
from cladeframe.plans.cli import _parser, main
from cladeframe.sources import bam, bgzf, embedded, taxonomy_files, text

SAM = "@HD\tVN:1.6\tSO:queryname\n@SQ\tSN:chr1\tLN:100\n"


def write(path, content):
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(content)
    return str(path)


def sam(*rows):
    return SAM + "".join(f"{q}\t{f}\t{r}\t{p}\t60\t{c}\t*\t0\t0\t{s}\t{'I' * len(s)}{t}\n" for q, f, r, p, c, s, t in rows)


@pytest.mark.parametrize("zipped", ["", ".gz"])
def test_prep_paired_fastq(spark, tmp_path, zipped):
    a, b = write(tmp_path / f"a.fq{zipped}", "@p1/1\nAAAA\n+\nIIII\n"), write(tmp_path / f"b.fq{zipped}", "@p1/2\nTTTT\n+\nIIII\n")
    commands.run_prep(spark, [a, b], str(tmp_path / "o.fa"))
    assert (tmp_path / "o.fa").read_text() == ">p1\nAAAANTTTT\n"


def test_prep_interleaved_and_single(spark, tmp_path):
    commands.run_prep(spark, [write(tmp_path / "i.fa", ">x/1 d\nAC\nGT\n>x/2\nTT\n")], str(tmp_path / "o.fa"))
    assert (tmp_path / "o.fa").read_text() == ">x\nACGTNTT\n"
    commands.run_prep(spark, [write(tmp_path / "s.fq", "@r1/1\nac\n+\nII\n@r2\ntt\n+\nII\n")], str(tmp_path / "p.fa"), per_record=True)
    assert (tmp_path / "p.fa").read_text() == ">r1/1\nAC\n>r2\nTT\n"


def test_prep_sniffs_gzip_without_extension(spark, tmp_path):
    with gzip.open(tmp_path / "reads", "wt") as f:
        f.write("@r1\nACGT\n+\nIIII\n")
    commands.run_prep(spark, [str(tmp_path / "reads")], str(tmp_path / "o.fa"))
    assert (tmp_path / "o.fa").read_text() == ">r1\nACGT\n"


def test_annotate_then_filter_bam(spark, tmp_path):
    source = write(tmp_path / "a.sam", sam(("r1", 0, "chr1", 1, "4M", "ACGT", "\tMD:Z:4"), ("r2", 0, "chr1", 2, "4M", "ACGT", "\tMD:Z:0A3"), ("r3", 4, "*", 0, "*", "AC", "")))
    calls = write(tmp_path / "c.txt", "C\tr1\t9606\t1\tx\nC\tr2\t7\t1\tx\nU\tr3\t0\t1\tx\n")
    report = write(tmp_path / "r.txt", "1\t3\t0\tR\t1\troot\n1\t2\t1\tS\t9606\t  Homo\n1\t1\t1\tS\t7\t  Other\n")
    tagged = str(tmp_path / "t.bam")
    commands.run_annotate(spark, source, tagged, calls, report=report)
    header, rows = bam.read_bam(spark, tagged)
    assert any(h.startswith("@CO\tkrak:report:1/1:") for h in header) and [r.tags[-1].value for r in rows.orderBy("ord").collect()] == ["9606", "7", "0"]
    kept, gone = str(tmp_path / "k.sam"), str(tmp_path / "g.sam")
    got = commands.run_filter(spark, [tagged], [kept], commands.FilterOptions([9606], rescue_max_edit_distance=1), [gone], metrics=str(tmp_path / "m.tsv"))
    assert [(r.template, r.on_taxa, r.rescued_variants, r.num_kept, r.total) for r in got] == [(False, 1, 1, 2, 3), (True, 1, 1, 2, 3)]
    assert [x.split("\t")[0] for x in open(kept) if x[0] != "@"] == ["r1", "r2"] and [x.split("\t")[0] for x in open(gone) if x[0] != "@"] == ["r3"]
    assert open(tmp_path / "m.tsv").read().splitlines()[1].split("\t")[:9] == ["false", "1", "0", "1", "0", "2", "1", "3", "0.3333333333333333"]


def test_bam_splits(spark, tmp_path):
    draw = random.Random(4)
    header = ["@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:100000", "@SQ\tSN:chr2\tLN:5000"]
    data, refs = bam.encode_header(header)
    rows = []
    for k in range(5000):
        n = draw.choice((0, 1, 50, 151, 151, 151, 3000 if k % 50 else 150000))
        one = {"qname": f"read:{k}", "flag": draw.choice((0, 4, 16)), "rname": draw.choice((None, "chr1", "chr2")), "pos": draw.choice((None, 1, 777)), "mapq": 60, "cigar": f"{n}M" if n else None, "rnext": "*", "pnext": 0, "tlen": 0}
        rows.append(one | {"seq": "".join(draw.choices("ACGTN", k=n)), "qual": "".join(chr(33 + draw.randrange(40)) for _ in range(n)) or None, "tags": [{"tag": "ti", "type": "i", "value": str(k)}]})
    data += b"".join(bam.encode_record(r, refs) for r in rows)
    path = tmp_path / "a.bam"
    path.write_bytes(bam.deflate(data))
    want = [r[1:3] + r[10:12] for r in bam.records(data)]
    for size in ("300000", "128MB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            lines, got = bam.read_bam(spark, str(path))
            assert got.rdd.getNumPartitions() > (size != "128MB") * 4
            assert lines == header and [tuple(r) for r in got.orderBy("ord").select("qname", "flag", "seq", "qual").collect()] == want
            path.with_name("cut.bam").write_bytes(bam.deflate(data[:-7]))
            with pytest.raises(Exception, match="truncated|does not end"):
                bam.read_bam(spark, str(path.with_name("cut.bam")))[1].count()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    path.write_bytes(gzip.compress(data))  # one stream, no blocks
    assert [r[1:3] + r[10:12] for r in map(tuple, bam.read_bam(spark, str(path))[1].orderBy("ord").collect())] == [r[1:3] + r[10:12] for r in bam.records(data)]


def test_bam_index(spark, tmp_path):
    draw = random.Random(8)
    places = sorted((draw.randrange(2), draw.randrange(60000)) for _ in range(3000))
    body = "".join(f"r{k}\t{(0, 16, 4)[k % 3]}\tc{ref}\t{pos + 1}\t60\t60M20000N40M\t*\t0\t0\t{''.join(draw.choices('ACGT', k=100))}\t*\n" for k, (ref, pos) in enumerate(places))
    source = write(tmp_path / "a.sam", "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:c0\tLN:90000\n@SQ\tSN:c1\tLN:90000\n@SQ\tSN:c2\tLN:9\n" + body + "u\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n")
    header, rows, _ = commands.read_alignments(spark, source)
    path = tmp_path / "a.bam"
    commands.write_alignments(rows, header, str(path))
    data, raw = (tmp_path / "a.bam.bai").read_bytes(), path.read_bytes()
    at = 4

    def take(form):
        nonlocal at
        at += struct.calcsize(form)
        return struct.unpack_from(form, data, at - struct.calcsize(form))

    def read(begin, end):
        """Names, and places, of the records between two virtual offsets."""
        whole = lambda v: len(bam.inflate(raw[: v >> 16])) + (v & 65535)
        a, b = whole(begin), whole(end)
        flat = bam.inflate(raw)
        while a < b:
            one, a = bam.record(flat, a, ["c0", "c1", "c2"])
            yield one[0], one[2], one[3] - 1

    assert data[:4] == b"BAI\x01" and take("<i") == (3,)
    counts = []
    for ref in range(3):
        bins = {}
        for _ in range(take("<i")[0]):
            bin_, n = take("<Ii")
            bins[bin_] = [take("<QQ") for _ in range(n)]
        linear = take(f"<{take('<i')[0]}Q")
        counts.append(bins.pop(37450, [0, (0, 0)])[1])
        got = {b: {name for c in chunks for name, *_ in read(*c)} for b, chunks in bins.items()}
        for k, (r, pos) in enumerate(places):
            if r == ref:
                assert f"r{k}" in got[bam._bin(pos, pos + 20100)]
        for w in range(0, len(linear), 2):
            first = next(read(linear[w], linear[w] + 1), None)
            reach = min(p for r, p in places if r == ref and p >> 14 <= w <= (p + 20099) >> 14)
            assert first[1:] == (f"c{ref}", reach)
    assert counts == [tuple(sum(r == ref and (k % 3 == 2) == un for k, (r, _) in enumerate(places)) for un in (False, True)) for ref in range(3)] and take("<Q") == (1,) and at == len(data)
    commands.write_alignments(rows, ["@HD\tVN:1.6", *header[1:]], str(tmp_path / "b.bam"))
    assert not (tmp_path / "b.bam.bai").exists()


def test_filter_reads(spark, tmp_path):
    reads = write(tmp_path / "r.fq", "".join(f"@{n}\nAC\n+\nII\n" for n in ("a x", "b", "c")))
    calls = write(tmp_path / "c.txt", "C\ta\t5\t1\tx\nC\tb\t6\t1\tx\nC\tz\t6\t1\tx\n")
    got = commands.run_filter(spark, [reads], [str(tmp_path / "o.fq")], commands.FilterOptions([5]), classifications=calls)
    assert (got[0].on_taxa, got[0].total, got[0].missing_classifications) == (1, 3, 1) and open(tmp_path / "o.fq").read() == "@a x\nAC\n+\nII\n"
    with pytest.raises(ValueError, match="--classifications"):
        commands.run_filter(spark, [reads], ["x"], commands.FilterOptions([5]))
    with pytest.raises(ValueError, match="taxonomy tree"):
        commands.run_filter(spark, [reads], ["x"], commands.FilterOptions([5], include_descendants=True), classifications=calls)
    with pytest.raises(ValueError, match="must be >= 1"):
        commands.FilterOptions([5], rescue_n_adjustment=0)


def test_n2ref_and_report(spark, tmp_path):
    ref = write(tmp_path / "ref.fa", ">chr1\nACGT\n")
    write(tmp_path / "ref.fa.fai", "chr1\t4\t6\t4\t5\n")
    commands.run_n2ref(spark, write(tmp_path / "a.sam", sam(("r", 0, "chr1", 1, "4M", "ANNT", ""))), str(tmp_path / "o.sam"), ref, 2)
    assert open(tmp_path / "o.sam").read().splitlines()[-1].split("\t")[9:11] == ["ACGT", "I##I"]
    commands.run_report2tsv(spark, write(tmp_path / "r.txt", "100.00\t2000\t0\tR\t1\troot\n100.00\t2000\t0\tD\t2\t  Bacteria\n"), str(tmp_path / "o.tsv"))
    assert open(tmp_path / "o.tsv").read().splitlines()[1:] == ["1\troot\tR\t0\t\t\t2000\t0\t2000\t1\t0\t1\t\t", "2\tBacteria\tD\t1\t1\tR\t2000\t0\t2000\t1\t0\t1\t\t"]


def test_sniffing():
    F = text.Format
    assert [text.sniff_bytes(x) for x in (b"BAM\x01", b"CRAM", b">a", b"@r1\nAC", b"@HD\tVN:1\n", b"@HD\t", b"x")] == [F.BAM, F.CRAM, F.FASTA, F.FASTQ, F.SAM, F.SAM, F.UNKNOWN]
    assert [text.infer_format(x) for x in ("a.FQ.gz", "a.fasta", "a.bam", "a", "/dev/stdin")] == [F.FASTQ, F.FASTA, F.BAM, F.SAM, F.BAM]
    assert text.is_query_grouped(["@HD\tVN:1\tGO:query"]) and not text.is_query_grouped(["@HD\tVN:1\tSO:coordinate"]) and text.is_coordinate_sorted(["@HD\tSO:coordinate"])


def test_embedded_reports():
    entries = [dict(zip(embedded.KEYS, (1.5, 3, 1, "S", k, "n" * 40, 2, None, None), strict=True)) for k in range(2000)]
    comments = embedded.to_comments(entries)
    lines = [f"@CO\t{c}" for c in comments]
    assert len(lines) > 1 and embedded.from_header(lines[::-1]) == entries and embedded.from_header(["@CO\tother"]) is None
    for bad in (lines[1:], [*lines, lines[0]], [lines[0], lines[0].replace(f"/{len(lines)}:", "/9:")]):
        with pytest.raises(ValueError):
            embedded.from_header(bad)


def test_taxonomy_files(tmp_path):
    (tmp_path / "taxonomy").mkdir()
    write(tmp_path / "taxonomy/nodes.dmp", "1\t|\t1\t|\tno rank\t|\n10116\t|\t9989\t|\tspecies\t|\n9989\t|\t1\t|\torder\t|\n")
    write(tmp_path / "taxonomy/names.dmp", "1\t|\troot\t|\t\t|\tscientific name\t|\n9989\t|\tRodentia\t|\t\t|\tscientific name\t|\n")
    assert [(e[5], e[7], e[4], e[6]) for e in taxonomy_files.read_database(str(tmp_path))] == [(1, 0, "--", "root"), (9989, 2, "O", "Rodentia"), (10116, 4, "S", "")]
    nodes = [(0,) * 7, (0, 2, 1, 0, 0, 1, 0), (1, 3, 1, 5, 5, 0, 0), (2, 0, 0, 5, 13, 9, 0)]
    data = taxonomy_files.MAGIC + struct.pack("<3Q", 4, 9, 21) + b"".join(struct.pack("<7Q", *n) for n in nodes) + b"root\0Bac\0" + b"root\0no rank\0species\0"
    (tmp_path / "taxo.k2d").write_bytes(data)
    assert [(e[5], e[7], e[4]) for e in taxonomy_files.read_database(str(tmp_path))] == [(1, 0, "R"), (9, 2, "S")]
    for bad in (b"x" + data[1:], data[:-40], data[:8] + struct.pack("<Q", 2**63) + data[16:]):
        (tmp_path / "taxo.k2d").write_bytes(bad)
        with pytest.raises(ValueError):
            taxonomy_files.read_database(str(tmp_path))


def test_command_line():
    args = _parser().parse_args(["filter", "-i", "a.bam", "-o", "b.bam", "-t", "1", "2", "--rescue-max-indels", "3"])
    assert args.taxon_ids == [1, 2] and args.rescue_max_indels == 3
    with pytest.raises(SystemExit):
        _parser().parse_args(["n2ref", "-i", "a", "-o", "b", "-f", "r", "-q", "94"])


def test_stream(spark, tmp_path):
    from cladeframe.streaming import filter_stream

    spark.createDataFrame([("a/1",), ("b",)], "name string").write.parquet(str(tmp_path / "in"))
    side, targets = spark.createDataFrame([("a", 5)], "query_name string, taxon_id long"), spark.createDataFrame([(5,)], "taxon_id long")
    stream = filter_stream(spark.readStream.schema("name string").parquet(str(tmp_path / "in")), side, targets)
    query = stream.writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {r.name: r.decision for r in spark.table("decided").collect()} == {"a/1": "OnTaxa", "b": "Reject"}


def _run(args, stdin=b"", monkeypatch=None, capfdbinary=None):
    import io
    import sys

    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(stdin)))
    out = io.BytesIO()
    stream = io.TextIOWrapper(out, write_through=True)
    monkeypatch.setattr(sys, "stdout", stream)
    code = main(args)
    data = out.getvalue()
    monkeypatch.undo()
    return code, data


def test_standard_streams(spark, tmp_path, monkeypatch):
    calls = write(tmp_path / "c.txt", "C\tr1\t9\t4\tx\nC\tr2\t7\t4\tx\n")
    reads = gzip.compress(b"@r1 d\nACGT\n+\nIIII\n@r2\nTTTT\n+\nIIII\n")
    assert _run(["filter", "-t", "9", "-c", calls], reads, monkeypatch) == (0, b"@r1 d\nACGT\n+\nIIII\n")
    assert _run(["prep"], reads, monkeypatch) == (0, b">r1\nACGT\n>r2\nTTTT\n")
    source = sam(("r1", 0, "chr1", 1, "4M", "ACGT", ""), ("r2", 0, "chr1", 2, "4M", "ACGT", "")).replace("SO:queryname", "SO:coordinate")
    code, data = _run(["annotate", "-a", calls, "--unordered", "--threads", "2"], source.encode(), monkeypatch)
    assert code == 0 and [r[-1][0]["value"] for r in bam.records(bam.inflate(data))] == ["9", "7"] and not list(tmp_path.glob("*.bai"))
    report = b"100.00\t5\t0\tR\t1\troot\n"
    code, data = _run(["report2tsv"], report, monkeypatch)
    assert code == 0 and data.splitlines()[1].startswith(b"1\troot\tR\t0\t")
    bad = _run(["report2tsv"], b"100.00\t5\t0\tR\t1\troot\n1\t2\n", monkeypatch)
    assert bad[0] == 1


def test_places_and_flags(spark, tmp_path, monkeypatch):
    report = write(tmp_path / "r.txt", "100.00\t5\t0\tR\t1\troot\n")
    assert _run(["report2tsv", report, str(tmp_path / "o.tsv")], b"", monkeypatch)[0] == 0 and (tmp_path / "o.tsv").read_text().count("\n") == 2
    assert _run(["report2tsv", report, "-i", report], b"", monkeypatch)[0] == 1
    calls = write(tmp_path / "c.txt", "C\tr1\t9\t4\tx\n")
    reads = write(tmp_path / "a.fq", "@r1\nACGT\n+\nIIII\n" * 1 + "".join(f"@z{k}\nACGT\n+\nIIII\n" for k in range(9000)))
    kept, gone = str(tmp_path / "k.fq.gz"), str(tmp_path / "g.fq.gz")
    assert _run(["filter", reads, "-t", "9", "-c", calls, "-o", kept, "-r", gone, "--compression-level", "9"], b"", monkeypatch)[0] == 0
    assert gzip.open(kept, "rt").read() == "@r1\nACGT\n+\nIIII\n" and gzip.open(gone, "rt").read().startswith("@z0\n")
    raw = open(gone, "rb").read()
    assert raw.endswith(bgzf.EOF) and raw[12:14] == b"BC" and raw.count(bgzf.EOF[:4]) > 2


def test_cram_gates(spark, tmp_path, monkeypatch):
    reads = write(tmp_path / "a.fq", "@r1\nACGT\n+\nIIII\n")
    assert _run(["prep", reads, "--cram-reference", "r.fa"], b"", monkeypatch) == (1, b"")
    (tmp_path / "a.cram").write_bytes(b"CRAM\x03\x00")
    assert _run(["prep", str(tmp_path / "a.cram"), "--cram-reference", "r.fa"], b"", monkeypatch) == (1, b"")
    assert _run(["filter", reads, "-", "-t", "1", "-o", "x", "y"], b"", monkeypatch)[0] == 1


def test_fastq_over_many_splits(spark, tmp_path):
    draw = random.Random(8)
    reads = [(f"r{k}", draw.choice(("", " some words")), "".join(draw.choices("ACGT", k=draw.choice((1, 5, 40, 900))))) for k in range(60)]
    path = write(tmp_path / "a.fq", "".join(f"@{n}{d}\n{s}\n+\n{'@' * len(s)}\n" for n, d, s in reads) + "\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("400", "5000", "100m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = text.read_fastq(spark, path).orderBy("ord").collect()
            assert [(r.ord, r.name, r.description or "", r.seq, r.qual) for r in got] == [(k, n, d.strip(), s, "@" * len(s)) for k, (n, d, s) in enumerate(reads)], size
        for bad in ("@r1\nACGT\n+\nIIII\n@r2\nAC\n", "@r1\nACGT\n+\nIII\n", "r1\nA\n+\nI\n", "@r1\nA\nI\nI\n"):
            with pytest.raises(Exception, match="malformed FASTQ record"):
                text.read_fastq(spark, write(tmp_path / "bad.fq", bad)).collect()
        assert text.read_fastq(spark, write(tmp_path / "none.fq", "")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
