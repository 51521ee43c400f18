"""The five commands over files. Each builds DataFrames lazily and ends in a sink."""

from __future__ import annotations

import logging
import os
import shutil
import sys
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions.cigar import within_edit_limits
from cladeframe.functions.names import fastq_base_name, fastq_name
from cladeframe.functions.tags import read_taxon, tag_value
from cladeframe.operators import assignments as asg
from cladeframe.operators import classify, nrevert, pairing, taxonomy
from cladeframe.operators.report import flat_report
from cladeframe.sources import bam, embedded, sinks, taxonomy_files, text
from cladeframe.sources.text import Format

log = logging.getLogger("cladeframe")


def _real(path: str) -> str:
    """Standard input is spooled to a file, as Spark reads files only."""
    if path not in ("-", "/dev/stdin"):
        return path
    spool = tempfile.NamedTemporaryFile(delete=False, prefix="cladeframe-stdin-")
    with spool:
        shutil.copyfileobj(sys.stdin.buffer, spool)
    return spool.name


def _readable(path: str) -> tuple[str, Format]:
    """A path that Spark decodes as it should, and the format: gzip without its extension is linked under one."""
    known = text.infer_format(path)
    found, zipped = text.sniff(path)
    kind = known if known in (Format.FASTA, Format.FASTQ) else found
    if kind is Format.UNKNOWN:
        if os.path.getsize(path) == 0 and known is not Format.BAM:
            kind = known
        else:
            raise ValueError(f"unrecognised input format: {path}")
    if zipped and kind not in (Format.BAM, Format.CRAM) and not path.lower().endswith(".gz"):
        link = os.path.join(tempfile.mkdtemp(prefix="cladeframe-"), "input.gz")
        os.symlink(os.path.abspath(path), link)
        path = link
    if kind is Format.CRAM:
        raise ValueError("CRAM needs an external decoder and is not supported")
    return path, kind


def read_alignments(spark: SparkSession, path: str) -> tuple[list[str], DataFrame, Format]:
    path, kind = _readable(_real(path))
    if kind not in (Format.SAM, Format.BAM):
        raise ValueError(f"not an alignment file: {path}")
    header, rows = bam.read_bam(spark, path) if kind is Format.BAM else text.read_sam(spark, path)
    return header, rows, kind


def write_alignments(rows: DataFrame, header: list[str], path: str, level: int = 5, index: bool = True) -> None:
    """SAM or BAM by extension, BAM on standard streams; a BAM file that is sorted by coordinate gets its index beside it, streams don't."""
    path = "/dev/stdout" if path == "-" else path
    kind = text.alignment_format(path)
    if kind is Format.BAM:
        bam.write_bam(rows, header, path, level, index and text.is_coordinate_sorted(header) and not text.is_pseudo_path(path))
    elif kind is Format.CRAM:
        raise ValueError("CRAM needs an external encoder and is not supported")
    else:
        sinks.write_lines(bam.text_lines(rows), path, header)


def _reads(spark: SparkSession, path: str, kind: Format) -> DataFrame:
    rows = text.read_fastq(spark, path) if kind is Format.FASTQ else text.read_fasta(spark, path)
    return rows if "qual" in rows.columns else rows.withColumn("qual", F.lit(None).cast("string"))


def _first_names(reads: DataFrame) -> list[str]:
    return [r[0] for r in reads.where("ord < 2").orderBy("ord").select("name").collect()]


def templates(spark: SparkSession, inputs: list[str], per_record: bool = False) -> DataFrame:
    """ord, name, r1, r2 of one input, or of two that go together."""
    first, kind = _readable(_real(inputs[0]))
    if kind in (Format.SAM, Format.BAM):
        if len(inputs) > 1:
            raise ValueError("alignment input takes one file")
        header, rows, _ = read_alignments(spark, first)
        return pairing.alignment_templates(rows, text.is_query_grouped(header), bool(header) and "SO:queryname" in header[0].split("\t"), per_record)
    reads = _reads(spark, first, kind).withColumn("name", fastq_name(F.col("name")))
    if len(inputs) > 1:
        second, other = _readable(inputs[1])
        if other is not kind:
            raise ValueError("paired inputs must both be FASTQ or both FASTA")
        return pairing.zip_pairs(reads, _reads(spark, second, other).withColumn("name", fastq_name(F.col("name"))))
    if not per_record and pairing.is_interleaved(_first_names(reads)):
        return pairing.interleaved_pairs(reads)
    return pairing.single_reads(reads)


def check_pairs(inputs: list[str], *others: list[str]) -> None:
    """One or two files go together, as many outputs and rejects (if any) as inputs, and no second file is a standard stream."""
    if not 1 <= len(inputs) <= 2 or any(x and len(x) != len(inputs) for x in others):
        raise ValueError("give as many outputs and rejects as inputs, one or two")
    if any(text.is_pseudo_path(p) or p == "-" for files in (inputs, *others) for p in files[1:]):
        raise ValueError("the second file of a pair can't be a standard stream")


def check_cram_reference(kind: Format, cram_reference: str | None) -> None:
    """A reference of CRAM files goes with CRAM input only."""
    if cram_reference and kind is not Format.CRAM:
        raise ValueError("--cram-reference is for CRAM input only")


def run_prep(spark: SparkSession, inputs: list[str], output: str, per_record: bool = False, cram_reference: str | None = None) -> None:
    """Reads or alignments to one FASTA record a template."""
    check_pairs(inputs)
    if per_record and len(inputs) > 1:
        raise ValueError("--per-record takes one input")
    inputs = [_real(p) for p in inputs]
    check_cram_reference(text.sniff(inputs[0])[0], cram_reference)
    sinks.write_lines(sinks.fasta_lines(templates(spark, inputs, per_record)), output)


def _taxonomy(spark: SparkSession, database: str | None, report: str | None) -> DataFrame | None:
    if database and report:
        raise ValueError("give a database or a report, not both")
    if database:
        return spark.createDataFrame(taxonomy_files.read_database(database), taxonomy_files.SCHEMA)
    return text.read_report(spark, report) if report else None


def run_annotate(spark: SparkSession, input: str, output: str, classifications: str, database: str | None = None, report: str | None = None, level: int = 5) -> None:
    """Alignments with the taxon of their read as a tag, and the taxonomy in the header."""
    entries = _taxonomy(spark, database, report)
    header, rows, _ = read_alignments(spark, input)
    if entries is not None:  # a taxonomy, not reads: small, and it has to become header lines
        listed = [r.asDict() for r in entries.orderBy("ord").toLocalIterator()]
        header = header + [f"@CO\t{c}" for c in embedded.to_comments(listed)]
    tagged = asg.annotate(rows, text.read_assignments(spark, classifications)).persist()  # for the file and the counters
    try:
        write_alignments(tagged, header, output, level)
        n = tagged.agg(*asg.annotate_counters(tagged)).first()
        log.info("annotated %d of %d records, %d without a name", n.annotated, n.total, n.unnamed)
    finally:
        tagged.unpersist()


@dataclass
class FilterOptions:
    taxon_ids: list[int]
    include_descendants: bool = False
    include_unclassified: bool = False
    allow_ancestors: bool = False
    keep_unannotated: bool = False
    per_record: bool = False
    rescue_max_edit_distance: int | None = None
    rescue_max_indels: int | None = None
    rescue_max_indel_length: int | None = None
    rescue_n_adjustment: int | None = None
    limits: dict = field(init=False)

    def __post_init__(self):
        if self.rescue_n_adjustment is not None and self.rescue_n_adjustment < 1:
            raise ValueError("--rescue-n-adjustment must be >= 1")
        self.limits = {k: getattr(self, k) for k in classify.RESCUE}


def target_sets(spark: SparkSession, nodes: DataFrame | None, o: FilterOptions) -> tuple[DataFrame, DataFrame | None]:
    if nodes is None and (o.include_descendants or o.allow_ancestors):
        raise ValueError("ancestors and descendants need a taxonomy tree")
    if nodes is not None:
        taxonomy.check_targets(nodes, o.taxon_ids)
    targets = taxonomy.target_set(nodes, spark.createDataFrame([(t,) for t in sorted(set(o.taxon_ids))], "taxon_id long"), o.include_descendants, o.include_unclassified)
    return targets, taxonomy.ancestors(nodes, targets) if o.allow_ancestors else None


def filter_reads(spark: SparkSession, inputs: list[str], classifications: str, report: str | None, o: FilterOptions) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Reads of each input with decision, the metrics, and the assignments that no read asked for."""
    kinds = [_readable(_real(p)) for p in inputs]
    if len(kinds) > 1 and any(k is not Format.FASTQ for _, k in kinds):
        raise ValueError("two inputs must both be FASTQ")
    nodes = taxonomy.tree(text.read_report(spark, report)) if report else None
    targets, above = target_sets(spark, nodes, o)
    side = asg.collapse(text.read_assignments(spark, classifications))
    files = [_reads(spark, p, k).withColumn("base", fastq_base_name(F.col("name"))) for p, k in kinds]
    if len(files) == 2:
        pairs = pairing.zip_pairs(*(f.select("ord", F.col("base").alias("name"), "seq") for f in files))
        units, weight = pairs.select(F.col("ord").alias("unit"), F.col("name").alias("base")), 2
        split = F.col("ord")
    elif kinds[0][1] is Format.FASTQ and not o.per_record and pairing.is_interleaved(_first_names(files[0]), match_names=False):
        units, weight = pairing.interleaved_pairs(files[0]).select(F.col("ord").alias("unit"), F.col("name").alias("base")), 2
        split = F.floor(F.col("ord") / 2)
    else:
        units, weight = files[0].select(F.col("ord").alias("unit"), "base"), 1
        split = F.col("ord")
    found = classify.mark_taxa(asg.look_up(units, F.col("base"), side), F.col("taxon_id"), targets, above)
    decided = found.select("unit", "base", "missing", classify.decide_read(F.col("on_target"), F.col("is_ancestor")).alias("decision")).persist()  # asked by each sink and the metrics
    out = [f.join(decided.select("unit", "decision"), split == F.col("unit")).drop("unit", "base") for f in files]
    return out, classify.read_metrics(decided, F.lit(weight)), asg.unconsumed(side, units, F.col("base"))


def filter_alignments(spark: SparkSession, header: list[str], rows: DataFrame, report: str | None, o: FilterOptions) -> tuple[DataFrame, DataFrame]:
    """Records with decision, and the metrics."""
    listed = embedded.from_header(header)  # what the header holds wins over a file
    entries = spark.createDataFrame([(k, *(e[n] for n in embedded.KEYS)) for k, e in enumerate(listed)], taxonomy_files.SCHEMA) if listed is not None else text.read_report(spark, report) if report else None
    targets, above = target_sets(spark, taxonomy.tree(entries) if entries is not None else None, o)
    marked = classify.mark_taxa(rows.withColumn("taxon_id", read_taxon(F.col("tags"))), F.col("taxon_id"), targets, above)
    limits = [o.rescue_max_edit_distance, o.rescue_max_indels, o.rescue_max_indel_length, o.rescue_n_adjustment]
    within = within_edit_limits(F.col("seq"), F.col("cigar"), tag_value(F.col("tags"), "MD", "Z"), F.col("flag"), *limits)
    extra = ("on_target", "is_ancestor", "taxon_id")
    if o.per_record:
        decided = marked.withColumn("decision", classify.decide_record(F.col("taxon_id"), F.col("on_target"), F.col("is_ancestor"), within, o.keep_unannotated))
        return decided.drop(*extra), classify.record_metrics(decided, F.col("taxon_id"), o.limits, o.keep_unannotated)
    if not text.is_query_grouped(header):
        raise ValueError("input must be grouped by query name: sort it by name first, or ask for --per-record")
    named = marked.withColumn("qname", F.when(F.col("qname").isNull(), F.raise_error(F.lit("alignment record has no name"))).otherwise(F.col("qname")))
    by_name = "SO:queryname" in header[0].split("\t")
    keyed = named.withColumn("run", F.col("qname")) if by_name else pairing.runs(named)
    decisions = classify.decide_templates(keyed, "run", "taxon_id", within, o.keep_unannotated)
    untagged = keyed.agg(F.count_if(F.col("taxon_id").isNull()).alias("n"))
    return keyed.join(decisions.select("run", "decision"), "run").drop("run", *extra), classify.template_metrics(decisions, untagged, o.limits, o.keep_unannotated)


def log_metrics(rows: list, options: FilterOptions) -> None:
    for r in rows:
        log.info("%s kept %s of %s (%s on taxa, %s ancestors)", "templates:" if r["template"] else "records:", r["num_kept"], r["total"], r["on_taxa"], r["rescued_ancestors"])
        if r["missing_ti_tag"] and not options.keep_unannotated:
            log.warning("%s have no taxon tag", r["missing_ti_tag"])
        if r["missing_classifications"]:
            log.warning("%s have no classification", r["missing_classifications"])


def run_filter(spark: SparkSession, inputs: list[str], outputs: list[str], options: FilterOptions, rejects: list[str] = (), classifications: str | None = None, report: str | None = None, metrics: str | None = None, level: int = 5) -> list:
    """Kept and, if asked for, rejected reads or records; returns the metric rows. Decisions are made once and kept for all sinks."""
    check_pairs(inputs, outputs, list(rejects))
    if len(outputs) != len(inputs):
        raise ValueError("give as many outputs as inputs")
    if options.per_record and len(inputs) > 1:
        raise ValueError("--per-record takes one input")
    paths = [_real(p) for p in inputs]
    kind = _readable(paths[0])[1]
    kept = F.col("decision") != classify.REJECT
    held = []
    try:
        if kind in (Format.FASTA, Format.FASTQ):
            if not classifications:
                raise ValueError("FASTQ and FASTA input needs --classifications")
            files, counts, left = filter_reads(spark, paths, classifications, report, options)
            lines = sinks.fastq_lines if kind is Format.FASTQ else sinks.fasta_read_lines
            for k, rows in enumerate(files):
                sinks.write_lines(lines(rows.where(kept)), outputs[k], level=level)
                if rejects:
                    sinks.write_lines(lines(rows.where(~kept)), rejects[k], level=level)
            if n := left.count():
                log.warning("%d classifications matched no read", n)
        else:
            if classifications:
                raise ValueError("--classifications is not valid for SAM/BAM/CRAM input")
            header, rows, _ = read_alignments(spark, paths[0])
            decided, counts = filter_alignments(spark, header, rows, report, options)
            held.append(decided.persist())
            write_alignments(decided.where(kept), header, outputs[0], level)
            if rejects:
                write_alignments(decided.where(~kept), header, rejects[0], level)
        listed = counts.orderBy("template").collect()
    finally:
        for rows in held:
            rows.unpersist()
    log_metrics(listed, options)
    if metrics:
        # A row or two, which are here already.
        head, lines = sinks.table_lines(spark.createDataFrame(listed, counts.schema).withColumn("ord", F.col("template").cast("long")))
        sinks.write_lines(lines, metrics, [head])
    return listed


def run_n2ref(spark: SparkSession, input: str, output: str, reference: str, quality: int | None = None, level: int = 5) -> None:
    """Alignments with uncalled bases restored. The reference is FASTA with an index beside it."""
    if not os.path.exists(f"{reference}.fai"):
        raise ValueError(f"the reference has no index: {reference}.fai")
    header, rows, _ = read_alignments(spark, input)
    contigs = text.read_fasta(spark, reference).select(F.col("name").alias("contig"), "seq")
    restored = nrevert.revert_n_calls(rows, contigs, quality).persist()  # for the file and the counters
    try:
        write_alignments(restored.drop("converted"), header, output, level, index=False)
        n = restored.agg(*nrevert.revert_counters()).first()
        log.info("restored %d bases in %d records", n.converted, n.records)
    finally:
        restored.unpersist()


def run_report2tsv(spark: SparkSession, input: str, output: str) -> None:
    """A hierarchical report as a flat table."""
    head, lines = sinks.table_lines(flat_report(text.read_report(spark, _real(input))))
    sinks.write_lines(lines, output, [head])
