"""Driver queries of the engine's operators over the given tables, and SQL that says the same in another way.

The keys begin with the operator's id in the blueprint. Where a query runs an operator by windows or higher-order
functions, its SQL uses keys, unnested rows or recursion, so that agreement means something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions import cigar, names, tags
from cladeframe.operators import assignments as asg
from cladeframe.operators import classify, nrevert, pairing, taxonomy
from cladeframe.operators.report import flat_report, plain_number, total_sequences
from cladeframe.plans import commands
from cladeframe.plans.views import view, with_views
from cladeframe.sources import bam, embedded, sinks, taxonomy_files, text
from cladeframe.streaming import filter_stream

#: Targets of the queries: two nations' suppliers by way of the tree, and one supplier.
TARGETS = (103, 107, 1005)
LIMITS = {"rescue_max_edit_distance": 2, "rescue_max_indels": 2, "rescue_max_indel_length": 2, "rescue_n_adjustment": 3}
QUERIES, ORACLE_SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _taxa(spark: SparkSession, ids=TARGETS) -> DataFrame:
    return spark.createDataFrame([(t,) for t in ids], "taxon_id long")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.tree(view(spark, sf_dir, "taxa"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.target_set(_nodes(spark, sf_dir), _taxa(spark), include_descendants=True, include_unclassified=True)


def _above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.ancestors(_nodes(spark, sf_dir), _targets(spark, sf_dir))


_BASE = r"regexp_replace(split_part(name, ' ', 1), '/[12]$', '')"
#: The taxonomy by keys instead of indents.
_EDGES = """
edges AS (
  SELECT 10 + r_regionkey AS child, 1 AS parent FROM region
  UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey FROM nation
  UNION ALL SELECT 1000 + s_suppkey, 100 + s_nationkey FROM supplier
)"""
_TARGET_SQL = (
    _EDGES
    + """, targets AS (
  SELECT unnest([103, 107, 1005, 0]) AS taxon_id UNION SELECT child FROM edges WHERE parent IN (103, 107, 1005)
), above AS (
  SELECT DISTINCT parent AS taxon_id FROM edges WHERE child IN (SELECT taxon_id FROM targets)
  UNION SELECT DISTINCT p.parent FROM edges e JOIN edges p ON e.parent = p.child WHERE e.child IN (SELECT taxon_id FROM targets)
  UNION SELECT DISTINCT g.parent FROM edges e JOIN edges p ON e.parent = p.child JOIN edges g ON p.parent = g.child WHERE e.child IN (SELECT taxon_id FROM targets)
)"""
)


@_query(with_views("reads", "classifications", sql=f"""
SELECT ord, {_BASE} AS base, coalesce(taxon_id, 0) AS taxon_id, taxon_id IS NULL AS missing FROM reads LEFT JOIN classifications ON query_name = {_BASE}"""))
def j4_left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = view(spark, sf_dir, "reads").withColumn("base", names.fastq_base_name(F.col("name")))
    return asg.look_up(reads, F.col("base"), view(spark, sf_dir, "classifications")).select("ord", "base", "taxon_id", "missing")


@_query(with_views("reads", "classifications", sql=f"""~ {_TARGET_SQL}, d AS (
  SELECT taxon_id IS NULL AS missing, coalesce(taxon_id, 0) IN (SELECT taxon_id FROM targets) AS o, coalesce(taxon_id, 0) IN (SELECT taxon_id FROM above) AS u
  FROM reads LEFT JOIN classifications ON query_name = {_BASE}
), n AS (
  SELECT count(*) AS total, count(*) FILTER (o) AS on_taxa, count(*) FILTER (NOT o AND u) AS up, count(*) FILTER (missing) AS missing FROM d
)
SELECT false AS template, on_taxa, up AS rescued_ancestors, CAST(NULL AS BIGINT) AS rescued_variants, CAST(NULL AS BIGINT) AS unannotated_but_kept, on_taxa + up AS num_kept, total - on_taxa - up AS num_filtered, total,
  (total - on_taxa - up) / total AS frac_removed, CAST(NULL AS BIGINT) AS rescue_max_edit_distance, CAST(NULL AS BIGINT) AS rescue_max_indels, CAST(NULL AS BIGINT) AS rescue_max_indel_length,
  CAST(NULL AS BIGINT) AS rescue_n_adjustment, CAST(NULL AS BIGINT) AS missing_ti_tag, missing AS missing_classifications FROM n"""))
def a1_fastx_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: reads, looked up, decided by an expanded target set and its ancestors, and counted."""
    reads = view(spark, sf_dir, "reads").select(names.fastq_base_name(F.col("name")).alias("base"))
    found = asg.look_up(reads, F.col("base"), asg.collapse(view(spark, sf_dir, "classifications")))
    targets = _targets(spark, sf_dir)
    marked = classify.mark_taxa(found, F.col("taxon_id"), targets, _above(spark, sf_dir))
    return classify.read_metrics(marked.withColumn("decision", classify.decide_read(F.col("on_target"), F.col("is_ancestor"))), F.lit(1))


@_query(with_views("classifications", sql="SELECT query_name, taxon_id FROM classifications WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE concat('q', l_orderkey) = query_name)"))
def j5_unconsumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asg.unconsumed(view(spark, sf_dir, "classifications"), view(spark, sf_dir, "reads"), names.fastq_base_name(F.col("name"))).select("query_name", "taxon_id")


@_query("SELECT concat('c', o_custkey) AS query_name, CAST(len(list_distinct(list(o_orderkey % 3))) AS BIGINT) AS n_taxa FROM orders GROUP BY o_custkey HAVING min(o_orderkey % 3) < max(o_orderkey % 3)")
def a7_duplicate_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return asg.conflicts(orders.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("query_name"), (F.col("o_orderkey") % 3).alias("taxon_id")))


@_query("SELECT DISTINCT concat('q', l_orderkey) AS query_name, l_orderkey % 9 AS taxon_id FROM lineitem")
def s10_collapse_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return asg.collapse(lines.select(F.concat(F.lit("q"), F.col("l_orderkey")).alias("query_name"), (F.col("l_orderkey") % 9).alias("taxon_id")))


@_query("""WITH x AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey + 1 AS c FROM orders)
SELECT CASE WHEN s = 'P' THEN 'U' ELSE 'C' END AS classification_code, concat('q', k) AS query_name, CASE WHEN s = 'P' THEN 0 ELSE c END AS taxon_id FROM x""")
def s9_parse_classification_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    open_ = F.col("o_orderstatus") == "P"
    lines = orders.select(F.concat_ws("\t", F.when(open_, "U").otherwise("C"), F.concat(F.lit("q"), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, "/1").otherwise("")), F.when(open_, "0").otherwise((F.col("o_custkey") + 1).cast("string")), F.lit("150|150"), F.lit("9606:50 |:| 0:50")).alias("value"))
    return asg.parse_assignments(lines.union(spark.createDataFrame([("  ",)], "value string")))


@_query(with_views("report", sql="SELECT ord, num_fragments_clade, num_fragments_direct, rank_code, taxon_id, name, indent, CASE WHEN ord % 2 = 0 THEN ord END AS minimizer_count FROM report"))
def s11_parse_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = view(spark, sf_dir, "report")
    name = F.concat(F.repeat(F.lit(" "), F.col("indent")), F.col("name"))
    counts = [F.lit(" 1.50"), F.concat(F.col("num_fragments_clade").cast("string"), F.lit(" ")), F.col("num_fragments_direct").cast("string")]
    wide = F.concat_ws("\t", *counts, F.col("ord").cast("string"), F.lit("7"), "rank_code", F.col("taxon_id").cast("string"), name)
    narrow = F.concat_ws("\t", *counts, "rank_code", F.col("taxon_id").cast("string"), name)
    parsed = taxonomy.parse_report(report.select("ord", F.when(F.col("ord") % 2 == 0, wide).otherwise(narrow).alias("value")))
    return parsed.drop("pct_fragments", "distinct_minimizer_count")


@_query(with_views("report", sql=f"~ {_EDGES} SELECT r.ord, r.taxon_id, CAST(r.indent / 2 AS INT) AS level, CAST(e.parent AS BIGINT) AS parent_id FROM report r LEFT JOIN edges e ON r.taxon_id = e.child WHERE r.taxon_id <> 0"))
def h1_tree_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.tree(view(spark, sf_dir, "report"))


_FLAT = """SELECT r.ord, r.taxon_id AS tax_id, r.name, r.rank_code AS rank, CAST(r.indent / 2 AS INT) AS level, CAST(e.parent AS BIGINT) AS parent_tax_id,
  CASE CAST(r.indent AS INT) WHEN 2 THEN 'R' WHEN 4 THEN 'D' WHEN 6 THEN 'P' END AS parent_rank, num_fragments_clade AS clade_count, num_fragments_direct AS direct_count,
  num_fragments_clade - num_fragments_direct AS descendant_count, num_fragments_clade / t AS frac_clade, num_fragments_direct / t AS frac_direct, (num_fragments_clade - num_fragments_direct) / t AS frac_descendant,
  minimizer_count, distinct_minimizer_count
FROM report r LEFT JOIN edges e ON r.taxon_id = e.child, (SELECT sum(num_fragments_clade) AS t FROM report WHERE taxon_id IN (0, 1)) AS total"""


@_query(with_views("report", sql=f"~ {_EDGES} {_FLAT}"))
def r1_report_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_report(view(spark, sf_dir, "report"))


@_query(with_views("report", sql=f"~ {_EDGES} SELECT r.ord, r.taxon_id, CAST(e.parent AS BIGINT) AS parent_id, CASE CAST(r.indent AS INT) WHEN 2 THEN 'R' WHEN 4 THEN 'D' WHEN 6 THEN 'P' END AS parent_rank FROM report r LEFT JOIN edges e ON r.taxon_id = e.child"))
def h2_report_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.nearest_parents(view(spark, sf_dir, "report")).select("ord", "taxon_id", "parent_id", "parent_rank")


@_query(with_views("report", sql=f"""~ {_EDGES}, below(target, taxon_id) AS (
  SELECT child, child FROM edges UNION SELECT 1, 1 UNION ALL SELECT b.target, e.child FROM below b JOIN edges e ON e.parent = b.taxon_id
) SELECT CAST(target AS BIGINT) AS taxon_id, count(*) - 1 AS n_below FROM below GROUP BY target""", recursive=True))
def h5_subtree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict descendants of every taxon, counted by intervals: in pre-order a subtree is a run of ordinals."""
    nodes = taxonomy.intervals(_nodes(spark, sf_dir))
    last = nodes.agg(F.max("ord").alias("last"))
    return nodes.join(F.broadcast(last)).select("taxon_id", (F.least(F.col("subtree_end") - 1, F.col("last")) - F.col("ord")).alias("n_below"))


@_query("SELECT CAST(100 + s_nationkey AS BIGINT) AS target, 1000 + s_suppkey AS taxon_id FROM supplier WHERE s_nationkey IN (3, 7)")
def h5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.descendants(_nodes(spark, sf_dir), _taxa(spark))


@_query(f"WITH {_TARGET_SQL} SELECT CAST(taxon_id AS BIGINT) AS taxon_id FROM above")
def h6_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _above(spark, sf_dir)


@_query(f"WITH {_TARGET_SQL} SELECT CAST(taxon_id AS BIGINT) AS taxon_id FROM targets")
def c1_target_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir)


@_query(with_views("classifications", sql=f"""~ {_TARGET_SQL}
SELECT query_name, CASE WHEN taxon_id IN (SELECT taxon_id FROM targets) THEN 'OnTaxa' WHEN taxon_id IN (SELECT taxon_id FROM above) THEN 'AncestorRescue' ELSE 'Reject' END AS decision FROM classifications"""))
def c2_taxon_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _targets(spark, sf_dir)
    marked = classify.mark_taxa(view(spark, sf_dir, "classifications"), F.col("taxon_id"), targets, _above(spark, sf_dir))
    return marked.select("query_name", classify.decide_read(F.col("on_target"), F.col("is_ancestor")).alias("decision"))


# ---------------------------------------------------------------- alignments

#: CIGAR and MD as rows: operations with running offsets, MD tokens with a running cursor.
_WALK = r"""
ops AS (
  SELECT ord, i, CAST(regexp_extract(x, '[0-9]+') AS INT) AS n, right(x, 1) AS op
  FROM (SELECT ord, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS x, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) AS i FROM alignments)
), placed AS (
  SELECT *, sum(CASE WHEN op IN ('M', '=', 'X', 'I', 'S') THEN n ELSE 0 END) OVER w - CASE WHEN op IN ('M', '=', 'X', 'I', 'S') THEN n ELSE 0 END AS read_at,
    sum(CASE WHEN op IN ('M', '=', 'X') THEN n ELSE 0 END) OVER w - CASE WHEN op IN ('M', '=', 'X') THEN n ELSE 0 END AS aligned_at,
    sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) OVER w - CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END AS ref_at
  FROM ops WINDOW w AS (PARTITION BY ord ORDER BY i)
), bases AS (
  SELECT ord, read_at + k AS read_at, aligned_at + k AS aligned_at, ref_at + k AS ref_at FROM (SELECT *, unnest(range(n)) AS k FROM placed WHERE op IN ('M', '=', 'X'))
), ns AS (
  SELECT a.ord, count(*) FILTER (upper(substr(seq, CAST(read_at AS INT) + 1, 1)) = 'N') AS n_aligned FROM alignments a JOIN bases b USING (ord) GROUP BY a.ord
), tokens AS (
  SELECT ord, t, sum(CASE WHEN t SIMILAR TO '[0-9]+' THEN CAST(t AS INT) WHEN t LIKE '^%' THEN 0 ELSE 1 END) OVER (PARTITION BY ord ORDER BY i) - 1 AS at
  FROM (SELECT ord, unnest(regexp_extract_all(md, '[0-9]+|\^[A-Za-z]+|[A-Za-z]')) AS t, generate_subscripts(regexp_extract_all(md, '[0-9]+|\^[A-Za-z]+|[A-Za-z]'), 1) AS i FROM alignments WHERE md IS NOT NULL)
), subs AS (
  SELECT t.ord, count(*) FILTER (b.ord IS NULL OR upper(substr(a.seq, CAST(b.read_at AS INT) + 1, 1)) NOT IN ('N', '')) AS n
  FROM tokens t JOIN alignments a ON a.ord = t.ord LEFT JOIN bases b ON b.ord = t.ord AND b.aligned_at = t.at WHERE t.t SIMILAR TO '[A-Za-z]' GROUP BY t.ord
), gaps AS (
  SELECT ord, count(*) FILTER (op IN ('I', 'D')) AS n, coalesce(max(n) FILTER (op IN ('I', 'D')), 0) AS longest, coalesce(list(CASE op WHEN 'I' THEN n ELSE -n END ORDER BY i) FILTER (op IN ('I', 'D')), []) AS each FROM ops GROUP BY ord
), edits AS (
  SELECT a.ord, a.qname, a.flag, a.taxon, a.md, CASE WHEN a.md IS NOT NULL THEN coalesce(s.n, 0) END AS subs, g.n AS n_gaps, g.longest, g.each, n_aligned
  FROM alignments a LEFT JOIN subs s USING (ord) JOIN gaps g USING (ord) JOIN ns USING (ord)
), within AS (
  SELECT *, md IS NOT NULL AND flag & 4 = 0 AND subs + n_gaps <= greatest(0, 2 - n_aligned // 3) AND n_gaps <= 2 AND longest <= 2 AS ok FROM edits
)"""


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "alignments")


def _columns() -> tuple:
    return F.col("seq"), F.col("cigar"), F.col("md")


def _within() -> F.Column:
    return cigar.within_edit_limits(*_columns(), F.col("flag"), *LIMITS.values())


@_query(with_views("alignments", sql=f"~ {_WALK} SELECT ord, CAST(sum(n) FILTER (op IN ('M', '=', 'X', 'D', 'N')) AS BIGINT) AS span FROM ops GROUP BY ord"))
def p16_reference_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alignments(spark, sf_dir).select("ord", cigar.reference_span(F.col("cigar")).alias("span"))


@_query(with_views("alignments", sql=f"~ {_WALK} SELECT ord, CAST(n_aligned AS BIGINT) AS n_aligned FROM ns"))
def p18_aligned_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alignments(spark, sf_dir).select("ord", cigar.aligned_ns(F.col("seq"), F.col("cigar")).alias("n_aligned"))


@_query(with_views("alignments", sql=f"~ {_WALK} SELECT ord, CAST(subs AS BIGINT) AS substitutions, CASE WHEN md IS NOT NULL THEN array_to_string(each, ',') END AS indels, CASE WHEN md IS NOT NULL THEN CAST(subs + n_gaps AS BIGINT) END AS total, CASE WHEN md IS NOT NULL THEN CAST(longest AS INT) END AS longest FROM edits"))
def p19_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _alignments(spark, sf_dir).select("ord", cigar.edit_counts(*_columns()).alias("e"))
    longest = F.coalesce(F.array_max(F.transform("e.indels", F.abs)), F.lit(0))
    known = F.col("e").isNotNull()
    return rows.select("ord", F.col("e.substitutions").alias("substitutions"), F.array_join("e.indels", ",").alias("indels"), (F.col("e.substitutions") + F.size("e.indels")).alias("total"), F.when(known, longest).alias("longest"))


@_query(with_views("alignments", sql=f"~ {_WALK} SELECT ord, ok FROM within"))
def c6_edit_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alignments(spark, sf_dir).select("ord", _within().alias("ok"))


_DECIDE = """, marked AS (
  SELECT *, coalesce(taxon IN (SELECT taxon_id FROM targets), false) AS o, coalesce(taxon IN (SELECT taxon_id FROM above), false) AS u FROM within
)"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments with what their taxon is to the targets."""
    return classify.mark_taxa(_alignments(spark, sf_dir), F.col("taxon"), _targets(spark, sf_dir), _above(spark, sf_dir))


_RECORD = "CASE WHEN taxon IS NULL THEN 'UnannotatedKeep' WHEN o THEN 'OnTaxa' WHEN u THEN 'AncestorRescue' WHEN ok THEN 'EditRescue' ELSE 'Reject' END"


@_query(with_views("alignments", sql=f"~ {_TARGET_SQL}, {_WALK.lstrip()}{_DECIDE} SELECT ord, {_RECORD} AS decision FROM marked"))
def c4_record_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marked(spark, sf_dir)
    return rows.select("ord", classify.decide_record(F.col("taxon"), F.col("on_target"), F.col("is_ancestor"), _within(), True).alias("decision"))


_TEMPLATE = """, grouped AS (
  SELECT qname, count(*) AS n, count(*) FILTER (taxon IS NULL) AS untagged, count(*) FILTER (p) AS prim, count(*) FILTER (p AND o) AS n_on, count(*) FILTER (p AND u) AS n_up, count(*) FILTER (p AND taxon IS NOT NULL) AS n_tag, count(*) FILTER (p AND ok) AS n_ok
  FROM (SELECT *, flag & 2304 = 0 AS p FROM marked) GROUP BY qname
), decided AS (
  SELECT *, CASE WHEN n_on > 0 THEN 'OnTaxa' WHEN n_up > 0 THEN 'AncestorRescue' WHEN n_tag > 0 AND n_ok = prim THEN 'EditRescue' WHEN n_tag = 0 THEN 'UnannotatedKeep' ELSE 'Reject' END AS decision FROM grouped
)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.decide_templates(_marked(spark, sf_dir), "qname", "taxon", _within(), True)


@_query(with_views("alignments", sql=f"~ {_TARGET_SQL}, {_WALK.lstrip()}{_DECIDE}{_TEMPLATE} SELECT qname, decision, n AS n_records, untagged > 0 AS untagged FROM decided"))
def c5_template_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)


_COUNTS = """SELECT {0} AS template, {1} FILTER (decision = 'OnTaxa') AS on_taxa, {1} FILTER (decision = 'AncestorRescue') AS rescued_ancestors, {1} FILTER (decision = 'EditRescue') AS rescued_variants,
  {1} FILTER (decision = 'UnannotatedKeep') AS unannotated_but_kept, {1} FILTER (decision <> 'Reject') AS num_kept, {1} FILTER (decision = 'Reject') AS num_filtered, {1} AS total, {2} AS missing_ti_tag FROM {3}"""
_METRICS = """SELECT template, CAST(coalesce(on_taxa, 0) AS BIGINT) AS on_taxa, CAST(coalesce(rescued_ancestors, 0) AS BIGINT) AS rescued_ancestors, CAST(coalesce(rescued_variants, 0) AS BIGINT) AS rescued_variants,
  CAST(coalesce(unannotated_but_kept, 0) AS BIGINT) AS unannotated_but_kept, CAST(coalesce(num_kept, 0) AS BIGINT) AS num_kept, CAST(coalesce(num_filtered, 0) AS BIGINT) AS num_filtered, CAST(total AS BIGINT) AS total,
  coalesce(num_filtered, 0) / total AS frac_removed, CAST(2 AS BIGINT) AS rescue_max_edit_distance, CAST(2 AS BIGINT) AS rescue_max_indels, CAST(2 AS BIGINT) AS rescue_max_indel_length, CAST(3 AS BIGINT) AS rescue_n_adjustment,
  CAST(missing_ti_tag AS BIGINT) AS missing_ti_tag, CAST(NULL AS BIGINT) AS missing_classifications FROM ({0}) AS counts"""


@_query(with_views("alignments", sql=f"~ {_TARGET_SQL}, {_WALK.lstrip()}{_DECIDE} " + _METRICS.format(_COUNTS.format("false", "count(*)", "count(*) FILTER (taxon IS NULL)", f"(SELECT *, {_RECORD} AS decision FROM marked)"))))
def a2_record_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marked(spark, sf_dir).withColumn("decision", classify.decide_record(F.col("taxon"), F.col("on_target"), F.col("is_ancestor"), _within(), True))
    return classify.record_metrics(rows, F.col("taxon"), LIMITS, True)


@_query(with_views("alignments", sql=f"~ {_TARGET_SQL}, {_WALK.lstrip()}{_DECIDE}{_TEMPLATE} " + _METRICS.format(_COUNTS.format("false", "sum(n)", "sum(untagged)", "decided") + " UNION ALL " + _COUNTS.format("true", "count(*)", "count(*) FILTER (untagged > 0)", "decided"))))
def a3_template_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    untagged = _alignments(spark, sf_dir).agg(F.count_if(F.col("taxon").isNull()).alias("n"))
    return classify.template_metrics(_decided(spark, sf_dir), untagged, LIMITS, True)


@_query(with_views("alignments", sql="SELECT ord, CASE WHEN taxon IS NULL THEN 'NM:i:1' WHEN ord % 2 = 0 THEN concat('ti:i:', taxon % 77, chr(9), 'NM:i:1') ELSE concat('NM:i:1', chr(9), 'ti:i:', taxon % 77) END AS tags, taxon % 77 AS taxon FROM alignments"))
def p14_set_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags parsed, a taxon set in place or added, and read again."""
    rows = _alignments(spark, sf_dir)
    had = tags.parse_tags(F.when((F.col("ord") % 2 == 0) & F.col("taxon").isNotNull(), "ti:i:5\tNM:i:1").otherwise("NM:i:1"))
    rows = rows.select("ord", F.when(F.col("taxon").isNull(), had).otherwise(tags.set_taxon(had, F.col("taxon") % 77)).alias("t"))
    return rows.select("ord", tags.format_tags(F.col("t")).alias("tags"), tags.read_taxon(F.col("t")).alias("taxon"))


@_query(with_views("alignments", "classifications", sql="SELECT a.ord, CAST(c.taxon_id AS BIGINT) AS taxon FROM alignments a JOIN classifications c ON c.query_name = a.qname"))
def j3_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = view(spark, sf_dir, "classifications")
    rows = _alignments(spark, sf_dir).join(side.select(F.col("query_name").alias("qname")), "qname", "left_semi").withColumn("tags", F.array().cast(tags.TAGS))
    return asg.annotate(rows, side.select("query_name", "taxon_id")).select("ord", tags.read_taxon(F.col("tags")).alias("taxon"))


@_query(with_views("alignments", "reference", sql=f"""~ {_WALK}, hits AS (
  SELECT b.ord, b.read_at, upper(substr(r.seq, CAST(a.pos + b.ref_at AS INT), 1)) AS base FROM alignments a JOIN bases b USING (ord) JOIN reference r ON r.contig = a.rname
  WHERE a.flag & 4 = 0 AND substr(a.seq, CAST(b.read_at AS INT) + 1, 1) = 'N' AND a.pos + b.ref_at <= length(r.seq)
), chars AS (
  SELECT a.ord, k, coalesce(h.base, substr(a.seq, k + 1, 1)) AS c, h.base IS NOT NULL AS hit FROM (SELECT ord, seq, CAST(unnest(range(32)) AS INT) AS k FROM alignments) a LEFT JOIN hits h ON h.ord = a.ord AND h.read_at = a.k
) SELECT ord, string_agg(c, '' ORDER BY k) AS seq, count(*) FILTER (hit) AS converted FROM chars GROUP BY ord"""))
def n1_revert_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nrevert.revert_n_calls(_alignments(spark, sf_dir), view(spark, sf_dir, "reference"), chunk=64).select("ord", "seq", "converted")


@_query(with_views("alignments", sql="SELECT ord, qname, flag, rname, pos, cigar, seq, concat('MD:Z:', coalesce(md, '1')) AS tags FROM alignments"))
def s5_parse_sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments as SAM lines and back."""
    tag = F.array(F.struct(F.lit("MD").alias("tag"), F.lit("Z").alias("type"), F.coalesce("md", F.lit("1")).alias("value")))
    rows = _alignments(spark, sf_dir).withColumns({"tags": tag, "mapq": F.lit(60), "rnext": F.lit("*"), "pnext": F.lit(0), "tlen": F.lit(0), "qual": F.lit("*")})
    back = text.parse_sam(bam.text_lines(rows))
    return back.select("ord", "qname", "flag", "rname", "pos", "cigar", "seq", tags.format_tags(F.col("tags")).alias("tags"))


# ---------------------------------------------------------------- names and templates


@_query(with_views("reads", sql=f"""SELECT ord, {_BASE} AS base, split_part(name, ' ', 1) AS token, regexp_replace(name, '/[12]$', '') AS stripped,
  CAST(CASE WHEN right(name, 2) = '/1' THEN 1 WHEN right(name, 2) = '/2' THEN 2 END AS INT) AS suffix FROM reads"""))
def p1_base_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return view(spark, sf_dir, "reads").select("ord", names.fastq_base_name(n).alias("base"), names.fastq_name(n).alias("token"), names.strip_pair_suffix(n).alias("stripped"), names.pair_suffix(n).alias("suffix"))


@_query(with_views("reads", sql="""SELECT ord, string_agg(CASE c WHEN 'A' THEN 'T' WHEN 'T' THEN 'A' WHEN 'C' THEN 'G' WHEN 'G' THEN 'C' ELSE c END, '' ORDER BY k DESC) AS rc
FROM (SELECT ord, k, substr(seq, CAST(k AS INT), 1) AS c FROM (SELECT ord, seq, unnest(range(1, 33)) AS k FROM reads)) GROUP BY ord"""))
def p9_reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "reads").select("ord", names.reverse_complement(F.col("seq")).alias("rc"))


@_query(with_views("alignments", sql="SELECT ord, concat(qname, CASE WHEN flag IN (65, 321, 2113, 69) THEN '/1' ELSE '/2' END) AS name, seq AS r1 FROM alignments WHERE flag IN (65, 129, 69)"))
def g3_single_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.single_templates(_alignments(spark, sf_dir), per_record=True).select("ord", "name", "r1")


@_query("SELECT r_name AS rank, CASE r_name WHEN 'species' THEN 'S' ELSE '--' END AS code FROM region UNION ALL SELECT 'genus', 'G' UNION ALL SELECT 'superkingdom', 'D' UNION ALL SELECT 'species subgroup', 'G3'")
def p15_rank_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("rank")).union(spark.createDataFrame([("genus",), ("superkingdom",), ("species subgroup",)], "rank string"))
    return ranks.select("rank", names.rank_code(F.col("rank")).alias("code"))


@_query("""WITH x AS (SELECT o_orderkey AS ord, concat('n', o_orderkey // 40 % 3) AS qname, lag(concat('n', o_orderkey // 40 % 3)) OVER (ORDER BY o_orderkey) AS was FROM orders)
SELECT x.ord, x.qname, (SELECT count(*) FROM x AS y WHERE y.ord <= x.ord AND y.qname IS DISTINCT FROM y.was) AS run FROM x""")
def g1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return pairing.runs(orders.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("n"), F.expr("o_orderkey div 40 % 3")).alias("qname")))


_FORWARD = "CASE WHEN flag & 16 <> 0 THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END"


@_query(with_views("pairs", sql=f"""SELECT a.ord, a.qname AS name, a.s AS r1, b.s AS r2 FROM (SELECT *, {_FORWARD} AS s FROM pairs WHERE flag & 64 <> 0) a LEFT JOIN (SELECT *, {_FORWARD} AS s FROM pairs WHERE flag & 128 <> 0) b USING (qname)"""))
def g2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.grouped_templates(view(spark, sf_dir, "pairs"))


@_query(with_views("pairs", sql=f"""SELECT a.ord, concat('>', a.qname, chr(10), a.s, CASE WHEN b.s IS NULL THEN '' ELSE concat('N', b.s) END) AS value FROM (SELECT *, {_FORWARD} AS s FROM pairs WHERE flag & 64 <> 0) a LEFT JOIN (SELECT *, {_FORWARD} AS s FROM pairs WHERE flag & 128 <> 0) b USING (qname)"""))
def p11_template_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.fasta_lines(pairing.grouped_templates(view(spark, sf_dir, "pairs")))


@_query(with_views("ends", sql="SELECT ord, concat('r', ord) AS name, seq1 AS r1, seq2 AS r2 FROM ends"))
def j6_zip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = view(spark, sf_dir, "ends")
    return pairing.zip_pairs(*(ends.select("ord", F.col(f"name{k}").alias("name"), F.col(f"seq{k}").alias("seq")) for k in (1, 2)))


@_query(with_views("ends", sql="SELECT ord, concat('r', ord) AS name, seq1 AS r1, seq2 AS r2 FROM ends"))
def j11_interleaved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = view(spark, sf_dir, "ends")
    each = [ends.select((F.col("ord") * 2 + k - 1).alias("ord"), F.col(f"name{k}").alias("name"), F.col(f"seq{k}").alias("seq")) for k in (1, 2)]
    return pairing.interleaved_pairs(each[0].union(each[1]))


@_query(with_views("ends", sql="SELECT ord, concat('@r', ord, '/1', chr(10), seq1, chr(10), '+', chr(10), repeat('I', 32)) AS value FROM ends"))
def k2_fastq_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = view(spark, sf_dir, "ends").select("ord", F.col("name1").alias("name"), F.lit(None).cast("string").alias("description"), F.col("seq1").alias("seq"), F.repeat(F.lit("I"), F.lit(32)).alias("qual"))
    return sinks.fastq_lines(reads)


@_query(with_views("report", sql=f"""~ {_EDGES}, flat AS ({_FLAT})
SELECT ord, concat_ws(chr(9), tax_id, name, rank, level, coalesce(CAST(parent_tax_id AS VARCHAR), ''), coalesce(parent_rank, ''), clade_count, direct_count, descendant_count) AS value FROM flat"""))
def k8_table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat report as written, but for the shares, whose text form tests hold against fixed values."""
    flat = flat_report(view(spark, sf_dir, "report")).drop("frac_clade", "frac_direct", "frac_descendant", "minimizer_count", "distinct_minimizer_count")
    return sinks.table_lines(flat)[1]


@_query(with_views("report", sql="SELECT sum(num_fragments_clade) AS total_sequences FROM report WHERE taxon_id IN (0, 1)").replace("sum(num_fragments_clade) AS total", "CAST(sum(num_fragments_clade) AS BIGINT) AS total"))
def a4_total_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the flat report divides its shares by, as the operator itself sums it."""
    return total_sequences(view(spark, sf_dir, "report")).select(F.col("_total").alias("total_sequences"))


@_query("SELECT 1 + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS n_taxa")
def a9_node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.node_count(_nodes(spark, sf_dir))


@_query(with_views("reads", "classifications", sql=f"""~ {_TARGET_SQL}
SELECT ord, CASE WHEN coalesce(taxon_id, 0) IN (SELECT taxon_id FROM targets) THEN 'OnTaxa' ELSE 'Reject' END AS decision FROM reads LEFT JOIN classifications ON query_name = {_BASE}"""))
def g9_filter_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-read filtering, as the stream runs it."""
    return filter_stream(view(spark, sf_dir, "reads"), view(spark, sf_dir, "classifications"), _targets(spark, sf_dir)).select("ord", "decision")


# ---------------------------------------------------------------- fixed vectors, headers, taxonomy files, counters


def _vectors(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({columns})"


#: Leading bytes and the format that they tell.
_HEADS = [("BAM\x01..", "bam"), ("CRAM\x03", "cram"), (">r1\nAC", "fasta"), ("@r1 x\nAC", "fastq"), ("@HD\tVN:1.6\n", "sam"), ("@SQ\tSN:a", "sam"), ("@r1", "fastq"), ("r1\t0", "unknown"), ("", "unknown")]


@_query(_values([(k, f) for k, (_, f) in enumerate(_HEADS)], "k, format"))
def f2_sniffed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, [(k, text.sniff_bytes(head.encode("latin-1")).value) for k, (head, _) in enumerate(_HEADS)], "k int, format string")


_PATHS = [("a.fa", "fasta", False), ("a.FASTA.gz", "fasta", False), ("b.fq.gz", "fastq", False), ("b.fastq", "fastq", False), ("c.bam", "bam", False), ("c.cram", "cram", False), ("c.sam", "sam", False), ("c", "sam", False), ("/dev/stdout", "bam", True), ("/dev/fd/3", "bam", True), ("/proc/self/fd/1", "bam", True), ("/dev/null", "sam", False)]


@_query(_values(_PATHS, "path, format, pseudo"))
def f4_formats_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, [(p, text.infer_format(p).value, text.is_pseudo_path(p)) for p, _, _ in _PATHS], "path string, format string, pseudo boolean")


_HEADERS = [("@HD\tVN:1.6\tSO:queryname", True, False), ("@HD\tVN:1.6\tGO:query", True, False), ("@HD\tVN:1.6\tSO:coordinate", False, True), ("@HD\tVN:1.6", False, False), ("@CO\tSO:queryname", False, False), ("@HD\tVN:1.6\tSO:unsorted\tGO:query", True, False)]


@_query(_values([(k, g, c) for k, (_, g, c) in enumerate(_HEADERS)], "k, grouped, sorted"))
def f7_orders_of_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, [(k, text.is_query_grouped([h]), text.is_coordinate_sorted([h])) for k, (h, _, _) in enumerate(_HEADERS)], "k int, grouped boolean, sorted boolean")


_PAIRS = [("x/1", "x/2", True, True), ("x/1", "y", True, True), ("x", "x", True, False), ("x", "y", False, False), ("x", "x/2", False, False)]


@_query(_values(_PAIRS, "first, second, for_templates, for_filter"))
def g4_interleaved_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(a, b, pairing.is_interleaved([a, b]), pairing.is_interleaved([a, b], match_names=False)) for a, b, _, _ in _PAIRS]
    return _vectors(spark, rows, "first string, second string, for_templates boolean, for_filter boolean")


@_query("SELECT o_orderkey AS ord, concat('c', o_custkey) AS name FROM orders")
def p4_fasta_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lead = F.when(F.col("o_orderkey") % 3 == 0, ">").when(F.col("o_orderkey") % 3 == 1, "  >> ").otherwise("")
    return orders.select(F.col("o_orderkey").alias("ord"), names.fasta_name(F.concat(lead, F.lit("c"), F.col("o_custkey"), F.when(F.col("o_orderkey") % 2 == 0, "\tof many words ").otherwise(""))).alias("name"))


@_query("SELECT o_orderkey AS ord, regexp_replace(regexp_replace(printf('%.3f', o_orderkey / 8), '0+$', ''), '[.]$', '') AS value FROM orders")
def p25_plain_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("ord"), plain_number(F.col("o_orderkey") / 8).alias("value"))


@_query(with_views("classifications", sql="SELECT query_name, classification_code = 'C' AS classified FROM classifications"))
def p21_is_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "classifications").select("query_name", asg.is_classified(F.col("taxon_id")).alias("classified"))


@_query(with_views("alignments", sql="SELECT ord, qname AS name, seq AS r1 FROM alignments WHERE flag IN (65, 129, 69)"))
def w2_unpaired_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpaired records need no grouping: the guard lets them pass, and their names stay."""
    rows = _alignments(spark, sf_dir).withColumn("flag", F.col("flag").bitwiseAND(F.lit(~0xC1)))
    return pairing.single_templates(rows).select("ord", "name", "r1")


@_query(with_views("report", sql="SELECT CAST(taxon_id AS BIGINT) AS taxon_id, CAST(2 AS BIGINT) AS n FROM report WHERE taxon_id % 7 = 3"))
def a8_duplicate_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = view(spark, sf_dir, "report")
    return taxonomy.duplicate_taxa(report.union(report.where("taxon_id % 7 = 3 or taxon_id = 0")))


@_query("SELECT DISTINCT CAST(1000 + l_suppkey * 2 AS BIGINT) AS taxon_id FROM lineitem WHERE l_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier)")
def w9_unknown_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") * 2 + 1000).cast("long").alias("taxon_id")).union(_taxa(spark, (0, 1)))
    return taxonomy.unknown_targets(_nodes(spark, sf_dir), wanted)


@_query(f"WITH {_EDGES.strip()} SELECT CAST(parent AS BIGINT) AS parent_id, CAST(child AS BIGINT) AS taxon_id FROM edges WHERE parent IN (1, 103, 11)")
def h4_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.children_of(_nodes(spark, sf_dir), _taxa(spark, (1, 103, 11, 99999))).drop("ord")


_ENDS = "SELECT ord, concat('r', ord) AS name, seq1 AS r1, seq2 AS r2 FROM ends"


@_query(with_views("ends", sql=_ENDS))
def j7_zip_fasta_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = view(spark, sf_dir, "ends")
    return pairing.zip_pairs(*(ends.select("ord", names.fasta_name(F.concat(F.lit(">"), F.col(f"name{k}"), F.lit(" some words"))).alias("name"), F.col(f"seq{k}").alias("seq")) for k in (1, 2)))


@_query(with_views("ends", sql=_ENDS))
def j8_zip_base_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the filter go together by base names; which suffix they have is not asked."""
    ends = view(spark, sf_dir, "ends")
    return pairing.zip_pairs(*(ends.select("ord", names.fastq_base_name(F.col("name2")).alias("name"), F.col(f"seq{k}").alias("seq")) for k in (1, 2)))


@_query(with_views("pairs", sql=f"""SELECT a.ord, a.qname AS name, a.s AS r1, b.s AS r2 FROM (SELECT *, {_FORWARD} AS s FROM pairs WHERE flag & 64 <> 0) a LEFT JOIN (SELECT *, {_FORWARD} AS s FROM pairs WHERE flag & 128 <> 0) b USING (qname)"""))
def g7_templates_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input that is only grouped by name, as its header says: templates by runs of names."""
    header = ["@HD\tVN:1.6\tGO:query"]
    return pairing.alignment_templates(view(spark, sf_dir, "pairs"), text.is_query_grouped(header), "SO:queryname" in header[0])


def _listed(spark: SparkSession, sf_dir: str) -> list[dict]:
    """A taxonomy as report entries, on the driver, as it has to become header lines or a file: as many as taxa."""
    rows = view(spark, sf_dir, "taxa").orderBy("ord").collect()
    return [dict.fromkeys(embedded.KEYS) | {"pct_fragments": 0.0, "num_fragments_clade": 0, "num_fragments_direct": 0, "rank_code": "RDPS"[r.indent // 2], "taxon_id": r.taxon_id, "name": f"t{r.taxon_id}", "indent": r.indent} for r in rows]


def _entries(spark: SparkSession, listed: list) -> DataFrame:
    return spark.createDataFrame(listed, taxonomy_files.SCHEMA).select("ord", "rank_code", "taxon_id", "name", "indent")


_TAXA_SQL = "SELECT ord, substr('RDPS', CAST(indent / 2 AS INT) + 1, 1) AS rank_code, taxon_id, concat('t', taxon_id) AS name, indent FROM taxa"


@_query(with_views("taxa", sql=_TAXA_SQL))
def e3_embedded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as comment lines of a header, in shuffled chunks, and back."""
    lines = [f"@CO\t{c}" for c in embedded.to_comments(_listed(spark, sf_dir))]
    back = embedded.from_header(["@HD\tVN:1.6", *lines[::-1], "@CO\tsomething else"])
    return _entries(spark, [(k, *(e[n] for n in embedded.KEYS)) for k, e in enumerate(back)])


_RANKS = {"R": "root", "D": "domain", "P": "phylum", "S": "species"}


@_query(with_views("taxa", sql=_TAXA_SQL))
def s14_taxonomy_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dumps of a taxonomy, in an order that has nothing to do with the tree, read by the driver."""
    listed, parent, path = _listed(spark, sf_dir), {}, []
    for e in listed:
        del path[e["indent"] // 2 :]
        parent[e["taxon_id"]] = path[-1] if path else e["taxon_id"]
        path.append(e["taxon_id"])
    by_id = sorted(listed, key=lambda e: (e["taxon_id"] * 7919) % 10007)
    nodes = [f"{e['taxon_id']}\t|\t{parent[e['taxon_id']]}\t|\t{_RANKS[e['rank_code']]}\t|" for e in by_id]
    each = [f"{e['taxon_id']}\t|\t{n}\t|\t\t|\t{kind}\t|" for e in by_id for n, kind in ((f"old {e['taxon_id']}", "synonym"), (e["name"], "scientific name"))]
    return _entries(spark, taxonomy_files.parse_dump(nodes, each))


@_query(with_views("taxa", sql=_TAXA_SQL))
def s13_binary_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binary form of a taxonomy, level by level, with a node without an outer id above the domains, which is skipped."""
    listed, kids, path = _listed(spark, sf_dir), {}, []
    for e in listed:
        del path[e["indent"] // 2 :]
        kids.setdefault(path[-1] if path else None, []).append(e)
        path.append(e["taxon_id"])
    names_, ranks = b"", b"".join(r.encode() + b"\0" for r in _RANKS.values())
    hidden = {"taxon_id": 0, "name": "hidden", "rank_code": "D"}
    children = lambda e: [hidden] if e["taxon_id"] == 1 else kids[1] if e is hidden else kids.get(e["taxon_id"], [])
    order, at = [kids[None][0]], 0
    begin = {}
    while at < len(order):
        begin[at] = len(order) + 1
        order += children(order[at])
        at += 1
    packed = [taxonomy_files.NODE.pack(0, 0, 0, 0, 0, 0, 0)]
    for k, e in enumerate(order):
        n = len(children(e))
        packed.append(taxonomy_files.NODE.pack(0, begin[k] if n else 0, n, len(names_), ranks.index(_RANKS[e["rank_code"]].encode()), e["taxon_id"], 0))
        names_ += e["name"].encode() + b"\0"
    blob = taxonomy_files.MAGIC + b"".join(x.to_bytes(8, "little") for x in (len(packed), len(names_), len(ranks))) + b"".join(packed) + names_ + ranks
    return _entries(spark, taxonomy_files.parse_binary(blob))


@_query(with_views("alignments", sql=f"~ {_TARGET_SQL}, {_WALK.lstrip()}{_DECIDE}{_TEMPLATE} SELECT a.ord, a.qname, decision FROM alignments a JOIN decided USING (qname)"))
def g8_filter_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments with tags, sorted by name, and the taxonomy in their header: decided by template."""
    lines = [f"@CO\t{c}" for c in embedded.to_comments(_listed(spark, sf_dir))]
    tag = lambda name, kind, value: F.when(value.isNotNull(), F.array(F.struct(F.lit(name).alias("tag"), F.lit(kind).alias("type"), value.cast("string").alias("value")))).otherwise(F.array().cast(tags.TAGS))
    rows = _alignments(spark, sf_dir).withColumn("tags", F.concat(tag("MD", "Z", F.col("md")), tag("ti", "i", F.col("taxon")))).drop("taxon", "md")
    options = commands.FilterOptions(list(TARGETS), include_descendants=True, include_unclassified=True, allow_ancestors=True, keep_unannotated=True, **LIMITS)
    decided, _ = commands.filter_alignments(spark, ["@HD\tVN:1.6\tSO:queryname", *lines], rows, None, options)
    return decided.select("ord", "qname", "decision")


@_query(with_views("alignments", "classifications", sql="SELECT count(*) AS total, count(*) FILTER (l % 9 = 0) AS unnamed, count(*) FILTER (l % 9 <> 0) AS annotated FROM (SELECT a.ord AS l FROM alignments a JOIN classifications c ON c.query_name = a.qname)"))
def a6_annotate_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = view(spark, sf_dir, "classifications")
    rows = _alignments(spark, sf_dir).join(side.select(F.col("query_name").alias("qname")), "qname", "left_semi").withColumn("tags", F.array().cast(tags.TAGS))
    rows = rows.withColumn("qname", F.when(F.col("ord") % 9 != 0, F.col("qname")))
    return asg.annotate(rows, side.select("query_name", "taxon_id")).agg(*asg.annotate_counters(rows))


@_query(with_views("alignments", "reference", sql=f"""~ {_WALK} SELECT (SELECT count(*) FROM alignments) AS records, count(*) AS converted
FROM alignments a JOIN bases b USING (ord) JOIN reference r ON r.contig = a.rname WHERE a.flag & 4 = 0 AND substr(a.seq, CAST(b.read_at AS INT) + 1, 1) = 'N' AND a.pos + b.ref_at <= length(r.seq)"""))
def a5_revert_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nrevert.revert_n_calls(_alignments(spark, sf_dir), view(spark, sf_dir, "reference"), chunk=64).agg(*nrevert.revert_counters())


#: Bodies of embedded chunks with their index, total and payload.
_BODIES = [("1/2:abc", 1, 2, "abc"), ("2/2:", 2, 2, ""), ("abc=", 1, 1, "abc="), ("12/30:a:b/c", 12, 30, "a:b/c"), ("0/2:x", None, None, None), ("3/2:x", None, None, None)]


def _or_none(make, *arguments):
    """What make returns, or None where it refuses its arguments."""
    try:
        return make(*arguments)
    except ValueError:
        return None


@_query(_values([(b, i, t, p) for b, i, t, p in _BODIES], "body, part, total, payload"))
def e2_chunk_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(b, *(_or_none(embedded.parse_chunk, b) or (None, None, None))) for b, *_ in _BODIES]
    return _vectors(spark, rows, "body string, part int, total int, payload string")


_ADJUSTMENTS = [(None, True), (1, True), (7, True), (0, False)]


@_query(_values([(k, ok) for k, (_, ok) in enumerate(_ADJUSTMENTS)], "k, ok"))
def c7_adjustment_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, [(k, _or_none(lambda n=n: commands.FilterOptions([1], rescue_n_adjustment=n)) is not None) for k, (n, _) in enumerate(_ADJUSTMENTS)], "k int, ok boolean")


_NEEDS = [(False, False, False, True), (False, True, False, False), (False, False, True, False), (True, True, True, True), (True, False, False, True)]


@_query(_values(_NEEDS, "tree, descendants, ancestors, ok"))
def w8_tree_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = lambda d, a: commands.FilterOptions([1], include_descendants=d, allow_ancestors=a)
    rows = [(t, d, a, _or_none(lambda t=t, d=d, a=a: commands.target_sets(spark, _nodes(spark, sf_dir) if t else None, options(d, a))) is not None) for t, d, a, _ in _NEEDS]
    return _vectors(spark, rows, "tree boolean, descendants boolean, ancestors boolean, ok boolean")


@_query(_values([(q, 0 <= q <= 93) for q in (-1, 0, 40, 93, 94)], "quality, ok"))
def n4_quality_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = lambda q: _or_none(lambda: cigar.with_quality(F.lit("II"), F.array(F.lit(0)), q)) is not None
    return _vectors(spark, [(q, fits(q)) for q in (-1, 0, 40, 93, 94)], "quality int, ok boolean")


@_query("""WITH x AS (SELECT o_orderkey AS ord, o_orderkey % 3 AS a, o_custkey % 3 AS b FROM orders)
SELECT ord, (a = 0 AND b = 0) OR (a = 1 AND b = 2) AS ok FROM x""")
def p6_suffixes_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = lambda c: F.element_at(F.array(F.lit(""), F.lit("/1"), F.lit("/2")), (F.col(c) % 3 + 1).cast("int"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("ord"), names.suffixes_pair(F.concat(F.lit("r"), suffix("o_orderkey")), F.concat(F.lit("r"), suffix("o_custkey"))).alias("ok"))


@_query(with_views("reads", sql="SELECT ord, concat('>', split_part(name, ' ', 1), CASE WHEN name LIKE '% %' THEN ' lane' ELSE '' END, chr(10), seq) AS value FROM reads"))
def k3_fasta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = view(spark, sf_dir, "reads")
    rest = F.when(F.col("name").contains(" "), F.substring_index("name", " ", -1))
    return sinks.fasta_read_lines(reads.select("ord", names.fastq_name(F.col("name")).alias("name"), rest.alias("description"), "seq"))


@_query(with_views("alignments", sql="SELECT ord, concat_ws(chr(9), qname, flag, rname, pos, '60', cigar, '*', '0', '0', seq, '*', CASE WHEN md IS NULL THEN NULL ELSE concat('MD:Z:', md) END) AS value FROM alignments"))
def k4_sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("md").isNotNull(), F.array(F.struct(F.lit("MD").alias("tag"), F.lit("Z").alias("type"), F.col("md").alias("value")))).otherwise(F.array().cast(tags.TAGS))
    return bam.text_lines(_alignments(spark, sf_dir).withColumns({"tags": tag, "mapq": F.lit(60), "rnext": F.lit("*"), "pnext": F.lit(0), "tlen": F.lit(0), "qual": F.lit("*")}))


@_query(with_views("taxa", sql="SELECT ord, substr('RDPS', CAST(indent / 2 AS INT) + 1, 1) AS rank_code, taxon_id, CASE WHEN taxon_id % 2 = 0 THEN '' ELSE concat('t', taxon_id) END AS name, indent FROM taxa"))
def j10_dump_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a dump left-joined with their scientific names, which every other taxon lacks."""
    listed, path, nodes = _listed(spark, sf_dir), [], []
    for e in listed:
        del path[e["indent"] // 2 :]
        nodes.append(f"{e['taxon_id']}|{path[-1] if path else e['taxon_id']}|{_RANKS[e['rank_code']]}|")
        path.append(e["taxon_id"])
    named = [f"{e['taxon_id']} | {e['name']} | | scientific name |" for e in listed if e["taxon_id"] % 2]
    return _entries(spark, taxonomy_files.parse_dump(["short line", *nodes[::-1]], [*named, "x | y | | scientific name |"]))


@_query(_values([(p, "sam" if k in ("fasta", "fastq") else k) for p, k, _ in _PATHS], "path, format"))
def f5_alignment_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, [(p, text.alignment_format(p).value) for p, _, _ in _PATHS], "path string, format string")


_GATES = [("cram", True, True), ("bam", True, False), ("fastq", True, False), ("bam", False, True)]


@_query(_values(_GATES, "format, reference, ok"))
def f10_cram_reference_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = lambda k, r: _or_none(lambda: commands.check_cram_reference(text.Format(k), "r.fa" if r else None) or True) is not None
    return _vectors(spark, [(k, r, fits(k, r)) for k, r, _ in _GATES], "format string, reference boolean, ok boolean")


_TOGETHER = [("a", "o", "", True), ("a b", "o p", "r s", True), ("a b", "o", "", False), ("a", "o", "r s", False), ("a -", "o p", "", False), ("a b", "o /dev/stdout", "", False), ("- b", "- p", "", True), ("a b c", "o p q", "", False)]


@_query(_values(_TOGETHER, "inputs, outputs, rejects, ok"))
def x6_files_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = lambda *files: _or_none(lambda: commands.check_pairs(*(f.split() for f in files)) or True) is not None
    return _vectors(spark, [(i, o, r, fits(i, o, r)) for i, o, r, _ in _TOGETHER], "inputs string, outputs string, rejects string, ok boolean")
