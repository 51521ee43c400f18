"""Genomic-looking views of the given tables, in SQL that Spark and DuckDB both run; {table} stands for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ORDER = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity)"
_SEQ = "translate(upper(md5({0})), '0123456789ABCDEF', 'ACGTNACGTACGTACG')"
_READ_SEQ = _SEQ.format("concat(l_orderkey, '-', l_partkey, '-', l_linenumber)")

VIEWS = {
    "reads": f"""
SELECT CAST(l_orderkey * 64 + {_ORDER} AS BIGINT) AS ord,
  concat('q', l_orderkey, CASE l_linenumber % 3 WHEN 1 THEN '/1' WHEN 2 THEN '/2' ELSE '' END, CASE WHEN l_partkey % 5 = 0 THEN ' lane' ELSE '' END) AS name,
  {_READ_SEQ} AS seq
FROM {{lineitem}}""",
    "classifications": """
SELECT CASE WHEN o_orderstatus = 'P' THEN 'U' ELSE 'C' END AS classification_code, concat('q', o_orderkey) AS query_name,
  CAST(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 100 + c_nationkey END AS BIGINT) AS taxon_id
FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderkey % 17 <> 0""",
    "report": """
SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS BIGINT) AS ord, CAST(0 AS DOUBLE) AS pct_fragments, CAST(clade AS BIGINT) AS num_fragments_clade,
  CAST(direct AS BIGINT) AS num_fragments_direct, rank_code, CAST(taxon_id AS BIGINT) AS taxon_id, name, CAST(indent AS INT) AS indent,
  CAST(NULL AS BIGINT) AS minimizer_count, CAST(NULL AS BIGINT) AS distinct_minimizer_count
FROM (
  SELECT -2 AS a, -1 AS b, -1 AS c, count(*) AS clade, count(*) AS direct, 'U' AS rank_code, 0 AS taxon_id, 'unclassified' AS name, 0 AS indent FROM {orders} WHERE o_orderstatus = 'P'
  UNION ALL SELECT -1, -1, -1, count(*), 0, 'R', 1, 'root', 0 FROM {lineitem}
  UNION ALL SELECT r_regionkey, -1, -1, count(l_orderkey), 0, 'D', 10 + r_regionkey, r_name, 2
    FROM {region} LEFT JOIN {nation} ON n_regionkey = r_regionkey LEFT JOIN {supplier} ON s_nationkey = n_nationkey LEFT JOIN {lineitem} ON l_suppkey = s_suppkey GROUP BY r_regionkey, r_name
  UNION ALL SELECT n_regionkey, n_nationkey, -1, count(l_orderkey), 0, 'P', 100 + n_nationkey, n_name, 4
    FROM {nation} LEFT JOIN {supplier} ON s_nationkey = n_nationkey LEFT JOIN {lineitem} ON l_suppkey = s_suppkey GROUP BY n_regionkey, n_nationkey, n_name
  UNION ALL SELECT n_regionkey, n_nationkey, s_suppkey, count(l_orderkey), count(l_orderkey), 'S', 1000 + s_suppkey, s_name, 6
    FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey LEFT JOIN {lineitem} ON l_suppkey = s_suppkey GROUP BY n_regionkey, n_nationkey, s_suppkey, s_name
) AS entries""",
    "taxa": """
SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS BIGINT) AS ord, CAST(taxon_id AS BIGINT) AS taxon_id, CAST(indent AS INT) AS indent
FROM (
  SELECT -1 AS a, -1 AS b, -1 AS c, 1 AS taxon_id, 0 AS indent
  UNION ALL SELECT r_regionkey, -1, -1, 10 + r_regionkey, 2 FROM {region}
  UNION ALL SELECT n_regionkey, n_nationkey, -1, 100 + n_nationkey, 4 FROM {nation}
  UNION ALL SELECT n_regionkey, n_nationkey, s_suppkey, 1000 + s_suppkey, 6 FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
) AS entries""",
    "alignments": f"""
SELECT CAST(l_orderkey * 64 + {_ORDER} AS BIGINT) AS ord, concat('q', l_orderkey) AS qname,
  CAST(CASE l_linenumber WHEN 1 THEN 65 WHEN 2 THEN 129 WHEN 3 THEN 321 WHEN 4 THEN 2113 WHEN 5 THEN 69 WHEN 6 THEN 65 ELSE 129 END AS INT) AS flag,
  concat('chr', l_suppkey % 4) AS rname, CAST(1 + l_partkey % 190 AS INT) AS pos,
  CASE l_partkey % 6 WHEN 0 THEN '32M' WHEN 1 THEN '10M2I20M' WHEN 2 THEN '12M3D20M' WHEN 3 THEN '4S28M' WHEN 4 THEN '16M1I5M2D10M' ELSE '8=4X20M' END AS cigar,
  {_READ_SEQ} AS seq,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CASE l_partkey % 6 WHEN 0 THEN '10A21' WHEN 1 THEN '5C4G19' WHEN 2 THEN '12^ACG20' WHEN 3 THEN '3T24' WHEN 4 THEN '16A4^AC10' ELSE '2A1T2G40C' END END AS md,
  CAST(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL WHEN l_partkey % 13 = 0 THEN 100 + l_suppkey % 25 WHEN l_partkey % 13 = 1 THEN 10 + l_suppkey % 5 WHEN l_partkey % 13 = 2 THEN 1 ELSE 1000 + l_suppkey END AS BIGINT) AS taxon
FROM {{lineitem}}""",
    "pairs": f"""
SELECT CAST(l_orderkey * 64 + k AS BIGINT) AS ord, concat('q', l_orderkey) AS qname, CAST(CASE k WHEN 1 THEN 65 ELSE 129 END + CASE WHEN l_partkey % 2 = 0 THEN 16 ELSE 0 END AS INT) AS flag, seq
FROM (SELECT *, {_ORDER} AS k, {_READ_SEQ} AS seq FROM {{lineitem}}) AS ranked WHERE k <= 2""",
    "ends": f"""
SELECT CAST(o_orderkey AS BIGINT) AS ord, concat('r', o_orderkey, '/1') AS name1, concat('r', o_orderkey, '/2') AS name2, {_SEQ.format("concat(o_orderkey, 'a')")} AS seq1, {_SEQ.format("concat(o_orderkey, 'b')")} AS seq2
FROM {{orders}}""",
    "reference": "SELECT concat('chr', r_regionkey) AS contig, translate(upper(concat(" + ", ".join(f"md5(concat(r_regionkey, 'x{k}'))" for k in range(7)) + ")), '0123456789ABCDEF', 'ACGTNACGTACGTACG') AS seq FROM {region}",
}

TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql})


def plain(name: str) -> str:
    """The view for an engine that has the tables by name."""
    return VIEWS[name].format(**{t: t for t in TABLES})


def with_views(*names: str, sql: str, recursive: bool = False) -> str:
    head = ", ".join(f"{n} AS ({plain(n)})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' if sql.lstrip().startswith('~') else ' '}{sql.lstrip().removeprefix('~')}"
