"""Variant tables derived from the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_calls": """SELECT l_orderkey % 20 AS case_id, l_partkey AS site_id, l_partkey % 25 AS chrom_no,
       1000 + (l_partkey * 7919) % 200000 AS pos,
       concat('HGNC:', cast(cast(floor(l_partkey / 20) as bigint) as string)) AS gene_id,
       CASE l_partkey % 6 WHEN 0 THEN 'missense_variant' WHEN 1 THEN 'stop_gained' WHEN 2 THEN 'synonymous_variant'
            WHEN 3 THEN 'intron_variant' WHEN 4 THEN 'frameshift_variant' ELSE 'splice_region_variant' END AS csq,
       CASE (l_orderkey + l_linenumber) % 3 WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' ELSE '1/1' END AS gt_index,
       CASE (cast(floor(l_orderkey / 3) as bigint) + cast(l_quantity as bigint)) % 3 WHEN 0 THEN '0/0' WHEN 1 THEN '0|1' ELSE '1/1' END AS gt_father,
       CASE (l_suppkey + l_linenumber) % 4 WHEN 0 THEN '0/0' WHEN 1 THEN '1/0' WHEN 2 THEN '1|1' ELSE './.' END AS gt_mother,
       cast(l_quantity as bigint) AS dp, cast(floor(l_quantity * (l_suppkey % 11) / 10) as bigint) AS ad,
       l_suppkey % 100 AS gq, l_orderkey % 400 AS exon_dist,
       1000 AS an, l_partkey % 7 AS het, l_partkey % 3 AS hom, l_partkey % 2 AS hemi
FROM lineitem""",
    "fx_sv": """SELECT o_orderkey AS sv_id, o_custkey % 20 AS case_id, o_custkey % 25 AS chrom_no,
       1000 + (o_orderkey * 7919) % 200000 AS pos,
       1000 + (o_orderkey * 7919) % 200000 + 50 + cast(floor(o_totalprice) as bigint) % 5000 AS sv_end,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'DEL' WHEN '2-HIGH' THEN 'DUP' WHEN '3-MEDIUM' THEN 'INV'
            WHEN '4-NOT SPECIFIED' THEN 'INS' ELSE 'BND' END AS sv_type,
       CASE o_orderstatus WHEN 'F' THEN '0/1' WHEN 'O' THEN '1/1' ELSE '0/0' END AS gt
FROM orders""",
    "fx_bg": """SELECT CASE l_returnflag WHEN 'A' THEN 'dgv' WHEN 'N' THEN 'gnomad' ELSE 'inhouse' END AS source,
       l_suppkey % 25 AS chrom_no, 999 + (l_partkey * 7919 + l_linenumber * 13) % 200000 AS b,
       999 + (l_partkey * 7919 + l_linenumber * 13) % 200000 + 50 + cast(floor(l_extendedprice) as bigint) % 5000 AS e,
       CASE l_linenumber % 6 WHEN 0 THEN 'DEL' WHEN 1 THEN 'DUP' WHEN 2 THEN 'INV' WHEN 3 THEN 'INS' WHEN 4 THEN 'BND' ELSE 'CNV' END AS sv_type,
       cast(l_quantity as bigint) AS cnt
FROM lineitem""",
    "fx_region": """SELECT p_partkey AS region_id, p_partkey % 25 AS chrom_no, CASE p_size % 3 WHEN 0 THEN 'repeat' WHEN 1 THEN 'segdup' ELSE 'tad' END AS kind,
       (p_partkey * 104729) % 200000 AS b, (p_partkey * 104729) % 200000 + 20 + p_size * 100 AS e
FROM part""",
    "fx_exon": """SELECT p_partkey AS tx_id, concat('HGNC:', cast(cast(floor(p_partkey / 20) as bigint) as string)) AS gene_id, p_partkey % 25 AS chrom_no,
       CASE p_size % 2 WHEN 0 THEN '+' ELSE '-' END AS strand, k AS exon_no,
       6000 + (p_partkey * 15485863) % 190000 + k * 1000 AS exon_start, 6000 + (p_partkey * 15485863) % 190000 + k * 1000 + 200 + p_size AS exon_end
FROM part CROSS JOIN (VALUES (0), (1), (2)) AS v(k)""",
    "fx_wide": """SELECT o_orderkey AS sv_id, o_custkey % 25 AS chrom_no, 1000 + (o_orderkey * 7919 + o_custkey * 104729) % 90000000 AS pos,
       1000 + (o_orderkey * 7919 + o_custkey * 104729) % 90000000 + CASE o_orderkey % 50 WHEN 0 THEN 3000000 WHEN 1 THEN 400000 WHEN 2 THEN 40000 ELSE 200 END + cast(floor(o_totalprice) as bigint) % 300 AS sv_end,
       CASE o_orderkey % 4 WHEN 0 THEN 'CNV' WHEN 1 THEN 'DEL' WHEN 2 THEN 'DUP' ELSE 'INV' END AS sv_type, o_custkey % 9 AS cnt
FROM orders""",
    "fx_ped": """SELECT DISTINCT l_orderkey % 20 AS case_id, CASE (l_orderkey % 20) % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Unknown' END AS sex_index
FROM lineitem""",
}
BASE = {"fx_calls": "lineitem", "fx_sv": "orders", "fx_wide": "orders", "fx_bg": "lineitem", "fx_region": "part", "fx_exon": "part", "fx_ped": "lineitem"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = BASE[name]
    return spark.sql(VIEWS[name].replace(f"FROM {base}", f"FROM {{{base}}}"), **{base: spark.read.parquet(f"{sf_dir}/{base}.parquet")})


def with_views(sql: str, *names: str) -> str:
    """sql for DuckDB with the views in front."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql
