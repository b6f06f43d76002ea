"""Derived corpora: a narrative and a property graph from the tables of customers, suppliers, nations and regions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Digits would end a name, so keys are spelled with letters.
_SPELLED = "translate(CAST({} AS STRING), '0123456789', 'abcdefghij')"
NAME = {k: f"concat('{p}', {_SPELLED.format(c)})" for k, (p, c) in {"customer": ("Cust", "c_custkey"), "supplier": ("Supp", "s_suppkey"), "nation": ("Nation", "n_nationkey")}.items()}

#: The same text for Spark and for the oracle.
SENTENCES = f"""
SELECT CAST(c_nationkey AS BIGINT) AS document_id, 0 AS kind, CAST(c_custkey AS BIGINT) AS k, concat({NAME['customer']}, ' lives in Nation', {_SPELLED.format('c_nationkey')}, '.') AS text FROM customer
UNION ALL SELECT CAST(s_nationkey AS BIGINT), 1, CAST(s_suppkey AS BIGINT), concat({NAME['supplier']}, ' is based in Nation', {_SPELLED.format('s_nationkey')}, '.') FROM supplier
UNION ALL SELECT CAST(n_nationkey AS BIGINT), 2, CAST(n_nationkey AS BIGINT), concat({NAME['nation']}, ' is part of ', substring(r_name, 1, 1), lower(substring(r_name, 2)), '.') FROM nation JOIN region ON n_regionkey = r_regionkey
"""
CHUNKS = f"""
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY kind, k) - 1 AS INT) AS chunk_id, text FROM ({SENTENCES}) s
"""
NODES = f"""
SELECT CAST(n_regionkey AS BIGINT) AS document_id, {NAME['customer']} AS name, 'Person' AS label FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT CAST(n_regionkey AS BIGINT), {NAME['supplier']}, 'Organization' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT CAST(n_regionkey AS BIGINT), {NAME['nation']}, 'Location' FROM nation
UNION ALL SELECT CAST(r_regionkey AS BIGINT), concat('Region', {_SPELLED.format('r_regionkey')}), 'Location' FROM region
"""
EDGES = f"""
SELECT CAST(n_regionkey AS BIGINT) AS document_id, {NAME['customer']} AS source_name, 'Person' AS source_label, {NAME['nation']} AS target_name, 'Location' AS target_label, 'LIVES_IN' AS type FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT CAST(n_regionkey AS BIGINT), {NAME['supplier']}, 'Organization', {NAME['nation']}, 'Location', 'LOCATED_IN' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT CAST(n_regionkey AS BIGINT), {NAME['nation']}, 'Location', concat('Region', {_SPELLED.format('n_regionkey')}), 'Location', 'PART_OF' FROM nation WHERE n_nationkey % 7 <> 3
"""


def _of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over one folder's tables, given as frames: no view of the session is made or used."""
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "supplier", "nation", "region")}
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", sql), **tables)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, f"SELECT *, 0 AS start_index, length(text) AS end_index FROM ({CHUNKS}) c")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, f"SELECT concat(CAST(document_id AS STRING), ':', label, ':', name) AS id, * FROM ({NODES}) n")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = "concat(CAST(document_id AS STRING), ':', source_label, ':', source_name) AS source, concat(CAST(document_id AS STRING), ':', target_label, ':', target_name) AS target"
    return _of(spark, sf_dir, f"SELECT concat(source, '-', type, '-', target) AS id, * FROM (SELECT {ends}, * FROM ({EDGES}) e) x")
