"""The driver's tables as an architecture graph: plain SELECTs, whose text other engines run, too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.roles import CONTROLLER, SERVICE
from tesserae.schema import EVIDENCE

SUBJECT, SCAN = "shop", "scan-1"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "pages")

NODES_SQL = f"""
SELECT concat('geo.region.', r_regionkey) AS id, 'MODULE' AS type, CAST(NULL AS {{text}}) AS adapter, CAST(NULL AS {{text}}) AS descr, CAST(NULL AS {{text}}) AS annotation FROM {{region}}
UNION ALL SELECT concat('geo.nation.', n_nationkey), 'CONFIG', NULL, NULL, NULL FROM {{nation}}
UNION ALL SELECT concat('web.customer.', c_custkey), 'COMPONENT', CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'spring' END,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'annotated class' END, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '{CONTROLLER}' END FROM {{customer}}
UNION ALL SELECT concat('app.order.', o_orderkey), 'FUNCTION', CASE WHEN o_orderstatus <> 'P' THEN 'spring' END, CASE WHEN o_orderstatus <> 'P' THEN 'annotated class' END,
  CASE WHEN o_orderstatus <> 'P' THEN '{SERVICE}' END FROM {{orders}}
UNION ALL SELECT concat('domain.part.', p_partkey), 'DATA', NULL, NULL, NULL FROM {{part}}
UNION ALL SELECT concat('store.supplier.', s_suppkey), 'COMPONENT', 'spring-data', 'repository interface', NULL FROM {{supplier}}
UNION ALL SELECT concat('view.page.', page_id), 'VIEW', CASE WHEN html LIKE '%&amp;%' OR page_id % 3 = 0 THEN 'jsp' END,
  CASE WHEN html LIKE '%&amp;%' THEN 'renders escaped output' WHEN page_id % 3 = 0 THEN 'renders unescaped output' END, NULL FROM {{pages}}
"""

EDGES_SQL = """
SELECT concat('web.customer.', o_custkey) AS src, concat('app.order.', o_orderkey) AS dst, CAST(NULL AS {text}) AS dst_desc, 'CALL' AS relation, 'UNKNOWN' AS ctx FROM {orders}
UNION ALL SELECT concat('app.order.', l_orderkey), concat('store.supplier.', l_suppkey), NULL, 'CALL', CASE WHEN l_linenumber > 1 THEN 'ITERATED' ELSE 'UNKNOWN' END FROM {lineitem}
UNION ALL SELECT concat('app.order.', l_orderkey), concat('domain.part.', l_partkey), NULL, 'DEPENDS', 'UNKNOWN' FROM {lineitem}
UNION ALL SELECT concat('web.customer.', o_custkey), concat('store.supplier.', l_suppkey), NULL, 'CALL', 'UNKNOWN' FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'
UNION ALL SELECT concat('store.supplier.', l_suppkey), concat('app.order.', l_orderkey), NULL, 'CALL', 'UNKNOWN' FROM {lineitem} WHERE l_returnflag = 'R'
UNION ALL SELECT concat('web.customer.', c_custkey), concat('web.customer.', CAST(floor(c_custkey / 2) AS BIGINT)), NULL, 'EXTENDS', 'UNKNOWN' FROM {customer} WHERE c_custkey >= 1
UNION ALL SELECT concat('app.order.', l_orderkey), NULL, 'external carrier', 'COMMUNICATES', 'UNKNOWN' FROM {lineitem} WHERE l_discount = 0
UNION ALL SELECT concat('store.supplier.', s_suppkey), concat('geo.nation.', s_nationkey), NULL, 'CONFIGURES', 'UNKNOWN' FROM {supplier}
UNION ALL SELECT concat('geo.nation.', n_nationkey), concat('geo.region.', n_regionkey), NULL, 'MEMBER_OF', 'UNKNOWN' FROM {nation}
"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def _sql(spark: SparkSession, text: str, sf_dir: str) -> DataFrame:
    used = {k: v for k, v in tables(spark, sf_dir).items() if f"{{{k}}}" in text}
    return spark.sql(text.replace("{text}", "STRING"), **used)


def node_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, scan_id, id, type, attributes, evidence)."""
    rows = _sql(spark, NODES_SQL, sf_dir)
    attributes = F.when(F.col("annotation").isNotNull(), F.create_map(F.lit("annotation"), "annotation")).otherwise(F.create_map().cast("map<string,string>"))
    item = F.struct(F.col("adapter").alias("source_adapter"), F.col("descr").alias("description"), F.lit(None).cast("string").alias("location"), F.lit("L2_SYMBOL_RESOLVED").alias("fidelity"), F.lit("UNKNOWN").alias("execution_context"), attributes.alias("attributes"))
    listed = F.when(F.col("adapter").isNotNull(), F.array(item)).otherwise(F.array().cast(f"array<{EVIDENCE}>"))
    return rows.select(F.lit(SUBJECT).alias("subject_id"), F.lit(SCAN).alias("scan_id"), "id", "type", F.create_map().cast("map<string,string>").alias("attributes"), listed.alias("evidence"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_facts(spark, sf_dir).select("subject_id", "scan_id", F.monotonically_increasing_id().alias("node_seq"), "id", "type", F.lit("UNKNOWN").alias("role"), "attributes", "evidence")


def edges(spark: SparkSession, sf_dir: str, relations: Sequence[str] | None = None) -> DataFrame:
    """All edges, or those of some relations, for which no table is read that has none."""
    rows = _sql(spark, EDGES_SQL, sf_dir)
    if relations is not None:
        rows = rows.where(F.col("relation").isin(*relations))
    empty = F.create_map().cast("map<string,string>")
    item = F.struct(F.lit("bridge").alias("source_adapter"), F.col("relation").alias("description"), F.lit(None).cast("string").alias("location"), F.lit("L1_SYNTAX").alias("fidelity"), F.col("ctx").alias("execution_context"), empty.alias("attributes"))
    return rows.select(
        F.lit(SUBJECT).alias("subject_id"), F.lit(SCAN).alias("scan_id"), F.monotonically_increasing_id().alias("edge_seq"), F.lit(True).alias("src_resolved"), F.col("src").alias("src_id"), F.lit(None).cast("string").alias("src_desc"),
        F.col("dst").isNotNull().alias("dst_resolved"), F.col("dst").alias("dst_id"), "dst_desc", "relation", F.array(item).alias("provenance"),
    )
