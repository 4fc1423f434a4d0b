"""Dirty versions of the given tables, written once and used by both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINEITEM = """
SELECT (l_orderkey * 10 + l_linenumber) * 100 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate) AS _row_id, l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 101 = 0 THEN -l_quantity ELSE l_quantity END AS cantidad,
  CASE WHEN l_orderkey % 89 = 0 THEN l_extendedprice * 1000 ELSE l_extendedprice END AS precio_unitario,
  CASE WHEN l_partkey % 83 = 0 THEN round(l_quantity * l_extendedprice, 2) + 500
       ELSE round(l_quantity * l_extendedprice, 2) END AS total,
  l_discount, l_tax, l_returnflag, l_shipdate
FROM lineitem
"""

CUSTOMER = """
SELECT c_custkey * 10 AS _row_id, c_custkey AS id,
  CASE WHEN c_custkey % 13 = 0 THEN lower(c_name) WHEN c_custkey % 17 = 0 THEN concat('  ', c_name, ' ')
       ELSE c_name END AS nombre,
  CASE WHEN c_custkey % 11 = 0 THEN concat('user', CAST(c_custkey AS STRING), '@@mail')
       WHEN c_custkey % 19 = 0 THEN '' ELSE concat('user', CAST(c_custkey AS STRING), '@mail.com') END AS email,
  CASE WHEN c_custkey % 7 = 0 THEN '12-34'
       ELSE concat('8', lpad(CAST(c_custkey AS STRING), 7, '0')) END AS telefono,
  CASE WHEN c_custkey % 23 = 0 THEN 'n/a'
       WHEN c_custkey % 5 = 0 THEN concat('$', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING))
       ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) END AS saldo,
  CASE WHEN c_custkey % 31 = 0 THEN 'HOUSEHOLDD' WHEN c_custkey % 37 = 0 THEN lower(c_mktsegment)
       ELSE c_mktsegment END AS segmento,
  CASE WHEN c_custkey % 3 = 0 THEN 'activo' WHEN c_custkey % 41 = 0 THEN 'zzz' ELSE 'Inactivo ' END AS estado,
  c_nationkey AS nacion
FROM customer
UNION ALL
SELECT c_custkey * 10 + n, c_custkey, c_name, concat('user', CAST(c_custkey AS STRING), '@mail.com'), '80000000', '0',
  c_mktsegment, 'activo', c_nationkey
FROM customer CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) copies WHERE c_custkey % 50 = 1
"""

ORDERS = """
SELECT o_orderkey AS _row_id, o_orderkey AS id_pedido,
  concat(CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 4 = 0 THEN '.0' ELSE '' END) AS id_cliente,
  CASE WHEN o_orderkey % 43 = 0 THEN '2024-13-01' WHEN o_orderkey % 47 = 0 THEN 'Pendiente'
       WHEN o_orderkey % 3 = 0 THEN {dmy} ELSE {ymd} END AS fecha_pago,
  o_totalprice AS monto, o_orderpriority AS prioridad
FROM orders
"""

GEO = """
SELECT c_custkey AS _row_id,
  CASE WHEN c_custkey % 9 = 0 THEN CAST(9000000 + c_custkey * 7 AS STRING)
       WHEN c_custkey % 8 = 0 THEN concat('9,', CAST(10000 + c_custkey AS STRING))
       WHEN c_custkey % 17 = 0 THEN 'sin dato'
       ELSE concat('9.', CAST(10000 + c_custkey AS STRING)) END AS latitud,
  CASE WHEN c_custkey % 6 = 0 THEN CAST(-84000000 - c_custkey AS STRING)
       ELSE concat('-84.', CAST(100000 + c_custkey AS STRING)) END AS longitud,
  c_nationkey AS nacion
FROM customer
"""

_SPARK = {"dmy": "date_format(o_orderdate, 'dd/MM/yyyy')", "ymd": "date_format(o_orderdate, 'yyyy-MM-dd')"}
_DUCK = {"dmy": "strftime(o_orderdate, '%d/%m/%Y')", "ymd": "strftime(o_orderdate, '%Y-%m-%d')"}
DIRTY = {"dirty_lineitem": (LINEITEM, "lineitem"), "dirty_customer": (CUSTOMER, "customer"),
         "dirty_orders": (ORDERS, "orders"), "dirty_geo": (GEO, "customer")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, source = DIRTY[name]
    sql = sql.format(**_SPARK) if name == "dirty_orders" else sql
    return spark.sql(sql.replace(f"FROM {source}", "FROM {src}"), src=table(spark, sf_dir, source))


def duck(*fixtures: str) -> str:
    """'WITH dirty_x AS (...), ' prefix for a DuckDB twin (ends ready for more CTEs or the SELECT)."""
    parts = []
    for name in fixtures:
        sql = DIRTY[name][0]
        sql = sql.format(**_DUCK) if name == "dirty_orders" else sql
        parts.append(f"{name} AS ({sql.strip()})")
    return "WITH " + ", ".join(parts)
