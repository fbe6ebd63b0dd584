"""Domain views over the test tables: one SQL text each, for Spark and for the DuckDB oracles.

Tables stand in braces. Doubles are cast to decimal(18,2) before anything is computed from them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SYMBOL = "CASE {0} % 6 WHEN 0 THEN 'BTCUSDT' WHEN 1 THEN 'ETHUSDT' WHEN 2 THEN 'SOLUSDC' WHEN 3 THEN 'XRPUSD' WHEN 4 THEN 'BTCKRW' ELSE 'ETHBTC' END"

EXECUTIONS = f"""
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS trade_id, o_custkey AS account_id, {SYMBOL.format("l_partkey")} AS symbol,
       CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(CAST(l_quantity AS DECIMAL(18, 2)) AS DECIMAL(20, 8)) AS quantity,
       CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DECIMAL(20, 8)) AS price,
       CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_tax AS DECIMAL(18, 2)) AS DECIMAL(20, 8)) AS fee, CAST(NULL AS STRING) AS fee_asset,
       l_shipdate AS executed_at, CASE WHEN l_linestatus = 'O' THEN 'TAKER' ELSE 'MAKER' END AS liquidity, l_orderkey AS order_id,
       l_partkey AS k1, l_suppkey AS k2, l_discount AS k3, l_tax AS k4, l_returnflag || l_linestatus AS k5
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
"""
#: A total order of executions: rows that are equal in it are equal in all that is posted.
EXECUTION_ORDER = ("executed_at", "k1", "k2", "quantity", "price", "k3", "k4", "k5")

#: Sides alternate within a symbol, so that orders meet.
ORDER_COMMANDS = f"""
SELECT 'NEW' AS command_type, o_custkey AS user_id, 'c-' || CAST(o_orderkey AS STRING) AS client_order_id, {SYMBOL.format("o_orderkey")} AS symbol,
       CASE WHEN CAST(floor(o_orderkey / 6) AS BIGINT) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 'LIMIT' AS order_type,
       CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN 'IOC' ELSE 'GTC' END AS time_in_force, CAST(100 + o_custkey % 20 AS DECIMAL(20, 8)) AS price,
       CAST(1 + o_orderkey % 9 AS DECIMAL(20, 8)) AS quantity, CAST(NULL AS STRING) AS cancel_by, CAST(NULL AS STRING) AS cancel_value, o_orderdate AS received_at,
       o_orderkey AS seq, CAST(o_orderkey % 6 AS INT) AS source_partition, 2 * o_orderkey AS source_offset
FROM {{orders}}
UNION ALL
SELECT 'CANCEL', o_custkey, 'c-' || CAST(o_orderkey AS STRING), {SYMBOL.format("o_orderkey")}, NULL, NULL, NULL, NULL, NULL, 'CLIENT_ORDER_ID',
       'c-' || CAST(o_orderkey AS STRING), o_orderdate + INTERVAL 1 DAY, o_orderkey, CAST(o_orderkey % 6 AS INT), 2 * o_orderkey + 1
FROM {{orders}} WHERE o_orderstatus = 'P'
"""

ORDER_UPDATES = f"""
SELECT l_orderkey AS order_id, o_custkey AS account_id, 'c-' || CAST(l_orderkey AS STRING) AS client_order_id, {SYMBOL.format("l_orderkey")} AS symbol,
       CASE WHEN l_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(CAST(l_quantity AS DECIMAL(18, 2)) AS DECIMAL(18, 8)) AS filled_quantity,
       CASE WHEN l_linestatus = 'F' THEN 'FILLED' WHEN l_returnflag = 'R' THEN 'CANCELED' WHEN l_returnflag = 'A' THEN 'PARTIALLY_FILLED' ELSE 'NEW' END AS new_status,
       CAST(l_linenumber AS BIGINT) AS event_seq, l_shipdate AS event_time, l_partkey AS k1, l_suppkey AS k2, l_extendedprice AS k3, l_discount AS k4, l_tax AS k5
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
"""

ACTIVITY = f"""
SELECT event_id, user_id AS account_id, {SYMBOL.format("event_id")} AS symbol, CASE event_type WHEN 'click' THEN 'NEW' ELSE 'CANCEL' END AS command_type,
       CAST(CAST(value AS DECIMAL(18, 2)) AS DECIMAL(20, 8)) AS quantity, ts
FROM {{events}} WHERE event_type IN ('click', 'error')
"""

#: Stored trading orders: one for each row of orders.
TRADING_ORDERS = f"""
SELECT o_orderkey AS order_id, 'c-' || CAST(o_orderkey AS STRING) AS client_order_id, o_custkey AS user_id, {SYMBOL.format("o_orderkey")} AS symbol,
       CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS order_side, CASE o_orderstatus WHEN 'O' THEN 'NEW' WHEN 'F' THEN 'FILLED' ELSE 'PARTIALLY_FILLED' END AS status,
       CAST(100 + o_custkey % 20 AS DECIMAL(18, 8)) AS price, CAST(1 + o_orderkey % 9 AS DECIMAL(18, 8)) AS quantity, o_orderdate AS created_at
FROM {{orders}}
"""

TABLES = ("lineitem", "orders", "events", "customer", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view over the tables of a folder."""
    used = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def oracle(sql: str) -> str:
    """The same text for an engine where the tables are views."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
