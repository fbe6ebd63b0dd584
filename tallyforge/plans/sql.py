"""SQL texts that the oracles share."""

from __future__ import annotations

from tallyforge.sources.views import EXECUTION_ORDER, EXECUTIONS, oracle

ORDER = ", ".join(EXECUTION_ORDER)
BASE = (
    "CASE WHEN symbol LIKE '%USDT' THEN replace(symbol, 'USDT', '') WHEN symbol LIKE '%USDC' THEN replace(symbol, 'USDC', '') "
    "WHEN symbol LIKE '%USD' THEN replace(symbol, 'USD', '') ELSE substr(symbol, 1, 3) END"
)
QUOTE = "CASE WHEN symbol LIKE '%USDT' THEN 'USDT' WHEN symbol LIKE '%USDC' THEN 'USDC' WHEN symbol LIKE '%USD' THEN 'USD' ELSE right(symbol, 4) END"
VALUE = "CAST(CAST(quantity AS DECIMAL(18, 4)) * CAST(price AS DECIMAL(18, 4)) AS DECIMAL(20, 8))"

LEDGER = f"""
ex AS ({oracle(EXECUTIONS)}),
parts AS (SELECT *, upper({BASE}) AS base, upper({QUOTE}) AS quote FROM ex),
ev AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY trade_id, account_id, base ORDER BY {ORDER}) = 1),
legs AS (
  SELECT *, 0 AS leg, base AS asset, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS amount, 'TRADE' AS entry_type FROM ev
  UNION ALL SELECT *, 1, quote, CASE WHEN side = 'BUY' THEN -{VALUE} ELSE {VALUE} END, 'TRADE' FROM ev
  UNION ALL SELECT *, 2, coalesce(fee_asset, quote), -fee, 'FEE' FROM ev WHERE fee > 0
), keyed AS (SELECT *, trade_id || ':' || CAST(account_id AS STRING) || ':' || asset || ':' || entry_type AS idempotency_key FROM legs),
firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY {ORDER}, leg) = 1),
ledger AS (SELECT row_number() OVER (ORDER BY {ORDER}, leg, idempotency_key) AS id, account_id, asset, CAST(amount AS DECIMAL(20, 8)) AS amount, entry_type, trade_id, idempotency_key, executed_at AS created_at FROM firsts)
"""

#: Clearing results, batches and outbox rows made of the orders table.
RESULTS = """
SELECT o_orderkey AS id, o_orderkey % 50 AS batch_id, CAST(o_orderdate AS DATE) AS business_date, o_custkey AS account_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'usdt' WHEN 1 THEN 'USDT' ELSE 'KRW' END AS asset, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DECIMAL(20, 8)) AS closing_balance,
       CAST(0 AS DECIMAL(20, 8)) AS opening_balance, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DECIMAL(20, 8)) AS net_change, CAST(0 AS DECIMAL(20, 8)) AS fee_total,
       CAST(o_orderkey % 4 AS BIGINT) AS trade_count, CAST(o_orderkey % 9 AS DECIMAL(20, 8)) AS trade_value, CASE WHEN o_orderkey % 7 = 0 THEN 'PRELIMINARY' ELSE 'FINAL' END AS status
FROM {orders}
"""
BATCHES = """
SELECT DISTINCT o_orderkey % 50 AS id, CAST('1998-01-01' AS DATE) AS business_date, CASE WHEN o_orderkey % 50 % 4 = 0 THEN 'INTRADAY' ELSE 'EOD' END AS batch_type,
       'RUN' AS run_key, CAST(1 + o_orderkey % 50 % 3 AS INT) AS attempt, CASE o_orderkey % 50 % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RUNNING' ELSE 'SUCCESS' END AS status,
       CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'account:1-100' END AS scope, 'WM-' || CAST(o_orderkey % 50 AS STRING) AS snapshot_key,
       CAST('1998-01-01 12:00:00' AS TIMESTAMP) AS finished_at
FROM {orders}
"""
OUTBOX = """
SELECT 'CLEARING' AS producer_type, CASE WHEN o_orderkey % 11 = 0 THEN 'OTHER' ELSE 'SETTLEMENT' END AS event_type, 'CLEARING_RESULT' AS aggregate_type, o_orderkey % 50 AS aggregate_id,
       'clearing:settlement:' || CAST(o_orderkey % 50 AS STRING) || ':' || CAST(o_custkey AS STRING) || ':' || CASE WHEN o_orderkey % 3 = 2 THEN 'KRW' ELSE 'USDT' END AS idempotency_key,
       CASE o_orderkey % 6 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'SENT' ELSE 'PENDING' END AS status, CAST(o_orderkey % 5 AS INT) AS retry_count, o_orderdate AS created_at, o_orderkey AS seq
FROM {orders} WHERE o_orderkey % 13 <> 0
"""


def out(x: str) -> str:
    """An amount as the queries return it: four places, as double."""
    return f"CAST(CAST({x} AS DECIMAL(38, 4)) AS DOUBLE)"
