"""Shared parts of the oracle SQL: the event logs, the split and the three models, as common table expressions."""

from __future__ import annotations

CATEGORY = "lower(concat_ws('.', p_type, split_part(p_name,' ',2), split_part(p_name,' ',1)))"

LOG = f"""log AS (
 SELECT event_id, user_id, item_id, concat(user_id,'-',strftime(event_time,'%Y%m%d')) AS user_session, event_time,
  CASE WHEN item_id % 13 <> 0 THEN {CATEGORY} END AS category_code,
  CASE WHEN item_id % 13 <> 0 THEN p_brand END AS brand, price, event_type
 FROM (SELECT event_id, user_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS item_id, ts AS event_time,
        CASE WHEN event_type='click' THEN 'cart' ELSE event_type END AS event_type, value AS price FROM events) e
 LEFT JOIN part ON p_partkey = item_id)"""

ORDERLOG = f"""log AS (
 SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(l_orderkey AS VARCHAR) AS user_session,
  CAST(o_orderdate AS TIMESTAMP) AS event_time, {CATEGORY} AS category_code, p_brand AS brand,
  l_extendedprice/l_quantity AS price,
  CASE l_returnflag WHEN 'N' THEN 'view' WHEN 'A' THEN 'cart' ELSE 'purchase' END AS event_type
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey LEFT JOIN part ON l_partkey=p_partkey)"""

SPLIT = """, edge AS (SELECT max(event_time) - INTERVAL 7 DAY AS cutoff FROM log),
train AS (SELECT * FROM log WHERE event_time <= (SELECT cutoff FROM edge)),
truth AS (SELECT * FROM log WHERE event_time > (SELECT cutoff FROM edge) AND event_type='purchase'),
gt AS (SELECT DISTINCT user_id, item_id FROM truth WHERE user_id IN (SELECT user_id FROM train))"""

PREDS = """, pairs AS (SELECT user_id, item_id, count(*) AS n, sum(price) AS spend, max(event_time) AS last_time
  FROM train WHERE event_type IN ('view','cart','purchase') GROUP BY 1,2),
scored AS (SELECT 'freq' AS model, user_id, item_id, CAST(n AS DOUBLE) AS score FROM pairs
 UNION ALL SELECT 'recency', user_id, item_id,
   -round((epoch_us((SELECT max(event_time) FROM train))-epoch_us(last_time))/86400e6,6) FROM pairs
 UNION ALL SELECT 'spend', user_id, item_id, round(spend,6) FROM pairs),
preds AS (SELECT * FROM (SELECT model, user_id, item_id, score,
  CAST(row_number() OVER (PARTITION BY model,user_id ORDER BY score DESC,item_id) AS INTEGER) AS rank FROM scored)
 WHERE rank<=50)"""


def on_log(body: str, *ctes: str) -> str:
    return f"WITH {LOG}{''.join(', ' + c for c in ctes)} {body}"


def on_orders(body: str, *ctes: str) -> str:
    return f"WITH {ORDERLOG}{''.join(', ' + c for c in ctes)} {body}"


def on_split(body: str, *ctes: str) -> str:
    return f"WITH {LOG}{SPLIT}{''.join(', ' + c for c in ctes)} {body}"


def on_preds(body: str, *ctes: str) -> str:
    return f"WITH {LOG}{SPLIT}{PREDS}{''.join(', ' + c for c in ctes)} {body}"


SHOP = "shop AS (SELECT * FROM log WHERE event_type IN ('view','cart','purchase'))"


def on_shop(body: str, *ctes: str) -> str:
    return on_log(body, SHOP, *ctes)


def mode_of(table: str, key: str, column: str, expr: str | None = None) -> str:
    """Subquery: most frequent non-null value per key, ties to the smallest."""
    expr = expr or column
    return (
        f"(SELECT {key}, {column} FROM (SELECT {key}, {expr} AS {column}, row_number() OVER (PARTITION BY {key} "
        f"ORDER BY count(*) DESC, {expr}) AS r FROM {table} WHERE {expr} IS NOT NULL GROUP BY {key}, {expr}) WHERE r=1)"
    )


def cnt(event_type: str) -> str:
    return f"count(*) FILTER (WHERE event_type='{event_type}')"


L2PATH = "split_part(category_code,'.',1)||'.'||split_part(category_code,'.',2)"
L2TOKEN = "split_part(category_code,'.',2)"
DESCRIBE = (
    "count({v}) AS n, round(avg({v}),6) AS mean, round(stddev_samp({v}),6) AS std, round(min({v}),6) AS min, round(max({v}),6) AS max, "
    "round(quantile_cont({v},0.25),6) AS p25, round(quantile_cont({v},0.5),6) AS p50, round(quantile_cont({v},0.75),6) AS p75, "
    "round(quantile_cont({v},0.9),6) AS p90, round(quantile_cont({v},0.95),6) AS p95, round(quantile_cont({v},0.99),6) AS p99"
)
