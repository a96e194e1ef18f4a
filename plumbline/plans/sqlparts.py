"""Common table expressions shared by the checking SQL."""

from __future__ import annotations

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}
# Parts that a recursive one reads in every round.
STORED: set[str] = set()


def part(name: str, deps: str, sql: str) -> None:
    PARTS[name] = (tuple(deps.split()), sql)


def with_parts(names: str, body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the named parts and everything they depend on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        deps, _ = PARTS[name]
        for dep in deps:
            visit(dep)
        ordered.append(name)

    for name in names.split():
        visit(name)
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in STORED else ''}({PARTS[n][1]})" for n in ordered)
    word = "WITH RECURSIVE" if recursive or any("UNION ALL /*r*/" in PARTS[n][1] for n in ordered) else "WITH"
    if body.lstrip().startswith(","):
        return f"{word} {ctes}{body}"
    return f"{word} {ctes}\n{body}"


part("trades", "", """
SELECT l_suppkey, CAST(l_shipdate AS DATE) AS effective_date, l_extendedprice / l_quantity AS px,
       l_quantity AS qty,
       (l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 7919 + l_suppkey * 104729
         + CAST(round(l_extendedprice * 100) AS BIGINT)) % 1048576 AS arrival
FROM lineitem""")

for _entity, _join, _name in (
    ("supplier", "", "s_name"),
    ("nation", "JOIN nation ON s_nationkey = n_nationkey", "n_name"),
    ("region", "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "r_name"),
):
    part(f"bars_{_entity}", "trades", f"""
SELECT {_name} AS ticker, effective_date, arg_min(px, arrival) AS open, max(px) AS high,
       min(px) AS low, arg_max(px, arrival) AS close, sum(qty) AS volume, count(*) AS n_trades
FROM trades JOIN supplier ON l_suppkey = s_suppkey {_join}
GROUP BY 1, 2""")

part("sector_map", "", """
SELECT s_name AS ticker, r_name AS etf FROM supplier
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

MACRO_NAME = """CASE o_orderpriority WHEN '1-URGENT' THEN 'DGS10' WHEN '2-HIGH' THEN 'DGS2'
 WHEN '3-MEDIUM' THEN 'BAMLH0A0HYM2' WHEN '4-NOT SPECIFIED' THEN 'VIXCLS' WHEN '5-LOW' THEN 'BAMLC0A0CM' END"""

part("macro", "", f"""
SELECT {MACRO_NAME} AS series_id, CAST(o_orderdate AS DATE) AS effective_date,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(*) AS value
FROM orders GROUP BY 1, 2""")

part("vintages", "", f"""
WITH s AS (SELECT {MACRO_NAME} AS series_id, CAST(o_orderdate AS DATE) AS obs_date,
  sum(CASE WHEN o_custkey % 2 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS c0,
  count(*) FILTER (WHERE o_custkey % 2 = 0) AS n0,
  sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS c1, count(*) AS n1 FROM orders GROUP BY 1, 2)
SELECT series_id, obs_date, obs_date AS realtime_start, obs_date + 1 AS realtime_end,
  CASE WHEN n0 > 0 THEN CAST(c0 AS DOUBLE) / 100.0 / n0 END AS value FROM s
UNION ALL
SELECT series_id, obs_date, obs_date + 2, DATE '9999-12-31', CAST(c1 AS DOUBLE) / 100.0 / n1 FROM s""")

part("quotes", "", """
SELECT event_id, event_type AS ticker, ts, user_id, value AS mid,
       value * (1 - CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 20000.0) AS bid,
       value * (1 + CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 20000.0) AS ask,
       CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS spread_bps,
       CAST(user_id % 97 + 1 AS DOUBLE) AS volume,
       (event_id * 7919 % 1000) / 1000.0 AS realized_vol
FROM events WHERE value > 0""")

part("journal", "", """
SELECT CAST(o_orderkey AS VARCHAR) AS entry_id, 'C' || o_custkey AS ticker, CAST(o_orderdate AS DATE) AS entry_date,
  CASE WHEN o_orderkey % 97 = 0 THEN 'hold' WHEN o_orderkey % 3 = 0 THEN 'long'
       WHEN o_orderkey % 3 = 1 THEN 'short' ELSE 'avoided' END AS direction,
  CASE WHEN o_orderkey % 89 = 0 THEN ' ' ELSE 'thesis ' || o_orderkey END AS thesis,
  CAST(o_orderkey % 30 AS INTEGER) AS expected_horizon,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS confidence_self,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS market_state_id,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) END AS exit_date,
  CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey * 7919 % 2001 - 1000) / 10000.0 END AS pnl_pct,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderkey * 104729 % 3 <> 0 END AS thesis_validated,
  CASE WHEN o_orderstatus <> 'P' THEN 'horizon' END AS exit_reason
FROM orders""")

part("paper_trades", "journal", """
SELECT CAST(entry_id AS BIGINT) AS trade_id, 'layer' || confidence_self AS layer_attributed_to,
       entry_date, exit_date, pnl_pct FROM journal WHERE pnl_pct IS NOT NULL""")
