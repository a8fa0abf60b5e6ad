"""Pieces of the SQL that results are held against."""

from __future__ import annotations

BARS = """SELECT l_returnflag || l_linestatus AS asset, CAST(l_shipdate AS DATE) AS ts, arg_min(p, k) AS open, max(p) AS high,
 min(p) AS low, arg_max(p, k) AS close, sum(l_quantity) AS volume FROM (SELECT *, l_extendedprice / l_quantity AS p,
 row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) GROUP BY 1, 2"""
MACRO = "SELECT l_returnflag AS indicator, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY 1, 2"
S = "PARTITION BY asset ORDER BY ts"
#: One-bar steps that most features start from.
STEP = f"""SELECT *, lag(close) OVER ({S}) AS pc, close / lag(close) OVER ({S}) - 1 AS ret, ln(close / lag(close) OVER ({S})) AS lr,
 greatest(high - low, abs(high - lag(close) OVER ({S})), abs(low - lag(close) OVER ({S}))) AS tr FROM ({BARS})"""


def w(n: int) -> str:
    return f"({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {w(n)} = {n} THEN {agg}({x}) OVER {w(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({S})"


def ewm(x: str, alpha: float) -> str:
    return f"list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER ({S} ROWS UNBOUNDED PRECEDING), lambda a, b: a * {1 - alpha!r} + b * {alpha!r})"


def picked(source: str, exact: list[str], rounded: list[str]) -> str:
    return f"SELECT {', '.join([*exact, *(f'round({c}, 6) + 0.0 AS {c}' for c in rounded)])} FROM ({source})"
