"""DuckDB SQL that checks the queries: the same tables, worked out by another engine from formulas written out here."""

from __future__ import annotations

P = "PARTITION BY symbol ORDER BY ts"


def over(f: str, w: int, by: str = P) -> str:
    return f"{f} OVER ({by} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def guarded(f: str, x: str, w: int, least: int | None = None, by: str = P) -> str:
    return f"CASE WHEN {over(f'count({x})', w, by)} >= {least or w} THEN {over(f, w, by)} END"


def mean(x, w, least=None, by=P):
    return guarded(f"avg({x})", x, w, least, by)


def total(x, w, least=None, by=P):
    return guarded(f"sum({x})", x, w, least, by)


def std(x, w, least=None, by=P):
    return guarded(f"stddev_samp({x})", x, w, least, by)


def var(x, w, least=None, by=P):
    return guarded(f"var_samp({x})", x, w, least, by)


def peak(x, w, least=None, by=P):
    return guarded(f"max({x})", x, w, least, by)


def trough(x, w, least=None, by=P):
    return guarded(f"min({x})", x, w, least, by)


def quantile(x, w, q, least=None, by=P):
    return guarded(f"quantile_cont({x}, {q})", x, w, least, by)


def cov(x, y, w, by=P):
    """Both columns present in the same rows."""
    return guarded(f"covar_samp({x}, {y})", f"CASE WHEN {x} IS NOT NULL THEN {y} END", w, None, by)


def corr(x, y, w, by=P):
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"({cov(x, y, w, by)}) / nullif({over(f'stddev_samp({a})', w, by)} * {over(f'stddev_samp({b})', w, by)}, 0)"


def values(x, w, by=P):
    """The frame's values as a list; rank() then takes the column that holds it."""
    return over(f"list({x}) FILTER ({x} IS NOT NULL)", w, by)


def rank(a, x, w, least=None):
    return f"CASE WHEN len({a}) >= {least or w} AND {x} IS NOT NULL THEN (len(list_filter({a}, lambda e: e < {x})) + (len(list_filter({a}, lambda e: e = {x})) + 1) / 2.0) / len({a}) END"


def lag(x, n=1, by=P):
    return f"lag({x}, {n}) OVER ({by})"


def pct(x, n=1, by=P):
    return f"({x} / nullif({lag(x, n, by)}, 0) - 1)"


def z(x, w=120, by=P):
    least = max(20, w // 3)
    v = f"({x} - ({mean(x, w, least, by)})) / nullif({std(x, w, least, by)}, 0)"
    return f"CASE WHEN {v} IS NOT NULL THEN greatest(-3.0, least(3.0, {v})) END"


def r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def chain(base: str, *steps: dict[str, str] | str) -> str:
    """CTEs s0, s1, ...: columns added step by step (a dict), or a whole SELECT over {prev}."""
    parts = [f"s0 AS ({base})"]
    for k, step in enumerate(steps, 1):
        body = step.replace("{prev}", f"s{k - 1}") if isinstance(step, str) else f"SELECT *, {', '.join(f'{v} AS {n}' for n, v in step.items())} FROM s{k - 1}"
        parts.append(f"s{k} AS ({body})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT * FROM s{len(steps)}"


def bars(minutes: int = 30) -> str:
    return f"""SELECT event_type AS symbol, bucket AS ts, arg_min(px, (t, event_id)) AS open, max(px) AS high, min(px) AS low, arg_max(px, (t, event_id)) AS close,
      count(*)::DOUBLE AS volume, sum(px) AS amt
    FROM (SELECT event_type, event_id, ts AS t, 100 + value / 100 AS px, time_bucket(INTERVAL '{minutes} minutes', ts) AS bucket FROM events) GROUP BY 1, 2"""


DAILY = """SELECT symbol, ts, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(v)::DOUBLE AS volume, sum(px) AS amt
    FROM (SELECT l_returnflag AS symbol, l_shipdate::DATE::TIMESTAMP AS ts, 100 + l_extendedprice::DOUBLE / 10000 AS px, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k,
          l_quantity::DOUBLE AS v FROM lineitem) GROUP BY 1, 2"""
MACRO = "SELECT 'ORDERS' AS symbol, o_orderdate::DATE AS date, avg(o_totalprice::DOUBLE) / 1000 AS close FROM orders GROUP BY 2"

RETURNS = {"cc": pct("close"), "oc": "close / nullif(open, 0) - 1"}
BASIC_RAW = {
    "momentum_raw": pct("close", 12), "ma6": mean("close", 6), "hi20": peak("high", 20), "lo20": trough("low", 20), "vm20": mean("volume", 20), **RETURNS,
}
BASIC = {
    "reversal_raw": "-(close / nullif(ma6, 0) - 1)", "breakout_raw": "((close - lo20) / nullif(hi20 - lo20, 0) - 0.5) * 2", "volume_confirm_raw": "sign(cc) * (volume / nullif(vm20, 0) - 1)",
}
NAMES = ("momentum", "reversal", "breakout", "volume_confirm")
ZS = {f: z(f"{f}_raw") for f in NAMES}


def scores(base: str = DAILY) -> str:
    """(symbol, ts, open ... oc, factor, value) of the four basic factors."""
    cols = "symbol, ts, open, high, low, close, volume, amt, cc, oc"
    return chain(base, BASIC_RAW, BASIC, ZS, " UNION ALL ".join(f"SELECT {cols}, '{f}' AS factor, {f} AS value FROM {{prev}}" for f in NAMES))


SEGMENT = """SELECT *, CASE WHEN i < a THEN 'train' WHEN i < b THEN 'validation' ELSE 'test' END AS segment FROM (
    SELECT *, least(greatest(floor(n * (0.7::DOUBLE + 0.15::DOUBLE)), a + 1), n - 1) AS b FROM (
      SELECT *, least(greatest(floor(n * 0.7::DOUBLE), 1), n - 2) AS a FROM (
        SELECT *, count(*) OVER (PARTITION BY symbol, factor) AS n, row_number() OVER (PARTITION BY symbol, factor ORDER BY ts) - 1 AS i FROM {prev})))"""
SIGNAL = {"raw_signal": "CASE WHEN value > 0.7 THEN 1.0 WHEN value < -0.7 THEN -1.0 ELSE 0.0 END::DOUBLE"}
POSITION = {"position": "lag(raw_signal, 1, 0.0::DOUBLE) OVER (PARTITION BY symbol, factor ORDER BY ts)"}


def detail_steps(keys: str, cost: float = 0.0) -> list:
    by = f"PARTITION BY {keys} ORDER BY ts"
    run = f"OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return [
        "SELECT * FROM {prev} WHERE value IS NOT NULL AND oc IS NOT NULL AND position IS NOT NULL",
        {"turnover": f"abs(position - coalesce(lag(position) OVER ({by}), 0))", "benchmark_return": f"coalesce(close / nullif(lag(close) OVER ({by}), 0) - 1, 0)"},
        {"trading_cost": f"turnover * {cost!r}::DOUBLE", "gross_return": "position * oc"},
        {"net_return": "gross_return - trading_cost"},
        {"nav": f"product(1 + net_return) {run}", "benchmark_nav": f"product(1 + benchmark_return) {run}"},
        {"drawdown": f"nav / max(nav) {run} - 1"},
    ]


def detail(cost: float = 0.0, keys: str = "symbol, factor, segment") -> str:
    return chain(scores(), SEGMENT, SIGNAL, POSITION, *detail_steps(keys, cost))


METRICS = ("total_return", "benchmark_total_return", "annual_return", "annual_vol", "sharpe", "max_drawdown", "win_rate", "trade_count", "bar_count", "annual_periods")


def metrics(source: str, keys: str, net: str = "net_return", benchmark: str = "benchmark_return", periods: str | None = None) -> str:
    """Unrounded metrics of each key."""
    by = f"PARTITION BY {keys} ORDER BY ts"
    run = f"OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    p = f"any_value({periods})" if periods else "NULL"
    return f"""WITH d AS (SELECT * FROM ({source}) WHERE {net} IS NOT NULL),
    f AS (SELECT *, CASE WHEN position <> 0 AND position <> coalesce(lag(position) OVER ({by}), 0) THEN 1 ELSE 0 END AS new, product(1 + {net}) {run} AS nav_ FROM d),
    g AS (SELECT *, CASE WHEN position <> 0 THEN sum(new) {run} END AS trade, nav_ / max(nav_) {run} - 1 AS dd_ FROM f),
    pnl AS (SELECT {keys}, trade, sum({net}) AS pnl FROM g WHERE trade IS NOT NULL GROUP BY ALL),
    wins AS (SELECT {keys}, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, count(*)::DOUBLE AS trades FROM pnl GROUP BY ALL),
    days AS (SELECT {keys}, ts::DATE AS day, count(*) AS n FROM d GROUP BY ALL),
    per AS (SELECT {keys}, greatest(252, round_even(median(n) * 252, 0))::DOUBLE AS periods FROM days GROUP BY ALL),
    agg AS (SELECT {keys}, product(1 + {net}) AS equity, product(1 + coalesce({benchmark}, 0)) - 1 AS bench, stddev_pop({net}) AS v, min(dd_) AS mdd, count(*)::DOUBLE AS n, {p} AS given FROM g GROUP BY {keys}),
    j AS (SELECT *, coalesce(given, periods) AS pp FROM agg JOIN per USING ({keys}) LEFT JOIN wins USING ({keys})),
    k AS (SELECT *, CASE WHEN equity >= 0 THEN pow(equity, pp / n) - 1 END AS ar, v * sqrt(pp) AS av FROM j)
    SELECT {keys}, equity - 1 AS total_return, bench AS benchmark_total_return, ar AS annual_return, av AS annual_vol, CASE WHEN av > 0 THEN ar / av END AS sharpe, mdd AS max_drawdown,
      win_rate, coalesce(trades, 0) AS trade_count, n AS bar_count, pp AS annual_periods FROM k"""


def rounded(source: str, plain: tuple[str, ...], doubles: tuple[str, ...]) -> str:
    return f"SELECT {', '.join([*plain, *(f'{r(c)} AS {c}' for c in doubles)])} FROM ({source})"


def average_rank(x: str, keys: str) -> str:
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)"


def correlation(x: str, y: str) -> str:
    return f"CASE WHEN min({x}) < max({x}) AND min({y}) < max({y}) AND count(*) >= 3 THEN covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0) END"
