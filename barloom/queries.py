"""One query for each operator, over whole tables, and SQL with the same rows.

Prices of the fixtures are bounded (100 + value / 100): 30-minute and 2-hour bars of events by type, daily bars of
lineitem by return flag, a daily series of orders. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import oracle as O
from .config import BacktestSettings, LibrarySettings, ModelSettings, PortfolioSettings
from .functions import names
from .functions.frames import Frames, Term, absolute, nz, sign0
from .operators import align, backtest, boosting, composite, diagnostics, models, portfolio, predictive, quality, selection
from .oracle import chain, corr, cov, lag, mean, pct, peak, quantile, r, rank, rounded, std, total, trough, values, var, z
from .plans import catalog
from .plans.factors import build_factors, catalog_frame, wide
from .sources import bars as B
from .sources.sinks import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; doubles of its result are rounded."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def tidy(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_30m(spark, d):
    return B.bars_from_events(table(spark, d, "events"), 30)


def bars_2h(spark, d):
    return B.bars_from_events(table(spark, d, "events"), 120)


def bars_1d(spark, d):
    return B.bars_from_lineitem(table(spark, d, "lineitem"))


def macro_1d(spark, d):
    return B.macro_from_orders(table(spark, d, "orders"))


KEY = ("symbol", "ts")
BAR = ("open", "high", "low", "close", "volume", "amt")

# bars


@query(rounded(O.bars(30), KEY, BAR))
def bars_ohlcv(spark, d):
    return bars_30m(spark, d)


@query(rounded(O.DAILY, KEY, BAR))
def bars_daily(spark, d):
    return bars_1d(spark, d)


@query(rounded(O.MACRO, ("symbol", "date"), ("close",)))
def macro_daily(spark, d):
    return macro_1d(spark, d)


@query(rounded(f"""SELECT symbol, ts, arg_max(open, seq) AS open, arg_max(high, seq) AS high, arg_max(low, seq) AS low, arg_max(close, seq) AS close, arg_max(volume, seq) AS volume, arg_max(amt, seq) AS amt
    FROM (SELECT *, 0 AS seq FROM ({O.bars(30)}) UNION ALL SELECT symbol, ts, open * 1.01, high * 1.01, low * 1.01, close * 1.01, volume, amt, 1 FROM ({O.bars(30)}) WHERE hour(ts) % 2 = 0) GROUP BY 1, 2""", KEY, BAR))  # fmt: skip
def bars_dedupe(spark, d):
    bars = bars_30m(spark, d).withColumn("seq", F.lit(0))
    later = bars.where("hour(ts) % 2 = 0").withColumns({c: F.col(c) * 1.01 for c in B.PRICES} | {"seq": F.lit(1)})
    return B.normalise_bars(bars.unionByName(later), "seq")


@query(rounded(chain(O.bars(30), O.RETURNS), KEY, ("cc", "oc")))
def bar_returns(spark, d):
    return B.with_returns(bars_30m(spark, d)).select("symbol", "ts", "cc", "oc")


GAPS = "SELECT symbol, g FROM (SELECT symbol, date_diff('second', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) / 60.0 AS g FROM ({})) WHERE g > 0"
USUAL = "SELECT symbol, arg_min(m, (-n, m))::DOUBLE AS inferred_minutes FROM (SELECT symbol, round_even(g, 0) AS m, count(*) AS n FROM (" + GAPS + ") GROUP BY 1, 2) GROUP BY 1"


@query(rounded(USUAL.format(O.bars(30)), ("symbol",), ("inferred_minutes",)))
def bar_size_mode(spark, d):
    return B.usual_gap(bars_30m(spark, d))


def interval_sql(bars: str, expected: str = "u.inferred_minutes") -> str:
    return f"""SELECT symbol, any_value(u.inferred_minutes) AS inferred_minutes, count(*) FILTER (round_even(g, 0) <> round_even({expected}, 0)) AS abnormal_gaps,
      avg(CASE WHEN round_even(g, 0) <> round_even({expected}, 0) THEN 1.0 ELSE 0.0 END) AS abnormal_gap_share, max(g)::DOUBLE AS max_gap_minutes
    FROM ({GAPS.format(bars)}) JOIN ({USUAL.format(bars)}) u USING (symbol) GROUP BY symbol"""


@query(rounded(interval_sql(O.bars(30), "30"), ("symbol", "abnormal_gaps"), ("inferred_minutes", "abnormal_gap_share", "max_gap_minutes")))
def interval_stats(spark, d):
    return quality.interval_stats(bars_30m(spark, d), 30)


def dirty(spark, d):
    """30-minute bars, some with missing, zero and crossed values."""
    h = F.hour("ts")
    return bars_30m(spark, d).withColumns({
        "volume": F.when(h == 3, 0.0).when(h != 5, F.col("volume")), "close": F.when(h != 7, F.col("close")), "high": F.when(h == 9, F.col("low") - 1).otherwise(F.col("high")),
    })


DIRTY = f"""SELECT symbol, ts, open, CASE WHEN hour(ts) = 9 THEN low - 1 ELSE high END AS high, low, CASE WHEN hour(ts) <> 7 THEN close END AS close,
    CASE WHEN hour(ts) = 3 THEN 0.0 WHEN hour(ts) <> 5 THEN volume END AS volume, amt FROM ({O.bars(30)})"""
QUALITY_SHARES = ("missing_price_share", "missing_volume_share", "zero_volume_share", "ohlc_violation_share", "extreme_return_share", "max_return", "min_return", "inferred_minutes", "abnormal_gap_share", "max_gap_minutes")


def quality_sql(bars: str, role: str, expected: str, extreme: float) -> str:
    broken = "coalesce(high < low OR open > high OR open < low OR close > high OR close < low, false)"
    return f"""WITH b AS ({bars}), q AS (SELECT *, last_value(nullif(close, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c1,
        last_value(nullif(close, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c0 FROM b),
      x AS (SELECT *, c1 / c0 - 1 AS ret, {broken} AS bad FROM q),
      a AS (SELECT symbol, count(*) AS rows, min(ts) AS start, max(ts) AS "end", count(*) - count(DISTINCT ts) AS duplicate_timestamps,
        avg(((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT) / 4.0) AS missing_price_share, avg((volume IS NULL)::INT) AS missing_volume_share,
        avg((coalesce(volume, 0) = 0)::INT) AS zero_volume_share, count(*) FILTER (bad) AS ohlc_violations, avg(bad::INT) AS ohlc_violation_share,
        count(*) FILTER (abs(ret) > {extreme}) AS extreme_returns, avg(coalesce(abs(ret) > {extreme}, false)::INT) AS extreme_return_share, max(ret) AS max_return, min(ret) AS min_return FROM x GROUP BY 1)
      SELECT a.*, i.* EXCLUDE (symbol, abnormal_gaps), coalesce(i.abnormal_gaps, 0) AS abnormal_gaps, '{role}' AS role FROM a LEFT JOIN ({interval_sql(bars, expected)}) i USING (symbol)"""


QUALITY_PLAIN = ("symbol", "rows", "start", '"end"', "duplicate_timestamps", "ohlc_violations", "extreme_returns", "abnormal_gaps", "role")


@query(rounded(quality_sql(DIRTY, "intraday", "30", 0.02), QUALITY_PLAIN, QUALITY_SHARES))
def quality_report(spark, d):
    return quality.quality_report(dirty(spark, d), expected=30, extreme=0.02)


MACRO_BARS = f"SELECT symbol, date::TIMESTAMP AS ts, close AS open, close AS high, close AS low, close, NULL::DOUBLE AS volume FROM ({O.MACRO})"
MACRO_QUALITY = f"SELECT * REPLACE (NULL::DOUBLE AS missing_volume_share, NULL::DOUBLE AS zero_volume_share, NULL::BIGINT AS ohlc_violations, NULL::DOUBLE AS ohlc_violation_share) FROM ({quality_sql(MACRO_BARS, 'macro_daily', 'u.inferred_minutes', 0.05)})"


@query(rounded(MACRO_QUALITY, QUALITY_PLAIN, QUALITY_SHARES))
def macro_quality(spark, d):
    return quality.macro_quality(macro_1d(spark, d))


# alignment: related bars with holes


def related_30m(spark, d):
    return bars_30m(spark, d).where("hour(ts) % 7 <> 3")


RELATED = f"SELECT * FROM ({O.bars(30)}) WHERE hour(ts) % 7 <> 3"


def pairs(spark, d, related=("click", "purchase")):
    return align.pairs_of(bars_30m(spark, d), list(related))


PAIRED = f"""SELECT m.symbol, p.related, m.ts, m.close, o.close AS raw FROM ({O.bars(30)}) m JOIN (SELECT unnest(['click', 'purchase']) AS related) p ON p.related <> m.symbol
    LEFT JOIN ({RELATED}) o ON o.symbol = p.related AND o.ts = m.ts"""
PAIR = "PARTITION BY symbol, related ORDER BY ts"
FILLED = f"last_value(raw IGNORE NULLS) OVER ({PAIR} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query(rounded(f"SELECT symbol, related, ts, close, {FILLED} AS r_close FROM ({PAIRED})", ("symbol", "related", "ts"), ("close", "r_close")))
def ffill_limited_align(spark, d):
    out = align.align_related(bars_30m(spark, d), related_30m(spark, d), pairs(spark, d), 2)
    return out.select("symbol", "related", "ts", "close", "r_close")


COVER = f"""WITH p AS (SELECT *, {FILLED} AS f FROM ({PAIRED})), q AS (SELECT *, sum(CASE WHEN f IS NULL THEN 0 ELSE 1 END) OVER ({PAIR} ROWS UNBOUNDED PRECEDING) AS run FROM p),
    t AS (SELECT q.*, date_diff('second', o.ts, q.ts) / 60.0 AS age FROM q ASOF LEFT JOIN ({RELATED}) o ON o.symbol = q.related AND q.ts >= o.ts),
    longest AS (SELECT symbol, related, max(n) AS most FROM (SELECT symbol, related, run, count(*) FILTER (f IS NULL) AS n FROM q GROUP BY ALL) GROUP BY ALL),
    a AS (SELECT symbol, related, count(*) AS main_rows, count(raw) AS direct_aligned_rows, count(f) - count(raw) AS ffill_added_rows, count(f) AS usable_rows, count(*) - count(f) AS missing_rows_after_ffill,
      max(age) FILTER (f IS NOT NULL) AS max_alignment_lag_minutes, avg(age) FILTER (f IS NOT NULL) AS avg_alignment_lag_minutes FROM t GROUP BY ALL)
    SELECT a.*, most AS max_consecutive_missing_after_ffill, direct_aligned_rows / main_rows AS direct_coverage_rate, usable_rows / main_rows AS usable_coverage_rate,
      missing_rows_after_ffill / main_rows AS missing_rate_after_ffill, ffill_added_rows / usable_rows AS ffill_share_in_usable FROM a JOIN longest USING (symbol, related)"""
COVER_PLAIN = ("symbol", "related", "main_rows", "direct_aligned_rows", "ffill_added_rows", "usable_rows", "missing_rows_after_ffill", "max_consecutive_missing_after_ffill")
COVER_DOUBLES = ("max_alignment_lag_minutes", "avg_alignment_lag_minutes", "direct_coverage_rate", "usable_coverage_rate", "missing_rate_after_ffill", "ffill_share_in_usable")


@query(rounded(COVER, COVER_PLAIN, COVER_DOUBLES))
def coverage_report(spark, d):
    return align.related_coverage(bars_30m(spark, d), related_30m(spark, d), pairs(spark, d), 2).select(*COVER_PLAIN, *COVER_DOUBLES)


MACRO_ON_BARS = f"""SELECT b.*, m.symbol AS macro, m.c AS m_close FROM ({O.DAILY}) b ASOF LEFT JOIN (SELECT symbol, date, lag(close) OVER (ORDER BY date) AS c FROM ({O.MACRO})) m ON b.ts::DATE >= m.date"""


@query(rounded(f"SELECT symbol, ts, coalesce(macro, 'ORDERS') AS macro, m_close FROM ({MACRO_ON_BARS})", ("symbol", "ts", "macro"), ("m_close",)))
def asof_macro_align(spark, d):
    return align.align_macro(bars_1d(spark, d), macro_1d(spark, d), 1).select("symbol", "ts", "macro", "m_close")


# moving functions


def rolling(spark, d, terms: Callable[[Frames], dict[str, Term]], base=bars_1d) -> DataFrame:
    frames = Frames()
    return frames.apply(B.with_returns(base(spark, d)), terms(frames), ["symbol", "ts"])


def rolling_sql(*steps: dict[str, str], base: str = O.DAILY) -> str:
    return rounded(chain(base, O.RETURNS, *steps), KEY, tuple(steps[-1]))


WS = (5, 21, 89)


def _moving(name: str, make: Callable[[Frames, int], Term], sql: Callable[[int], str], *before: dict[str, str]) -> None:
    """Register roll_<name>: one moving function at three windows."""
    cols = {f"{name}_{w}": sql(w) for w in WS}
    SQL[f"roll_{name}"] = rolling_sql(*before, cols)
    QUERIES[f"roll_{name}"] = lambda spark, d: tidy(rolling(spark, d, lambda f: {f"{name}_{w}": make(f, w) for w in WS}))


_moving("mean", lambda f, w: f.mean("close", w), lambda w: mean("close", w))
_moving("sum", lambda f, w: f.total("volume", w), lambda w: total("volume", w))
_moving("std", lambda f, w: f.std("cc", w), lambda w: std("cc", w))
_moving("var", lambda f, w: f.var("close", w), lambda w: var("close", w))
_moving("max", lambda f, w: f.peak("high", w), lambda w: peak("high", w))
_moving("min", lambda f, w: f.trough("low", w), lambda w: trough("low", w))
_moving("median", lambda f, w: f.median("cc", w), lambda w: quantile("cc", w, 0.5))
_moving("quantile", lambda f, w: f.quantile("cc", w, 0.9), lambda w: quantile("cc", w, 0.9))
_moving("pct_rank", lambda f, w: f.rank("close", w), lambda w: rank(f"a{w}", "close", w), {f"a{w}": values("close", w) for w in WS})
_moving("skew", lambda f, w: f.skew("cc", w), lambda w: O.guarded("skewness(cc)", "cc", w))
_moving("kurt", lambda f, w: f.kurt("cc", w), lambda w: O.guarded("kurtosis(cc)", "cc", w))
_moving("corr", lambda f, w: f.corr("cc", f.pct("volume"), w), lambda w: corr("cc", "vc", w), {"vc": pct("volume")})
_moving("cov", lambda f, w: f.cov("cc", f.pct("volume"), w), lambda w: cov("cc", "vc", w), {"vc": pct("volume")})
_moving("beta", lambda f, w: f.cov("cc", f.pct("volume"), w) / f.var(f.pct("volume"), w), lambda w: f"({cov('cc', 'vc', w)}) / nullif({var('vc', w)}, 0)", {"vc": pct("volume")})
_moving("least", lambda f, w: f.mean("cc", w, max(2, w // 3)), lambda w: mean("cc", w, max(2, w // 3)))
_moving("std_of_std", lambda f, w: f.std(f.std("cc", w // 2), w), lambda w: std(f"s{w}", w), {f"s{w}": std("cc", w // 2) for w in WS})

SPANS = (5, 21)


def ewm_sql() -> str:
    """The recursion, bar by bar, on closes (never missing)."""
    cols = ", ".join(f"CASE WHEN n >= {s // 2} THEN e{s} END AS ewm_{s}" for s in SPANS)
    step = ", ".join(f"(1 - {2 / (s + 1)!r}::DOUBLE) * e.e{s} + {2 / (s + 1)!r}::DOUBLE * b.close" for s in SPANS)
    inner = f"""WITH RECURSIVE b AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM ({O.DAILY})),
      e AS (SELECT symbol, ts, n, {', '.join(f'close AS e{s}' for s in SPANS)} FROM b WHERE n = 1 UNION ALL SELECT b.symbol, b.ts, b.n, {step} FROM e JOIN b ON b.symbol = e.symbol AND b.n = e.n + 1)
      SELECT symbol, ts, {cols} FROM e"""
    return rounded(inner, KEY, tuple(f"ewm_{s}" for s in SPANS))


@query(ewm_sql())
def ewm_mean(spark, d):
    return rolling(spark, d, lambda f: {f"ewm_{s}": f.ewm("close", s, s // 2) for s in SPANS})


@query(rolling_sql({"v": "CASE WHEN hour(ts) % 5 <> 2 THEN volume END", "c": "volume"}, {"now": "last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "p1": "last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "p5": "last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING)"}, {"pct_1": "now / nullif(p1, 0) - 1", "pct_5": "now / nullif(p5, 0) - 1"}, base=O.bars(30)))
def pct_change_pad(spark, d):
    v = Term("(CASE WHEN hour(ts) % 5 <> 2 THEN volume END)")
    return rolling(spark, d, lambda f: {"pct_1": f.pct(v, 1), "pct_5": f.pct(v, 5)}, bars_30m)


@query(rolling_sql({"sv": "coalesce(sign(cc), 0) * volume"}, {"obv": "sum(sv) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"}))
def cumsum_obv(spark, d):
    return rolling(spark, d, lambda f: {"obv": f.cumsum(sign0("cc") * Term("volume"))})


@query(rolling_sql({"z_close": z("close"), "z_cc": z("cc")}))
def zscore_clip(spark, d):
    return rolling(spark, d, lambda f: {"z_close": f.z("close"), "z_cc": f.z("cc")})


# factors: some of each family, written out in SQL


#: Rows of a block in these queries: few enough that series are cut, so that block edges are compared too.
BLOCK = 1200


def factor_query(name: str, factors: dict[str, str], steps: list[dict[str, str]], kind: str = "own", base: str = O.DAILY, bars: Callable = None, by: str = O.P, keys: tuple[str, ...] = ("symbol",)) -> None:
    """Register factor_<name>: the factors' values, from the catalogue on one side and from SQL on the other."""
    listed = {f.name: f for _, _, f, _ in catalog.catalog(("R",), ("M",))}
    plain = {n.replace("{s}", "s"): n for n in factors}
    SQL[f"factor_{name}"] = rounded(chain(base, *steps, {k.replace("{s}", "s") + "_raw": v for k, v in factors.items()}, {k: z(f"{k}_raw", by=by) for k in plain}), (*keys, "ts"), tuple(plain))

    def run(spark, d):
        out = wide((bars or (lambda s, p: B.with_returns(bars_1d(s, p))))(spark, d), [listed[n] for n in factors], kind, block_rows=BLOCK)
        return tidy(out.select(*keys, "ts", *[F.col(f"`{n}`").alias(k) for k, n in plain.items()]))

    QUERIES[f"factor_{name}"] = run


SERIES = {
    "ret": "cc", "intra": "oc", "spread": "nullif(high - low, 0)", "body": "close - open", "up": "high - greatest(open, close)", "lo": "least(open, close) - low", "v": "nullif(volume, 0)",
    "typical": "(high + low + close) / 3", "mid": "(high + low) / 2", "gap": f"open / nullif({lag('close')}, 0) - 1", "prev": lag("close"), "sv": "coalesce(sign(cc), 0) * coalesce(nullif(volume, 0), 0)",
}
SERIES2 = {
    "vc": pct("v"), "dollar": "close * v", "illiq": "abs(ret) / v", "flow": "typical * sv", "loc": "((close - low) - (high - close)) / spread", "wick": "(lo - up) / spread", "tr": "greatest(high - low, abs(high - prev), abs(low - prev))",
    "obv": "sum(sv) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)", "spread_pct": "(high - low) / nullif(open, 0)", "body_pct": "body / nullif(open, 0)", "gain": "CASE WHEN ret > 0 THEN ret ELSE 0 END",
    "loss": "CASE WHEN ret < 0 THEN ret ELSE 0 END", "ac": pct("amt"), "ret_lag": lag("ret"), "shadow": "lo / nullif(open, 0) - up / nullif(open, 0)",
}
OWN = [O.RETURNS, SERIES, SERIES2]

factor_query("basic", {"momentum": "close / nullif(lag(close, 12) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1", "reversal": f"-(close / nullif({mean('close', 6)}, 0) - 1)",
    "breakout": f"((close - ({trough('low', 20)})) / nullif(({peak('high', 20)}) - ({trough('low', 20)}), 0) - 0.5) * 2", "volume_confirm": f"sign(cc) * (volume / nullif({mean('volume', 20)}, 0) - 1)"}, OWN)
factor_query("param_price", {"ret_5": pct("close", 5), "ma_gap_21": f"close / nullif({mean('close', 21)}, 0) - 1", "volatility_13": std("ret", 13), "drawdown_34": f"close / nullif({peak('close', 34)}, 0) - 1",
    "return_efficiency_8": f"{pct('close', 8)} / nullif({total('abs(ret)', 8)}, 0)", "range_position_21": f"(close - ({trough('low', 21)})) / nullif(({peak('high', 21)}) - ({trough('low', 21)}), 0) - 0.5",
    "return_skew_21": O.guarded("skewness(ret)", "ret", 21), "return_kurt_34": O.guarded("kurtosis(ret)", "ret", 34), "return_autocorr_21": corr("ret", "ret_lag", 21), "gain_loss_ratio_13": f"({mean('gain', 13)}) / nullif({mean('abs(loss)', 13)}, 0)",
    "true_range_ratio_10": f"tr / nullif({mean('tr', 10)}, 0) - 1", "trend_persistence_16": f"({total('sign(ret)', 16)}) / 16"}, OWN)
factor_query("param_volume", {"volume_ratio_10": f"v / nullif({mean('v', 10)}, 0) - 1", "price_volume_corr_21": corr("ret", "vc", 21), "illiquidity_8": mean("illiq", 8), "volume_pressure_13": f"({total('sv', 13)}) / nullif({total('v', 13)}, 0)",
    "obv_change_5": "obv - lag(obv, 5) OVER (PARTITION BY symbol ORDER BY ts)", "obv_ma_gap_21": f"obv / nullif({mean('obv', 21)}, 0) - 1", "return_volume_beta_34": f"({cov('ret', 'vc', 34)}) / nullif({var('vc', 34)}, 0)",
    "money_flow_sum_10": total("flow", 10), "fast_slow_volume_sum_ratio_16": f"({total('v', 8)}) / nullif({total('v', 16)}, 0) - 1", "positive_volume_pressure_21": f"({total('CASE WHEN ret > 0 THEN v ELSE 0 END', 21)}) / nullif({total('v', 21)}, 0)"}, OWN)
factor_query("param_shadow", {"body_range_5": mean("abs(body) / spread", 5), "upper_shadow_8": mean("up / spread", 8), "close_location_13": mean("loc", 13), "wick_imbalance_21": mean("wick", 21), "shadow_balance_std_10": std("wick", 10),
    "shadow_reversal_pressure_13": f"(({total('lo', 13)}) - ({total('up', 13)})) / nullif({total('spread', 13)}, 0)", "body_zdist_21": f"(body - ({mean('body', 21)})) / nullif({std('body', 21)}, 0)"}, OWN)
RANKS = {"a_close": values("close", 21), "a_v": values("v", 21), "a_spread": values("spread", 21), "a_flow": values("flow", 21), "a_ret": values("ret", 21)}
RANKED = {"k_close": rank("a_close", "close", 21), "k_v": rank("a_v", "v", 21), "k_spread": rank("a_spread", "spread", 21), "k_flow": rank("a_flow", "flow", 21), "k_ret": rank("a_ret", "ret", 21)}
factor_query("param_rank", {"close_rank_21": "k_close - 0.5", "price_volume_divergence_21": "k_close - k_v", "price_range_rank_product_21": "(k_close - 0.5) * (k_spread - 0.5)", "money_flow_rank_21": "k_flow - 0.5", "return_volume_rank_gap_21": "k_ret - k_v"}, [*OWN, RANKS, RANKED])
XSTEP = {"x": "body_pct", "dx": f"body_pct - {lag('body_pct')}"}
factor_query("struct", {"struct_mean_body_pct_10": mean("x", 10), "struct_std_body_pct_10": f"nullif({std('x', 10)}, 0)", "struct_median_body_pct_10": quantile("x", 10, 0.5), "struct_zdist_body_pct_10": f"(x - ({mean('x', 10)})) / nullif({std('x', 10)}, 0)",
    "struct_sum_abs_share_body_pct_10": f"({total('x', 10)}) / nullif({total('abs(x)', 10)}, 0)", "struct_accel_body_pct_10": mean("dx", 10), "struct_vol_ratio_body_pct_10": f"({std('x', 5)}) / nullif({std('x', 10)}, 0) - 1"}, [*OWN, XSTEP])
GSTEP = {"x": "gap", "dx": f"gap - {lag('gap')}"}
factor_query("mega", {"mega_abs_mean_gap_return_13": f"nullif({mean('abs(x)', 13)}, 0)", "mega_diff_std_gap_return_13": std("dx", 13), "mega_positive_share_gap_return_13": f"({total('CASE WHEN x > 0 THEN x ELSE 0 END', 13)}) / nullif({total('abs(x)', 13)}, 0)",
    "mega_max_gap_return_13": peak("x", 13), "mega_quantile_spread_gap_return_13": f"({quantile('x', 13, 0.75)}) - ({quantile('x', 13, 0.25)})", "mega_return_corr_gap_return_13": corr("x", "ret", 13)}, [*OWN, GSTEP])
SSTEP = {"x": "spread_pct"}
factor_query("ultra", {"ultra_mean_spread_pct_21": mean("x", 21), "ultra_skew_spread_pct_21": O.guarded("skewness(x)", "x", 21), "ultra_half_mean_gap_spread_pct_21": f"({mean('x', 10)}) / nullif({mean('x', 21)}, 0) - 1",
    "ultra_volume_corr_spread_pct_21": corr("x", "vc", 21), "ultra_range_corr_bar_return_21": corr("ret", "spread_pct", 21), "ultra_sum_abs_share_bar_return_21": f"({total('ret', 21)}) / nullif({total('abs(ret)', 21)}, 0)"}, [*OWN, SSTEP])
HSTEP = {"x": "ret * spread_pct", "pos": "CASE WHEN ret * spread_pct > 0 THEN 1.0 ELSE 0.0 END"}
factor_query("hyper", {"hyper_slow_zdist_ret_x_range_21": f"(({mean('x', 21)}) - ({mean('x', 42)})) / nullif({std('x', 42)}, 0)", "hyper_fast_slow_gap_ret_x_range_21": f"({mean('x', 10)}) / nullif({mean('x', 42)}, 0) - 1", "hyper_pos_count_ret_x_range_21": mean("pos", 21),
    "hyper_tail_spread_ret_x_range_21": f"({quantile('x', 21, 0.9)}) - ({quantile('x', 21, 0.1)})", "hyper_amount_corr_ret_x_range_21": corr("x", "ac", 21), "hyper_intrabar_corr_ret_x_range_21": corr("x", "intra", 21)}, [*OWN, HSTEP])
OSTEP = {"x": "vc - ac"}
OSTEP2 = {"dx": f"x - {lag('x')}", "ds": f"sign(x) - {lag('sign(x)')}", "m": mean("x", 21), "sh": std("x", 10)}
factor_query("omega", {"omega_diff_mean_volume_amount_gap_21": mean("dx", 21), "omega_range_beta_volume_amount_gap_21": f"({cov('x', 'spread_pct', 21)}) / nullif({var('spread_pct', 21)}, 0)",
    "omega_zero_cross_volume_amount_gap_21": mean("CASE WHEN abs(ds) > 0 THEN 1.0 ELSE 0.0 END", 21), "omega_persistence_volume_amount_gap_21": f"({total('sign(x)', 21)}) / 21", "omega_vol_of_vol_volume_amount_gap_21": std("sh", 21),
    "omega_mean_slope_volume_amount_gap_21": f"m - {lag('m')}", "omega_mean_abs_ratio_volume_amount_gap_21": f"m / nullif({mean('abs(x)', 21)}, 0)"}, [*OWN, OSTEP, OSTEP2])


def paired_1d(spark, d):
    bars = bars_1d(spark, d)
    return align.align_related(bars, bars, align.pairs_of(bars, ["A", "N"]), 2)


PAIRED_1D = f"""SELECT m.symbol, p.related, m.ts, m.open, m.high, m.low, m.close, m.volume, m.amt, {', '.join(f'last_value(o.{c} IGNORE NULLS) OVER (PARTITION BY m.symbol, p.related ORDER BY m.ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r_{c}' for c in BAR)}
    FROM ({O.DAILY}) m JOIN (SELECT unnest(['A', 'N']) AS related) p ON p.related <> m.symbol LEFT JOIN ({O.DAILY}) o ON o.symbol = p.related AND o.ts = m.ts"""


def padded(x: str, n: int = 1) -> str:
    at = lambda k: f"last_value({x} IGNORE NULLS) OVER ({PAIR} ROWS BETWEEN UNBOUNDED PRECEDING AND {k})"
    return f"({at('CURRENT ROW')} / nullif({at(f'{n} PRECEDING')}, 0) - 1)"


CROSS = [
    {"mret": padded("close"), "rret": padded("r_close"), "rintra": "r_close / nullif(r_open, 0) - 1", "mrange": "(high - low) / nullif(open, 0)", "rrange": "(r_high - r_low) / nullif(r_open, 0)", "ratio": "close / nullif(r_close, 0)",
     "vratio": "nullif(volume, 0) / nullif(r_volume, 0)", "mvc": padded("nullif(volume, 0)"), "rvc": padded("nullif(r_volume, 0)"), "rv": "nullif(r_volume, 0)", "strength8": f"{padded('close', 8)} - {padded('r_close', 8)}"},
    {"rel": "mret - rret", "lead_ret": lag("rret", 1, PAIR), "lead_intra": lag("rintra", 1, PAIR), "beta8": f"({cov('mret', 'rret', 8, PAIR)}) / nullif({var('rret', 8, None, PAIR)}, 0)", "corr8": corr("mret", "rret", 8, PAIR),
     "mloc": "((close - low) - (high - close)) / nullif(high - low, 0)", "rloc": "((r_close - r_low) - (r_high - r_close)) / nullif(r_high - r_low, 0)"},
    {"resid8": "mret - beta8 * rret", "x": "rel", "dx": f"rel - {lag('rel', 1, PAIR)}"},
]
PKEYS = ("symbol", "related")


def pm(f, *a):
    return f(*a, by=PAIR) if f in (cov, corr) else f(*a, None, PAIR)


def cross_query(name, factors):
    factor_query(name, factors, CROSS, "pair", PAIRED_1D, paired_1d, PAIR, PKEYS)


cross_query("cross", {"cross_relret_{s}_8": pm(mean, "rel", 8), "cross_relstrength_{s}_8": "strength8", "cross_ratio_zdist_{s}_8": f"(ratio - ({pm(mean, 'ratio', 8)})) / nullif({pm(std, 'ratio', 8)}, 0)", "cross_corr_{s}_8": "corr8", "cross_beta_{s}_8": "beta8",
    "cross_beta_resid_{s}_8": pm(mean, "resid8", 8), "cross_lead_return_{s}_8": pm(mean, "lead_ret", 8), "cross_vol_spread_{s}_8": f"nullif({pm(std, 'mret', 8)}, 0) / nullif({pm(std, 'rret', 8)}, 0) - 1",
    "cross_range_spread_{s}_8": f"({pm(mean, 'mrange', 8)}) - ({pm(mean, 'rrange', 8)})", "cross_fast_slow_relret_{s}_8": f"({pm(mean, 'rel', 4)}) - ({pm(mean, 'rel', 8)})"})
cross_query("crossmega", {"crossmega_std_{s}_relative_return_8": f"nullif({pm(std, 'x', 8)}, 0)", "crossmega_diff_mean_{s}_relative_return_8": pm(mean, "dx", 8), "crossmega_sum_abs_share_{s}_relative_return_8": f"({pm(total, 'x', 8)}) / nullif({pm(total, 'abs(x)', 8)}, 0)",
    "crossmega_main_return_corr_{s}_related_return_8": pm(corr, "rret", "mret", 8), "crossmega_mean_{s}_rolling_corr_8": pm(mean, "corr8", 8)})
cross_query("crossultra", {"crossultra_mean_{s}_lead_lag_gap_8": pm(mean, "lead_ret - mret", 8), "crossultra_zdist_{s}_return_product_8": f"(mret * rret - ({pm(mean, 'mret * rret', 8)})) / nullif({pm(std, 'mret * rret', 8)}, 0)",
    "crossultra_related_return_corr_{s}_relative_return_8": pm(corr, "x", "rret", 8), "crossultra_mean_{s}_location_spread_8": pm(mean, "mloc - rloc", 8)})
cross_query("crosshyper", {"crosshyper_slow_zdist_{s}_relative_range_gap_8": f"(({pm(mean, 'mrange - rrange', 8)}) - ({pm(mean, 'mrange - rrange', 16)})) / nullif({pm(std, 'mrange - rrange', 16)}, 0)", "crosshyper_mean_{s}_beta_residual_8": pm(mean, "resid8", 8),
    "crosshyper_volume_corr_{s}_relative_range_gap_8": pm(corr, "(mrange - rrange)", "mvc", 8), "crosshyper_abs_share_{s}_lead_lag_pressure_8": f"({pm(total, 'lead_ret - mret', 8)}) / nullif({pm(total, 'abs(lead_ret - mret)', 8)}, 0)"})
cross_query("crossomega", {"crossomega_main_beta_{s}_rel_ret_8": f"({pm(cov, 'x', 'mret', 8)}) / nullif({pm(var, 'mret', 8)}, 0)", "crossomega_diff_std_{s}_rel_ret_8": pm(std, "dx", 8), "crossomega_persistence_{s}_rel_ret_8": f"({pm(total, 'sign(x)', 8)}) / 8",
    "crossomega_mean_{s}_lead_intrabar_8": pm(mean, "lead_intra", 8), "crossomega_std_{s}_ret_product_8": f"nullif({pm(std, 'mret * rret', 8)}, 0)"})

DAY = "(ts::DATE + CASE WHEN hour(ts) >= 21 THEN 1 ELSE 0 END)"
CAL = {
    "td": f"{DAY}::DATE", "minute_of_day": "hour(ts) * 60 + minute(ts)",
}
CAL2 = {
    "dow": "(isodow(td) - 1)", "dim": "day(last_day(td))", "left_": "day(last_day(td)) - day(td)", "c": "nullif(close, 0)", "rm20": mean("cc", 20, 5), "im20": mean("oc", 20, 5), "rp": "(high - low) / nullif(open, 0)", "vm20": mean("volume", 20, 5),
}
CALB = dict(base=O.bars(30), bars=lambda s, d: B.with_returns(bars_30m(s, d)))
factor_query("calendar", {"calendar_time_sin": "sin(2 * pi() * minute_of_day / 1440)", "calendar_week_cos": "cos(2 * pi() * dow / 5)", "calendar_day_of_month_centered": "(day(td) - 1) / (dim - 1) - 0.5", "calendar_night_session": "CASE WHEN hour(ts) >= 21 OR hour(ts) < 9 THEN 1.0 ELSE 0.0 END",
    "calendar_day_close": "CASE WHEN hour(ts) = 14 AND minute(ts) >= 30 THEN 1.0 ELSE 0.0 END", "calendar_friday_or_preweekend": "CASE WHEN dow >= 4 THEN 1.0 ELSE 0.0 END", "calendar_month_end": "CASE WHEN left_ <= 3 THEN 1.0 ELSE 0.0 END"}, [O.RETURNS, CAL, CAL2], **CALB)
factor_query("calendar_x", {"calendar_x_time_cos_ret_mean20": "cos(2 * pi() * minute_of_day / 1440) * rm20", "calendar_x_night_session_abs_ret": "CASE WHEN hour(ts) >= 21 OR hour(ts) < 9 THEN 1.0 ELSE 0.0 END * abs(cc)", "calendar_x_week_sin_intrabar_mean20": "sin(2 * pi() * dow / 5) * im20",
    "calendar_ext_morning_mean_ret_21": f"CASE WHEN hour(ts) >= 9 AND hour(ts) < 11 THEN 1.0 ELSE 0.0 END * ({mean('cc', 21, 7)})", "calendar_ext_night_level_range": "CASE WHEN hour(ts) >= 21 OR hour(ts) < 9 THEN 1.0 ELSE 0.0 END * rp",
    "calendar_ext_night_zdist_intrabar_34": f"CASE WHEN hour(ts) >= 21 OR hour(ts) < 9 THEN 1.0 ELSE 0.0 END * ((oc - ({mean('oc', 34, 11)})) / nullif({std('oc', 34, 11)}, 0))"}, [O.RETURNS, CAL, CAL2], **CALB)

MPAIR = "PARTITION BY symbol, macro ORDER BY ts"
MACRO_STEPS = [
    "SELECT * REPLACE (coalesce(macro, 'ORDERS') AS macro) FROM {prev}",
    {"mret": pct("close", 1, MPAIR), "mr": f"(last_value(m_close IGNORE NULLS) OVER ({MPAIR} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / nullif(last_value(m_close IGNORE NULLS) OVER ({MPAIR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1)",
     "level": "ln(nullif(m_close, 0))", "mrange": "(high - low) / nullif(open, 0)"},
]


def m10(f, *a):
    return f(*a, 3, MPAIR)


def mcov(x, y, w=10):
    return O.guarded(f"covar_samp({x}, {y})", f"CASE WHEN {x} IS NOT NULL THEN {y} END", w, 3, MPAIR)


factor_query("macro", {"macro_ret_1_{s}": "mr", "macro_level_change_{s}": f"m_close - {lag('m_close', 1, MPAIR)}", "macro_log_level_{s}": "level", "macro_range_product_1_{s}": "mrange * abs(mr)", "macro_ret_mean_{s}_10": m10(mean, "mr", 10),
    "macro_level_zdist_{s}_10": f"(level - ({m10(mean, 'level', 10)})) / nullif({m10(std, 'level', 10)}, 0)", "macro_main_ret_spread_{s}_10": f"({m10(mean, 'mret', 10)}) - ({m10(mean, 'mr', 10)})", "macro_beta_main_{s}_10": f"({mcov('mret', 'mr')}) / nullif({m10(var, 'mr', 10)}, 0)",
    "macro_abs_shock_{s}_10": f"abs(mr) / nullif({m10(mean, 'abs(mr)', 10)}, 0) - 1"}, MACRO_STEPS, "macro", MACRO_ON_BARS, lambda s, d: align.align_macro(bars_1d(s, d), macro_1d(s, d), 1), MPAIR, ("symbol", "macro"))


@query(rounded(f"SELECT * FROM (UNPIVOT (SELECT symbol, ts, {', '.join(f'z_{f} AS {f}' for f in O.NAMES)} FROM ({chain(O.DAILY, O.BASIC_RAW, O.BASIC, {f'z_{f}': z(f'{f}_raw') for f in O.NAMES})})) ON {', '.join(O.NAMES)} INTO NAME factor VALUE value)".replace("UNPIVOT (", "UNPIVOT ("), ("symbol", "ts", "factor"), ("value",)) + " WHERE value IS NOT NULL")
def factor_long(spark, d):
    return build_factors(bars_1d(spark, d), set(O.NAMES)).where("value IS NOT NULL")


RELATED_DEFAULT, MACRO_DEFAULT = ("CS.DCE", "M.DCE", "Y.DCE", "P.DCE"), ("000300.SH", "000001.SH", "399006.SZ", "USDCNY.IB", "CBA00101.CS")


@query(f"SELECT t.*, coalesce(v.n_values, 0) AS n_values FROM (VALUES ('basic', 4::BIGINT, 1::BIGINT, 4::BIGINT), ('parametric', 16400, 5, 16404), ('cross_asset', 50480, 16405, 106884), ('non_cross_complex', 40000, 26885, 86884), ('calendar', 20093, 106885, 126977), ('macro_state', 390, 126978, 127367)) t(family, n, first_id, last_id) LEFT JOIN (SELECT 'basic' AS family, count(value) AS n_values FROM ({O.scores()})) v USING (family)")
def factor_taxonomy(spark, d):
    c = catalog_frame(spark, RELATED_DEFAULT, MACRO_DEFAULT)
    c = c.join(score_rows(spark, d).groupBy("factor").agg(F.count("value").alias("n")).withColumnRenamed("n", "_n"), "factor", "left")
    return c.groupBy(names.family(F.col("factor")).alias("family")).agg(F.count("*").alias("n"), F.min("factor_id").alias("first_id"), F.max("factor_id").alias("last_id"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_values"))


@query()
def factor_metadata(spark, d):
    c, f = catalog_frame(spark, RELATED_DEFAULT, MACRO_DEFAULT), F.col("factor")
    have = score_rows(spark, d).groupBy("factor").agg(F.count("value").alias("n_values"), F.min(F.when(F.col("value").isNotNull(), F.col("ts"))).alias("first_ts"))
    return c.join(have, "factor", "left").select("factor_id", "factor", names.family(f).alias("family"), names.window(f).alias("estimated_window"), names.token_count(f).alias("tokens"), names.complexity(f).alias("complexity"), "n_values", "first_ts")


# single-factor tests on daily bars and the four basic factors

SF = ["symbol", "factor"]
SEG = [*SF, "segment"]
COST = BacktestSettings(commission_bps=1.0, slippage_bps=0.5)
SCORE_COLS = ["open", "high", "low", "close", "volume", "amt", "cc", "oc"]


def score_rows(spark, d) -> DataFrame:
    """(symbol, ts, bars, returns, factor, value)"""
    listed = {f.name: f for _, _, f, _ in catalog.catalog()}
    bars = B.with_returns(bars_1d(spark, d))
    frames = Frames()
    from .plans.factors import Formulas

    forms = Formulas(frames)
    out = frames.apply(bars, {n: frames.z(forms.raw(listed[n])) for n in O.NAMES}, ["symbol", "ts", *SCORE_COLS])
    return out.unpivot(["symbol", "ts", *SCORE_COLS], list(O.NAMES), "factor", "value")


def segmented(spark, d) -> DataFrame:
    return backtest.signals(backtest.segments(score_rows(spark, d), keys=tuple(SF)), SF)


def tested(spark, d) -> DataFrame:
    return backtest.backtest(segmented(spark, d), SEG, COST.cost)


@query(rounded(chain(O.scores(), O.SIGNAL, O.POSITION), ("symbol", "factor", "ts"), ("value", "raw_signal", "position")))
def signal_threshold(spark, d):
    return backtest.signals(score_rows(spark, d), SF).select("symbol", "factor", "ts", "value", "raw_signal", "position")


@query(f"SELECT symbol, factor, ts, segment FROM ({chain(O.scores(), O.SEGMENT)})")
def split_segments(spark, d):
    return backtest.segments(score_rows(spark, d), keys=tuple(SF)).select("symbol", "factor", "ts", "segment")


@query(f"""SELECT symbol, ts, CASE WHEN row_number() OVER ({O.P}) - 1 < least(greatest(floor(count(*) OVER (PARTITION BY symbol) * 0.7::DOUBLE), 1), count(*) OVER (PARTITION BY symbol) - 1)
    THEN 'train' ELSE 'test' END AS segment FROM ({O.DAILY})""")  # fmt: skip
def split_train_test(spark, d):
    return backtest.two_segments(bars_1d(spark, d)).select("symbol", "ts", "segment")


DETAIL_DOUBLES = ("position", "turnover", "trading_cost", "gross_return", "net_return", "benchmark_return", "nav", "benchmark_nav", "drawdown")


@query(rounded(O.detail(COST.cost), ("symbol", "factor", "segment", "ts"), DETAIL_DOUBLES))
def backtest_detail(spark, d):
    """Running figures go from year to year."""
    return backtest.backtest(segmented(spark, d), SEG, COST.cost, "year").select("symbol", "factor", "segment", "ts", *DETAIL_DOUBLES)


@query(rounded(O.metrics(O.detail(COST.cost), "symbol, factor, segment"), tuple(SEG), O.METRICS))
def backtest_metrics(spark, d):
    return backtest.performance(tested(spark, d), SEG)


QUERIES["backtest_metrics_spans"], SQL["backtest_metrics_spans"] = lambda spark, d: tidy(backtest.performance(tested(spark, d), SEG, block="year")), SQL["backtest_metrics"]


@query(rounded(f"SELECT symbol, factor, segment, trade, sum(net_return) AS pnl, count(*) AS bars FROM (SELECT *, CASE WHEN position <> 0 THEN sum(new) OVER ({(by := 'PARTITION BY symbol, factor, segment ORDER BY ts')} ROWS UNBOUNDED PRECEDING) END::BIGINT AS trade FROM (SELECT *, CASE WHEN position <> 0 AND position <> coalesce(lag(position) OVER ({by}), 0) THEN 1 ELSE 0 END AS new FROM ({O.detail(COST.cost)}))) WHERE trade IS NOT NULL GROUP BY ALL", ("symbol", "factor", "segment", "trade", "bars"), ("pnl",)))
def trade_stats(spark, d):
    return backtest.with_trades(tested(spark, d), SEG).where("trade IS NOT NULL").groupBy(*SEG, "trade").agg(F.sum("net_return").alias("pnl"), F.count("*").alias("bars"))


@query(rounded(f"SELECT symbol, factor, segment, avg((coalesce(raw_signal, 0) <> 0)::INT) AS signal_coverage, avg((position <> 0)::INT) AS position_coverage FROM ({O.detail(COST.cost)}) GROUP BY ALL", tuple(SEG), ("signal_coverage", "position_coverage")))
def signal_coverage(spark, d):
    return backtest.coverage(tested(spark, d), SEG)


@query(rounded(f"""WITH m AS (SELECT symbol, factor, segment, date_trunc('month', ts)::DATE AS month, product(1 + net_return) - 1 AS r FROM ({O.detail(COST.cost)}) GROUP BY ALL),
    s AS (SELECT symbol, factor, segment, unnest(generate_series(a, b, INTERVAL 1 month))::DATE AS month FROM (SELECT symbol, factor, segment, min(month) AS a, max(month) AS b FROM m GROUP BY ALL)), e AS (SELECT s.*, coalesce(m.r, 0) AS r FROM s LEFT JOIN m USING (symbol, factor, segment, month))
    SELECT symbol, factor, segment, count(*)::DOUBLE AS month_count, avg((r > 0)::INT) AS profitable_month_share, avg(r) AS month_mean, stddev_pop(r) AS month_std, min(r) AS month_worst, max(r) AS month_best,
      max(greatest(r, 0)) / nullif(sum(greatest(r, 0)), 0) AS month_concentration FROM e GROUP BY ALL""", tuple(SEG), ("month_count", "profitable_month_share", "month_mean", "month_std", "month_worst", "month_best", "month_concentration")))  # fmt: skip
def monthly_stability(spark, d):
    return backtest.monthly_stability(tested(spark, d), SEG)


def direction_sql() -> str:
    one = lambda s: O.metrics(chain(O.scores(), O.SEGMENT, f"SELECT * REPLACE (value * {s} AS value) FROM {{prev}}", O.SIGNAL, O.POSITION, "SELECT * FROM {prev} WHERE segment = 'train'", *O.detail_steps("symbol, factor", COST.cost)), "symbol, factor")
    low = "'-infinity'::DOUBLE"
    return f"""SELECT symbol, factor, p.sharpe AS positive_sharpe, p.total_return AS positive_total_return, n.sharpe AS negative_sharpe, n.total_return AS negative_total_return,
      CASE WHEN coalesce(p.sharpe, {low}) > coalesce(n.sharpe, {low}) OR (coalesce(p.sharpe, {low}) = coalesce(n.sharpe, {low}) AND coalesce(p.total_return, {low}) >= coalesce(n.total_return, {low})) THEN 1.0 ELSE -1.0 END::DOUBLE AS direction
    FROM ({one(1)}) p JOIN ({one(-1)}) n USING (symbol, factor)"""


@query(rounded(direction_sql(), tuple(SF), ("positive_sharpe", "positive_total_return", "negative_sharpe", "negative_total_return", "direction")))
def direction_choice(spark, d):
    return backtest.choose_direction(backtest.segments(score_rows(spark, d), keys=tuple(SF)), SF, COST)


FRAME = f"""SELECT * FROM (SELECT symbol, factor, segment, ts, value AS score, lead(oc) OVER w AS future_return, lead(segment) OVER w AS nxt FROM ({chain(O.scores(), O.SEGMENT)}) WINDOW w AS (PARTITION BY symbol, factor ORDER BY ts))
    WHERE nxt = segment AND score IS NOT NULL AND future_return IS NOT NULL"""


def information_sql(keys: str, source: str = FRAME) -> str:
    return f"""SELECT {keys}, {O.correlation('score', 'future_return')} AS ic, {O.correlation('ra', 'rb')} AS rank_ic, count(*)::DOUBLE AS ic_count
      FROM (SELECT *, {O.average_rank('score', keys)} AS ra, {O.average_rank('future_return', keys)} AS rb FROM ({source})) GROUP BY {keys}"""


@query(rounded(information_sql("symbol, factor, segment"), tuple(SEG), ("ic", "rank_ic", "ic_count")))
def ic_rankic(spark, d):
    return predictive.information(predictive.predictive_frame(segmented(spark, d), SF), SEG)


@query(rounded(f"""SELECT symbol, factor, segment, avg(ic) / nullif(stddev_pop(ic), 0) AS icir, avg(rank_ic) / nullif(stddev_pop(rank_ic), 0) AS rank_icir, avg((ic > 0)::INT) AS ic_win_rate, count(*)::DOUBLE AS ic_month_count
    FROM ({information_sql('symbol, factor, segment, month', f"SELECT *, date_trunc('month', ts)::DATE AS month FROM ({FRAME})")}) WHERE ic IS NOT NULL OR rank_ic IS NOT NULL GROUP BY ALL""", tuple(SEG), ("icir", "rank_icir", "ic_win_rate", "ic_month_count")))  # fmt: skip
def icir_monthly(spark, d):
    return predictive.monthly_information(predictive.predictive_frame(segmented(spark, d), SF), SEG)


BY_SF = "PARTITION BY symbol, factor ORDER BY ts"
QCUT = chain(O.scores(), O.SEGMENT, {f"q{k}": quantile("value", 480, k / 5, 240, BY_SF) for k in range(1, 5)} | {"sd": std("value", 480, 240, BY_SF)},
    {"qcut_label": f"CASE WHEN value IS NOT NULL AND sd > 0 AND {' AND '.join(f'q{k} IS NOT NULL' for k in range(1, 5))} THEN 1.0 + {' + '.join(f'(value > q{k})::INT' for k in range(1, 5))} END::DOUBLE"},
    {"effective_group": f"lag(qcut_label) OVER ({BY_SF})"})


def labelled(spark, d):
    return predictive.qcut_labels(backtest.segments(score_rows(spark, d), keys=tuple(SF)), SF)


@query(rounded(QCUT, ("symbol", "factor", "ts"), ("qcut_label", "effective_group")))
def qcut_labels(spark, d):
    return labelled(spark, d).select("symbol", "factor", "ts", "qcut_label", "effective_group")


@query(rounded(f"SELECT symbol, factor, segment, ts, g::INT AS group_id, ret AS group_return, product(1 + ret) OVER (PARTITION BY symbol, factor, segment, g ORDER BY ts ROWS UNBOUNDED PRECEDING) AS group_nav FROM (SELECT *, CASE WHEN effective_group = g THEN coalesce(oc, 0) ELSE 0 END AS ret FROM ({QCUT}), unnest(range(1, 6)) AS u(g))", ("symbol", "factor", "segment", "ts", "group_id"), ("group_return", "group_nav")))
def qcut_group_nav(spark, d):
    return predictive.qcut_nav(labelled(spark, d), SEG)


QSUM = f"""SELECT symbol, factor, segment, g::INT AS group_id, coalesce(n, 0) AS n, mean_return, win_rate FROM (SELECT DISTINCT symbol, factor, segment, g FROM ({QCUT}), unnest(range(1, 6)) AS u(g))
    LEFT JOIN (SELECT symbol, factor, segment, effective_group::INT AS g, count(*) AS n, avg(coalesce(oc, 0)) AS mean_return, avg((coalesce(oc, 0) > 0)::INT) AS win_rate FROM ({QCUT}) WHERE effective_group IS NOT NULL GROUP BY ALL) USING (symbol, factor, segment, g)"""


@query(rounded(QSUM, ("symbol", "factor", "segment", "group_id", "n"), ("mean_return", "win_rate")))
def qcut_summary(spark, d):
    return predictive.qcut_summary(labelled(spark, d), SEG)


@query(rounded(f"""SELECT symbol, factor, segment, m AS monotonicity, CASE WHEN m IS NOT NULL THEN t - b END AS group_spread, CASE WHEN m IS NOT NULL THEN t END AS top_group_mean, CASE WHEN m IS NOT NULL THEN b END AS bottom_group_mean FROM (
    SELECT symbol, factor, segment, {O.correlation('ra', 'rb')} AS m, arg_max(mean_return, group_id) AS t, arg_min(mean_return, group_id) AS b FROM (
    SELECT *, {O.average_rank('group_id', 'symbol, factor, segment')} AS ra, {O.average_rank('mean_return', 'symbol, factor, segment')} AS rb FROM ({QSUM}) WHERE mean_return IS NOT NULL) GROUP BY ALL)""", tuple(SEG), ("monotonicity", "group_spread", "top_group_mean", "bottom_group_mean")))  # fmt: skip
def group_monotonicity(spark, d):
    return predictive.monotonicity(predictive.qcut_summary(labelled(spark, d), SEG), SEG)


@query(rounded(f"SELECT symbol, factor, segment, cost_bps, mean_cost, {', '.join(O.METRICS)} FROM ({O.metrics(f'SELECT * REPLACE (gross_return - turnover * cost_bps / 10000 AS net_return) FROM ({O.detail(0.0)}), unnest([0.0, 0.5, 1.0, 2.0, 3.0]::DOUBLE[]) AS u(cost_bps)', 'symbol, factor, segment, cost_bps')}) JOIN (SELECT symbol, factor, segment, cost_bps, avg(turnover * cost_bps / 10000) AS mean_cost FROM ({O.detail(0.0)}), unnest([0.0, 0.5, 1.0, 2.0, 3.0]::DOUBLE[]) AS u(cost_bps) GROUP BY ALL) USING (symbol, factor, segment, cost_bps)", tuple(SEG), ("cost_bps", "mean_cost", *O.METRICS)))
def cost_stress(spark, d):
    return backtest.cost_stress(backtest.backtest(segmented(spark, d), SEG), SEG, COST.cost_stress_bps)


# selection

SUMMARY_COLS = ("sharpe", "total_return", "win_rate", "trade_count", "max_drawdown", "rank_ic", "monotonicity", "signal_coverage")


def summary_rows(spark, d) -> DataFrame:
    """A row for each symbol and factor with train_, validation_ and test_ figures."""
    base, rows = segmented(spark, d), tested(spark, d)
    facts = backtest.performance(rows, SEG).join(backtest.coverage(rows, SEG), SEG)
    facts = facts.join(predictive.information(predictive.predictive_frame(base, SF), SEG), SEG, "left").join(predictive.monotonicity(predictive.qcut_summary(labelled(spark, d), SEG), SEG), SEG, "left")
    cells = [F.max(F.when(F.col("segment") == s, F.col(c))).alias(f"{s}_{c}") for s in ("train", "validation", "test") for c in SUMMARY_COLS]
    ids = F.create_map(*[F.lit(x) for n, name, f, _ in catalog.catalog()[:4] for x in (name, n)])
    return facts.groupBy(*SF).agg(*cells).withColumn("factor_id", ids[F.col("factor")])


RANKED_DOUBLES = ("selection_sharpe", "selection_return", "selection_rank_ic", "selection_monotonicity")


def summary_sql() -> str:
    mono = f"""SELECT symbol, factor, segment, {O.correlation('ra', 'rb')} AS monotonicity FROM (SELECT *, {O.average_rank('group_id', 'symbol, factor, segment')} AS ra, {O.average_rank('mean_return', 'symbol, factor, segment')} AS rb FROM ({QSUM}) WHERE mean_return IS NOT NULL) GROUP BY ALL"""
    facts = f"""SELECT m.*, i.rank_ic, q.monotonicity, c.signal_coverage FROM ({O.metrics(O.detail(COST.cost), 'symbol, factor, segment')}) m LEFT JOIN ({information_sql('symbol, factor, segment')}) i USING (symbol, factor, segment)
      LEFT JOIN ({mono}) q USING (symbol, factor, segment) JOIN (SELECT symbol, factor, segment, avg((coalesce(raw_signal, 0) <> 0)::INT) AS signal_coverage FROM ({O.detail(COST.cost)}) GROUP BY ALL) c USING (symbol, factor, segment)"""
    cells = ", ".join(f"max({c}) FILTER (segment = '{s}') AS {s}_{c}" for s in ("train", "validation", "test") for c in SUMMARY_COLS)
    return f"SELECT symbol, factor, list_position(['momentum', 'reversal', 'breakout', 'volume_confirm'], factor) AS factor_id, {cells} FROM ({facts}) GROUP BY symbol, factor"


RANK_SQL = f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY selection_valid DESC, selection_sharpe DESC NULLS LAST, selection_rank_ic DESC NULLS LAST, selection_monotonicity DESC NULLS LAST, selection_return DESC NULLS LAST, factor_id) AS rank FROM (
    SELECT *, least(train_sharpe, validation_sharpe) AS selection_sharpe, least(train_total_return, validation_total_return) AS selection_return, least(train_rank_ic, validation_rank_ic) AS selection_rank_ic,
      least(train_monotonicity, validation_monotonicity) AS selection_monotonicity, least(train_sharpe, validation_sharpe) IS NOT NULL AND least(train_total_return, validation_total_return) IS NOT NULL AS selection_valid FROM ({summary_sql()}))"""


@query(rounded(f"SELECT *, rank::INT AS rank_, CASE WHEN rank <= 2 THEN 'active' ELSE 'rejected' END AS status FROM ({RANK_SQL})", ("symbol", "factor", "rank_ AS rank", "status"), RANKED_DOUBLES))
def rank_summary(spark, d):
    return selection.rank_summary(summary_rows(spark, d), 2).select("symbol", "factor", "rank", "status", *RANKED_DOUBLES)


LOOSE = LibrarySettings(keep=2, min_sharpe=-5.0, min_total_return=-0.9, min_train_sharpe=-5.0, min_train_total_return=-0.9, min_train_win_rate=0.45, min_selection_win_rate=0.4, min_selection_trades=5, family_quota={"basic": 3})
REASON = """CASE WHEN NOT selection_valid THEN 'invalid_score' WHEN selection_sharpe < -5.0 THEN 'low_selection_sharpe' WHEN selection_return < -0.9 THEN 'low_selection_total_return' WHEN train_sharpe < -5.0 THEN 'low_train_sharpe'
    WHEN train_total_return < -0.9 THEN 'low_train_total_return' WHEN train_win_rate <= 0.45 THEN 'low_train_win_rate' WHEN validation_win_rate <= 0.4 THEN 'low_selection_win_rate' WHEN validation_trade_count < 5 THEN 'low_selection_trade_count'
    WHEN train_trade_count < 0 THEN 'low_train_trade_count' WHEN validation_signal_coverage < 0 THEN 'low_selection_signal_coverage' WHEN train_signal_coverage < 0 THEN 'low_train_signal_coverage' END"""


@query(f"SELECT symbol, factor, {REASON} AS reason FROM ({RANK_SQL})")
def library_gates(spark, d):
    return selection.rank_summary(summary_rows(spark, d), 2).select("symbol", "factor", selection.reject_reason(LOOSE).alias("reason"))


def corr_sql(x: str) -> str:
    return f"SELECT a.symbol, a.factor AS factor_a, b.factor AS factor_b, CASE WHEN min(a.{x}) < max(a.{x}) AND min(b.{x}) < max(b.{x}) THEN corr(a.{x}, b.{x}) END AS corr FROM src a JOIN src b ON a.symbol = b.symbol AND a.ts = b.ts AND a.factor < b.factor WHERE a.{x} IS NOT NULL AND b.{x} IS NOT NULL GROUP BY ALL"


@query(rounded(f"WITH src AS ({O.scores()}) {corr_sql('value')}", ("symbol", "factor_a", "factor_b"), ("corr",)))
def value_corr_pairs(spark, d):
    return selection.correlations(score_rows(spark, d), ["symbol"])


@query(rounded(f"WITH src AS ({chain(O.scores(), O.SIGNAL)}) {corr_sql('raw_signal')}", ("symbol", "factor_a", "factor_b"), ("corr",)))
def signal_corr_pairs(spark, d):
    return selection.correlations(backtest.signals(score_rows(spark, d), SF), ["symbol"], "raw_signal")


@query(rounded(f"SELECT symbol, 'basic' AS family, count(*) AS n, count(*) FILTER (rank <= 2) AS active, avg(selection_sharpe) AS mean_selection_sharpe, max(selection_sharpe) AS max_selection_sharpe FROM ({RANK_SQL}) GROUP BY 1", ("symbol", "family", "n", "active"), ("mean_selection_sharpe", "max_selection_sharpe")))
def family_summary(spark, d):
    return selection.family_summary(selection.rank_summary(summary_rows(spark, d), 2))


@query(rounded(f"""SELECT symbol, count(*) FILTER (rank <= 2) AS active_factors, coalesce(avg(selection_sharpe) FILTER (rank <= 2), avg(validation_sharpe) FILTER (rank <= 2)) AS mean_active_sharpe,
    coalesce(max(selection_sharpe) FILTER (rank <= 2), max(validation_sharpe) FILTER (rank <= 2)) AS max_active_sharpe FROM ({RANK_SQL}) GROUP BY 1""", ("symbol", "active_factors"), ("mean_active_sharpe", "max_active_sharpe")))
def active_library_summary(spark, d):
    return selection.active_summary(selection.rank_summary(summary_rows(spark, d), 2))


@query(rounded(f"SELECT symbol, factor, place::INT AS place, train_sharpe FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY train_sharpe DESC, train_total_return DESC, factor_id) AS place FROM ({summary_sql()}) WHERE train_sharpe >= -2.0 AND train_total_return >= -0.9) WHERE place <= 3", ("symbol", "factor", "place"), ("train_sharpe",)))
def best_on_training(spark, d):
    train = summary_rows(spark, d).select(*SF, "factor_id", F.col("train_sharpe").alias("sharpe"), F.col("train_total_return").alias("total_return"))
    return selection.best_on_training(train, -2.0, -0.9, 3).select(*SF, "place", F.col("sharpe").alias("train_sharpe"))


@query(rounded(f"""SELECT symbol, factor, CASE WHEN factor IN ('momentum', 'breakout') THEN validation_sharpe ELSE train_sharpe END AS sharpe, CASE WHEN factor IN ('momentum', 'breakout') THEN validation_total_return END AS total_return FROM ({summary_sql()})""", tuple(SF), ("sharpe", "total_return")))
def history_merge(spark, d):
    rows = summary_rows(spark, d)
    new = rows.where(F.col("factor").isin("momentum", "breakout")).select(*SF, F.col("validation_sharpe").alias("sharpe"), F.col("validation_total_return").alias("total_return"))
    return selection.merge_history(rows.select(*SF, F.col("train_sharpe").alias("sharpe")), new, SF)


@query(rounded(f"""SELECT *, test_sharpe / nullif(validation_sharpe, 0) AS ratio, coalesce(test_sharpe / nullif(validation_sharpe, 0) < 0.5, false) AS warned FROM (
    SELECT symbol, factor, max(sharpe) FILTER (segment = 'validation') AS validation_sharpe, max(sharpe) FILTER (segment = 'test') AS test_sharpe FROM ({O.metrics(O.detail(COST.cost), 'symbol, factor, segment')}) GROUP BY 1, 2)""", ("symbol", "factor", "warned"), ("validation_sharpe", "test_sharpe", "ratio")))
def validation_gap(spark, d):
    return diagnostics.validation_gap(backtest.performance(tested(spark, d), SEG), SF)


@query(rounded(f"""SELECT s.symbol, s.factor, s.segment, total_return, sharpe, bar_count, CASE WHEN bar_count IS NULL THEN 'no_bars' ELSE 'ok' END AS status FROM (SELECT DISTINCT symbol, factor, segment FROM ({O.detail(COST.cost)})) s
    LEFT JOIN (SELECT * FROM ({O.metrics(O.detail(COST.cost), 'symbol, factor, segment')}) WHERE symbol <> 'A') USING (symbol, factor, segment)""", (*SEG, "status"), ("total_return", "sharpe", "bar_count")))
def backtest_status(spark, d):
    """One symbol's tests are taken away: its keys stay, as not tested."""
    rows = tested(spark, d)
    return backtest.with_status(backtest.performance(rows.where("symbol <> 'A'"), SEG), rows, SEG).select(*SEG, "total_return", "sharpe", "bar_count", "status")


PAIRS_SQL = f"""pairs AS (SELECT symbol, factor_a, factor_b, abs(v.corr) AS v, abs(g.corr) AS s FROM (WITH src AS ({O.scores()}) {corr_sql('value')}) v FULL JOIN (WITH src AS ({chain(O.scores(), O.SIGNAL)}) {corr_sql('raw_signal')}) g USING (symbol, factor_a, factor_b)),
    near AS (SELECT symbol, factor, list({{'o': other, 'v': v, 's': s}}) AS near FROM (SELECT symbol, factor_a AS factor, factor_b AS other, v, s FROM pairs UNION ALL SELECT symbol, factor_b, factor_a, v, s FROM pairs) GROUP BY ALL)"""
CHOSEN = "list_filter(c.near, lambda x: list_contains(w.chosen, x.o))"
ADMITTED = f"""WITH RECURSIVE ranked AS MATERIALIZED (SELECT symbol, factor, rank, {REASON} AS reason FROM ({RANK_SQL})), {PAIRS_SQL},
    cand AS MATERIALIZED (SELECT r.*, coalesce(n.near, []) AS near FROM ranked r LEFT JOIN near n USING (symbol, factor)),
    walk AS (
      SELECT DISTINCT symbol, 0::BIGINT AS rank, NULL::VARCHAR AS factor, []::VARCHAR[] AS chosen, NULL::VARCHAR AS status, NULL::VARCHAR AS reason, NULL::DOUBLE AS mv, NULL::DOUBLE AS ms FROM ranked
      UNION ALL
      SELECT symbol, rank, factor, CASE WHEN status = 'active' THEN list_append(chosen, factor) ELSE chosen END, status, coalesce(early, CASE WHEN status = 'rejected' THEN 'high_corr' END), CASE WHEN early IS NULL THEN mv END, CASE WHEN early IS NULL THEN ms END FROM (
        SELECT *, CASE WHEN gate IS NOT NULL THEN 'rejected' WHEN early IS NOT NULL THEN 'retired' WHEN greatest(mv, ms) >= 0.8 THEN 'rejected' ELSE 'active' END AS status FROM (
          SELECT c.symbol, c.rank, c.factor, w.chosen, c.reason AS gate, coalesce(c.reason, CASE WHEN len(w.chosen) >= 3 THEN 'family_quota_exceeded' WHEN len(w.chosen) >= 2 THEN 'rank_outside_top_n' END) AS early,
            list_max(list_transform({CHOSEN}, lambda x: x.v)) AS mv, list_max(list_transform({CHOSEN}, lambda x: x.s)) AS ms
          FROM walk w JOIN cand c ON c.symbol = w.symbol AND c.rank = w.rank + 1)))
    SELECT symbol, factor, status, reason, len(chosen)::INT AS family_count, mv AS max_value_corr, ms AS max_signal_corr, greatest(mv, ms) AS max_library_corr FROM walk WHERE rank > 0"""


@query(rounded(ADMITTED, ("symbol", "factor", "status", "reason", "family_count"), ("max_value_corr", "max_signal_corr", "max_library_corr")))
def library_admission(spark, d):
    """Lots of three candidates: the fourth meets what an earlier round admitted."""
    ranked = selection.rank_summary(summary_rows(spark, d), 2).withColumn("reason", selection.reject_reason(LOOSE))
    return selection.admit_in_rounds(ranked, score_rows(spark, d), LOOSE, lot=3)


LAGS = 160
LAGGED = f"""SELECT symbol, ts, 'lag_' || lpad(k::VARCHAR, 3, '0') AS factor, close / nullif(before, 0) - 1 AS value FROM (
    SELECT b.symbol, b.ts, k, b.close, p.close AS before FROM (SELECT *, row_number() OVER ({O.P}) AS n FROM ({O.DAILY})) b, unnest(range(1, {LAGS + 1})) AS u(k) JOIN (SELECT symbol, close, row_number() OVER ({O.P}) AS n FROM ({O.DAILY})) p ON p.symbol = b.symbol AND p.n = b.n - k)"""


def lagged_returns(spark, d) -> DataFrame:
    """A family of many like factors: returns over 1 to LAGS bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    names_ = [f"lag_{k:03d}" for k in range(1, LAGS + 1)]
    rows = bars_1d(spark, d).select(*KEY, *[(F.col("close") / F.nullif(F.lag("close", k).over(w), F.lit(0.0)) - 1).alias(n) for k, n in enumerate(names_, 1)])
    return rows.unpivot(KEY, names_, "factor", "value").where("value IS NOT NULL")


CLOSE = f"SELECT * FROM (WITH src AS MATERIALIZED ({LAGGED}) {corr_sql('value')}) WHERE abs(corr) >= 0.9"


@query(rounded(CLOSE, ("symbol", "factor_a", "factor_b"), ("corr",)))
def corr_tiles(spark, d):
    return selection.correlations(lagged_returns(spark, d), ["symbol"], at_least=0.9)


@query(rounded(CLOSE, ("symbol", "factor_a", "factor_b"), ("corr",)))
def corr_screened(spark, d):
    """Sketches rule tiles out before their products."""
    return selection.correlations(lagged_returns(spark, d), ["symbol"], at_least=0.9, screen=True)


@query(rounded(f"SELECT factor, tested_symbols, active_symbols, best_sharpe, best_return, symbols FROM (SELECT factor, count(DISTINCT symbol) AS tested_symbols, 0 AS active_symbols, max(selection_sharpe) AS best_sharpe, max(selection_return) AS best_return, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM ({RANK_SQL}) GROUP BY 1) WHERE tested_symbols >= 2 AND NOT coalesce(best_sharpe >= 3.0, false) AND NOT coalesce(best_return >= 2.0, false) AND factor NOT IN (SELECT factor FROM ({RANK_SQL}) WHERE rank = 1)", ("factor", "tested_symbols", "active_symbols::BIGINT AS active_symbols", "symbols"), ("best_sharpe", "best_return")))
def prune_candidates(spark, d):
    ranked = selection.rank_summary(summary_rows(spark, d), 1)
    return selection.prune_candidates(ranked, ranked.where("status = 'active'"), LibrarySettings(prune_keep_sharpe=3.0, prune_keep_return=2.0))


@query(rounded(f"SELECT symbol, factor, corr(value, t) AS corr, count(*) AS n FROM (SELECT *, CASE WHEN lead(oc) OVER (PARTITION BY symbol, factor ORDER BY ts) > 0 THEN 1.0 ELSE -1.0 END AS t FROM ({O.scores()})) WHERE value IS NOT NULL GROUP BY ALL", ("symbol", "factor", "n"), ("corr",)))
def target_correlation(spark, d):
    ahead = F.lead("oc").over(Window.partitionBy(*SF).orderBy("ts"))
    return selection.target_correlation(score_rows(spark, d).withColumn("target", F.when(ahead > 0, 1.0).otherwise(-1.0)))


AIMED = f"SELECT *, sign(lead(oc) OVER (PARTITION BY symbol, factor ORDER BY ts)) AS t FROM ({O.scores()})"
SELECTED = f"""WITH RECURSIVE src AS MATERIALIZED ({AIMED}), pairs AS ({corr_sql('value')}),
    near AS (SELECT symbol, factor, list(other) AS near FROM (SELECT symbol, factor_a AS factor, factor_b AS other, corr FROM pairs UNION ALL SELECT symbol, factor_b, factor_a, corr FROM pairs) WHERE abs(corr) >= 0.85 GROUP BY ALL),
    ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(c) DESC, factor) AS place FROM (SELECT symbol, factor, corr(value, t) AS c FROM src WHERE value IS NOT NULL AND t IS NOT NULL GROUP BY ALL HAVING count(*) >= 600)),
    cand AS MATERIALIZED (SELECT r.*, coalesce(n.near, []) AS near FROM ranked r LEFT JOIN near n USING (symbol, factor)),
    walk AS (
      SELECT DISTINCT symbol, 0::BIGINT AS place, NULL::VARCHAR AS factor, []::VARCHAR[] AS chosen, false AS took FROM ranked
      UNION ALL
      SELECT c.symbol, c.place, c.factor, CASE WHEN len(w.chosen) < 3 AND NOT list_has_any(c.near, w.chosen) THEN list_append(w.chosen, c.factor) ELSE w.chosen END, len(w.chosen) < 3 AND NOT list_has_any(c.near, w.chosen)
      FROM walk w JOIN cand c ON c.symbol = w.symbol AND c.place = w.place + 1)
    SELECT symbol, factor, place::INT AS place FROM walk WHERE took"""


@query(SELECTED)
def select_in_window(spark, d):
    ahead = F.lead("oc").over(Window.partitionBy(*SF).orderBy("ts"))
    return selection.select_in_window(score_rows(spark, d).withColumn("target", F.signum(ahead)), best=3)


# models and positions on two-hour bars; probabilities of the surrogate p_up = 1 / (1 + exp(-z))

S2 = ["symbol"]
TWO_HOURS = chain(O.bars(120), O.RETURNS, {"raw": pct("close", 5)}, {"value": z("raw")}, {"prob_up": "1 / (1 + exp(-value))"}, {"prob_down": "(1 - prob_up) * 0.8"}, {"prob_flat": "1 - prob_up - prob_down", "edge": "prob_up - prob_down"})
ROWS = tuple(S2 + ["ts"])


def surrogate(spark, d) -> DataFrame:
    frames = Frames()
    out = frames.apply(B.with_returns(bars_2h(spark, d)), {"value": frames.z(frames.pct("close", 5))}, ["symbol", "ts", *SCORE_COLS])
    out = out.withColumn("prob_up", 1 / (1 + F.exp(-F.col("value")))).withColumn("prob_down", (1 - F.col("prob_up")) * 0.8)
    return out.withColumn("prob_flat", 1 - F.col("prob_up") - F.col("prob_down")).withColumn("edge", F.col("prob_up") - F.col("prob_down"))


LABEL = {"future_return": f"lead(close, 3) OVER ({O.P}) / nullif(lead(open, 1) OVER ({O.P}), 0) - 1", "next_return": f"lead(oc, 1) OVER ({O.P})"}
LABEL2 = {"target_direction": "CASE WHEN future_return IS NULL THEN NULL WHEN future_return > 0.0003 THEN 1.0 WHEN future_return < -0.0003 THEN -1.0 ELSE 0.0 END::DOUBLE"}


@query(rounded(chain(TWO_HOURS, LABEL, LABEL2), ROWS, ("future_return", "next_return", "target_direction")))
def future_return_label(spark, d):
    return composite.with_labels(surrogate(spark, d), 3).select(*ROWS, "future_return", "next_return", "target_direction")


@query(rounded(f"SELECT symbol, ts, CASE WHEN target_direction IS NULL THEN 0.0 WHEN target_direction = 0 THEN 0.8 ELSE 1.5 END AS weight FROM ({chain(TWO_HOURS, LABEL, LABEL2)})", ROWS, ("weight",)))
def sample_weights(spark, d):
    return composite.with_labels(surrogate(spark, d), 3).select(*ROWS, composite.sample_weight(F.col("target_direction")).alias("weight"))


STATES = {"sig": "CASE WHEN value > 0.7 THEN 1.0 WHEN value < -0.7 THEN -1.0 ELSE 0.0 END::DOUBLE"}
STATES2 = {"value_diff_1": f"value - {lag('value')}", "value_lag_1": lag("value"), "signal_lag_1": lag("sig"), "signal_change_1": f"sig - {lag('sig')}", "new": f"CASE WHEN sig = {lag('sig')} THEN 0 ELSE 1 END"}
STATES3 = {"island": f"sum(new) OVER ({O.P} ROWS UNBOUNDED PRECEDING)"}
STATES4 = {"signal_streak": "CASE WHEN sig <> 0 THEN row_number() OVER (PARTITION BY symbol, island ORDER BY ts) ELSE 0 END::DOUBLE", "signal": "sig"}


@query(rounded(chain(TWO_HOURS, STATES, STATES2, STATES3, STATES4), ROWS, ("signal", "value_diff_1", "value_lag_1", "signal_lag_1", "signal_change_1", "signal_streak")))
def state_features(spark, d):
    return composite.state_features(surrogate(spark, d), S2).select(*ROWS, "signal", "value_diff_1", "value_lag_1", "signal_lag_1", "signal_change_1", "signal_streak")


@query(rounded(f"SELECT symbol, ts, {', '.join(f'max(value) FILTER (factor = {chr(39)}{f}{chr(39)}) AS {f}_value, max(raw_signal) FILTER (factor = {chr(39)}{f}{chr(39)}) AS {f}_signal' for f in O.NAMES)} FROM ({chain(O.scores(), O.SIGNAL)}) GROUP BY 1, 2", ROWS, tuple(f"{f}_{x}" for f in O.NAMES for x in ("value", "signal"))))
def feature_matrix(spark, d):
    return composite.feature_matrix(score_rows(spark, d), list(O.NAMES))


MARKET = [{"ao": "abs(oc)", "aa": "abs(nullif(amt, 0))"}, {"vo": values("ao", 120), "va": values("aa", 120)}, {"volatility_rank": rank("vo", "ao", 120, 40), "liquidity_rank": rank("va", "aa", 120, 40)},
    {"trade_allowed": "(oc IS NOT NULL AND coalesce(volatility_rank, 0) >= 0.3)::INT::DOUBLE"}]
STRICT = ModelSettings(min_volatility_rank=0.3, min_confidence_rank=0.3, horizon=3)


@query(rounded(chain(TWO_HOURS, *MARKET), ROWS, ("volatility_rank", "liquidity_rank", "trade_allowed")))
def market_state_filter(spark, d):
    return composite.market_state(surrogate(spark, d), STRICT).select(*ROWS, "volatility_rank", "liquidity_rank", "trade_allowed")


CONFIDENCE = [{"ae": "abs(edge)"}, {"ve": values("ae", 240)}, {"confidence_rank": rank("ve", "ae", 240, 80)}, {"confidence_trade_allowed": "(edge IS NOT NULL AND coalesce(confidence_rank, 0) >= 0.3)::INT::DOUBLE"}]


@query(rounded(chain(TWO_HOURS, *CONFIDENCE), ROWS, ("confidence_rank", "confidence_trade_allowed")))
def confidence_rank_filter(spark, d):
    return composite.confidence_rank(surrogate(spark, d), STRICT).select(*ROWS, "confidence_rank", "confidence_trade_allowed")


def signal_sql(e: str, p: str) -> str:
    sure = f"greatest(prob_up, prob_down) >= {p}"
    return f"CASE WHEN prob_up IS NULL OR prob_down IS NULL THEN NULL WHEN edge >= {e} AND {sure} THEN 1.0 WHEN edge <= -({e}) AND {sure} THEN -1.0 ELSE 0.0 END::DOUBLE"


@query(rounded(chain(TWO_HOURS, {"trade_signal": signal_sql("0.2", "0.5")}), ROWS, ("trade_signal",)))
def prob_to_signal(spark, d):
    return surrogate(spark, d).select(*ROWS, composite.trade_signal(F.lit(0.2), F.lit(0.5)).alias("trade_signal"))


SIZE = "greatest(greatest(0.0, least(1.0, (abs(edge) - 0.2) / 0.8)), greatest(0.0, least(1.0, (greatest(prob_up, prob_down) - 0.5) / 0.5)))"


@query(rounded(f"SELECT symbol, ts, CASE WHEN edge IS NULL THEN NULL WHEN {SIZE} > 0 THEN 1.0 ELSE 0.0 END AS fixed_size, CASE WHEN edge IS NULL THEN NULL WHEN {SIZE} > 0 THEN 0.5 + 0.5 * {SIZE} ELSE 0.0 END AS dynamic_size FROM ({TWO_HOURS})", ROWS, ("fixed_size", "dynamic_size")))
def position_size(spark, d):
    size = lambda s: composite.position_size(F.lit(0.2), F.lit(0.5), s)
    return surrogate(spark, d).select(*ROWS, size(ModelSettings()).alias("fixed_size"), size(ModelSettings(dynamic_size=True)).alias("dynamic_size"))


def rules_sql(source: str = f"SELECT *, {signal_sql('0.2', '0.5')} * (0.5 + 0.5 * {SIZE}) AS t FROM ({TWO_HOURS})") -> str:
    """The state machine as a recursion over numbered bars: hold 2, wait 1, smallest change 0.1."""
    return f"""WITH RECURSIVE b AS (SELECT symbol, ts, coalesce(t, 0) AS t, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM ({source})),
      s AS (SELECT symbol, ts, 0::BIGINT AS n, 0.0::DOUBLE AS cur, 0 AS hold, 0 AS cool FROM b WHERE n = 1
        UNION ALL SELECT symbol, ts, n, nxt, CASE WHEN sign(nxt) = 0 THEN 0 WHEN sign(nxt) = sign(cur) THEN hold + 1 ELSE 1 END, wait FROM (
          SELECT symbol, ts, n, cur, hold, CASE WHEN sign(cur) = 0 THEN CASE WHEN cool > 0 THEN 0.0 ELSE t END WHEN hold < 2 AND (sign(t) <> sign(cur)) THEN cur WHEN sign(t) <> sign(cur) THEN 0.0 WHEN abs(t - cur) < 0.1 THEN cur ELSE t END::DOUBLE AS nxt,
            CASE WHEN sign(cur) = 0 THEN greatest(cool - 1, 0) WHEN hold >= 2 AND sign(t) <> sign(cur) THEN 1 ELSE cool END AS wait
          FROM (SELECT b.symbol, b.ts, b.n, b.t, s.cur, s.hold, s.cool FROM s JOIN b ON b.symbol = s.symbol AND b.n = s.n + 1)))
      SELECT symbol, ts, cur AS ruled_position FROM s WHERE n > 0"""


def targets(spark, d) -> DataFrame:
    target = composite.trade_signal(F.lit(0.2), F.lit(0.5)) * composite.position_size(F.lit(0.2), F.lit(0.5), ModelSettings(dynamic_size=True))
    return surrogate(spark, d).select(*ROWS, target.alias("target_position"))


@query(rounded(rules_sql(), ROWS, ("ruled_position",)))
def position_rules(spark, d):
    return composite.position_rules(targets(spark, d), S2).select(*ROWS, "ruled_position")


@query(rounded(rules_sql(), ROWS, ("ruled_position",)))
def position_rules_blocks(spark, d):
    """Blocks of 100 rows, all at once; those that started from a wrong state run again."""
    return composite.position_rules(targets(spark, d), S2, block_rows=100).select(*ROWS, "ruled_position")


@query(rounded(f"SELECT symbol, ts, avg(raw_signal) AS vote_score, CASE WHEN avg(raw_signal) > 0.3 THEN 1.0 WHEN avg(raw_signal) < -0.3 THEN -1.0 ELSE 0.0 END::DOUBLE AS vote_signal FROM ({chain(O.scores(), O.SIGNAL)}) GROUP BY 1, 2", ROWS, ("vote_score", "vote_signal")))
def vote_benchmark(spark, d):
    return composite.vote(backtest.signals(score_rows(spark, d), SF).withColumn("signal", F.col("raw_signal")), 0.3)


@query(rounded(f"SELECT symbol, factor, CASE WHEN sum(raw_signal * nr) < 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS direction FROM (SELECT *, lead(oc) OVER ({BY_SF}) AS nr FROM ({chain(O.scores(), O.SIGNAL)})) WHERE nr IS NOT NULL GROUP BY 1, 2", tuple(SF), ("direction",)))
def signal_direction(spark, d):
    ahead = F.lead("oc").over(Window.partitionBy(*SF).orderBy("ts"))
    return composite.signal_direction(backtest.signals(score_rows(spark, d), SF).withColumn("next_return", ahead), SF)


GRID_SQL = f"""WITH g AS (SELECT e, p FROM unnest([0.01, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2]::DOUBLE[]) a(e), unnest([0.0, 0.5, 0.55, 0.6, 0.65]::DOUBLE[]) b(p)),
    x AS (SELECT symbol, e, p, CASE WHEN trade_allowed > 0 THEN {signal_sql('e', 'p')} ELSE 0.0 END AS s, next_return FROM ({chain(TWO_HOURS, LABEL, *MARKET)}), g),
    f AS (SELECT symbol, e, p, count(*) FILTER (coalesce(s, 0) <> 0) AS trades, avg(s * next_return) AS m, stddev_pop(s * next_return) AS v FROM x GROUP BY ALL),
    k AS (SELECT *, CASE WHEN v > 0 THEN m / v ELSE m END AS score FROM f WHERE trades >= 20),
    o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, e, p) AS i FROM k WHERE score IS NOT NULL)
    SELECT u.symbol, coalesce(e, 0.01) AS min_edge, coalesce(p, 0.0) AS min_probability FROM (SELECT DISTINCT symbol FROM x) u LEFT JOIN (SELECT * FROM o WHERE i = 1) USING (symbol)"""


@query(rounded(GRID_SQL, ("symbol",), ("min_edge", "min_probability")))
def threshold_grid(spark, d):
    rows = composite.market_state(composite.with_labels(surrogate(spark, d), 3), STRICT)
    return composite.calibrated_thresholds(rows, S2, STRICT)


def predictions(spark, d) -> DataFrame:
    rows = composite.confidence_rank(composite.market_state(composite.with_labels(surrogate(spark, d), 3), STRICT), STRICT)
    rows = rows.withColumn("predicted_direction", composite.likeliest()).withColumn("calibrated_direction", F.col("predicted_direction") * -1)
    return rows.withColumn("raw_signal", F.coalesce(composite.trade_signal(F.lit(0.2), F.lit(0.5)), F.lit(0.0))).withColumn("calibrated_prob_edge", F.col("edge") * -1)


PREDICTIONS = chain(TWO_HOURS, LABEL, LABEL2, *MARKET, *CONFIDENCE, {"predicted_direction": "CASE WHEN prob_up IS NULL THEN NULL WHEN prob_up >= prob_flat AND prob_up >= prob_down THEN 1.0 WHEN prob_down >= prob_flat THEN -1.0 ELSE 0.0 END::DOUBLE",
    "raw_signal": f"coalesce({signal_sql('0.2', '0.5')}, 0)", "calibrated_prob_edge": "-edge"}, {"calibrated_direction": "-predicted_direction"},
    "SELECT * FROM {prev} WHERE target_direction IS NOT NULL AND future_return IS NOT NULL AND predicted_direction IS NOT NULL")
DIAG_PLAIN, DIAG_DOUBLES = ("symbol", "n", "traded_n", "tradable_n", "confident_n"), ("target_up_share", "target_down_share", "target_neutral_share", "raw_accuracy", "calibrated_accuracy", "directional_accuracy", "traded_accuracy", "tradable_accuracy", "edge_return_corr", "mean_future_return", "traded_mean_future_return")


@query(rounded(f"""SELECT symbol, count(*) AS n, count(*) FILTER (raw_signal <> 0) AS traded_n, count(*) FILTER (trade_allowed > 0) AS tradable_n, count(*) FILTER (confidence_trade_allowed > 0) AS confident_n, avg((target_direction > 0)::INT) AS target_up_share,
    avg((target_direction < 0)::INT) AS target_down_share, avg((target_direction = 0)::INT) AS target_neutral_share, avg((predicted_direction = target_direction)::INT) AS raw_accuracy, avg((calibrated_direction = target_direction)::INT) AS calibrated_accuracy,
    avg((sign(calibrated_direction) = sign(target_direction))::INT) FILTER (target_direction <> 0) AS directional_accuracy, avg((sign(raw_signal) = sign(target_direction))::INT) FILTER (raw_signal <> 0) AS traded_accuracy,
    avg((sign(calibrated_direction) = sign(target_direction))::INT) FILTER (trade_allowed > 0) AS tradable_accuracy, corr(calibrated_prob_edge, future_return) AS edge_return_corr, avg(future_return) AS mean_future_return,
    avg(future_return) FILTER (raw_signal <> 0) AS traded_mean_future_return FROM ({PREDICTIONS}) GROUP BY 1""", DIAG_PLAIN, DIAG_DOUBLES))  # fmt: skip
def prediction_diagnostics(spark, d):
    return diagnostics.prediction_diagnostics(predictions(spark, d), S2)


@query(rounded(f"SELECT symbol, target_direction, count(*) FILTER (calibrated_direction = -1) AS pred_down, count(*) FILTER (calibrated_direction = 0) AS pred_flat, count(*) FILTER (calibrated_direction = 1) AS pred_up FROM ({PREDICTIONS}) GROUP BY 1, 2", ("symbol", "pred_down", "pred_flat", "pred_up"), ("target_direction",)))
def confusion_matrix(spark, d):
    return diagnostics.confusion_matrix(predictions(spark, d), S2)


BUCKET = """CASE WHEN calibrated_prob_edge <= -0.2 THEN '<=-0.20' WHEN calibrated_prob_edge <= -0.1 THEN '-0.20~-0.10' WHEN calibrated_prob_edge <= -0.05 THEN '-0.10~-0.05' WHEN calibrated_prob_edge <= 0 THEN '-0.05~0'
    WHEN calibrated_prob_edge <= 0.05 THEN '0~0.05' WHEN calibrated_prob_edge <= 0.1 THEN '0.05~0.10' WHEN calibrated_prob_edge <= 0.2 THEN '0.10~0.20' ELSE '>0.20' END"""


@query(rounded(f"SELECT symbol, {BUCKET} AS edge_bucket, count(*) AS n, avg(calibrated_prob_edge) AS mean_edge, avg(future_return) AS mean_future_return, avg((future_return > 0)::INT) AS up_share, avg((future_return < 0)::INT) AS down_share, avg(target_direction) AS mean_target, avg((raw_signal <> 0)::INT) AS traded_share FROM ({PREDICTIONS}) GROUP BY 1, 2", ("symbol", "edge_bucket", "n"), ("mean_edge", "mean_future_return", "up_share", "down_share", "mean_target", "traded_share")))
def edge_buckets(spark, d):
    return diagnostics.edge_buckets(predictions(spark, d), S2)


def strategy(spark, d) -> DataFrame:
    """A backtest of the surrogate's signal, positions a bar late."""
    rows = surrogate(spark, d).withColumn("raw_signal", F.coalesce(composite.trade_signal(F.lit(0.1), F.lit(0.0)), F.lit(0.0))).withColumn("composite_score", F.col("edge")).withColumn("calibrated_prob_edge", F.col("edge"))
    rows = rows.withColumn("position", F.lag("raw_signal", 1, 0.0).over(Window.partitionBy("symbol").orderBy("ts"))).withColumn("directional_probability", F.greatest("prob_up", "prob_down"))
    return backtest.backtest(rows, S2, COST.cost)


STRATEGY = chain(TWO_HOURS, {"raw_signal": f"coalesce({signal_sql('0.1', '0.0')}, 0)", "calibrated_prob_edge": "edge", "directional_probability": "greatest(prob_up, prob_down)"}, {"position": f"lag(raw_signal, 1, 0.0::DOUBLE) OVER ({O.P})"}, *O.detail_steps("symbol", COST.cost))


def robustness_sql() -> str:
    ranked = chain(STRATEGY, {"ab": "abs(benchmark_return)", "ae": "abs(calibrated_prob_edge)"}, {"vb": values("ab", 120), "ve": values("ae", 120)}, {"kb": rank("vb", "ab", 120, 20), "ke": rank("ve", "ae", 120, 20)})
    third = lambda c: f"CASE WHEN {c} <= 0.33 THEN 'low' WHEN {c} <= 0.66 THEN 'middle' WHEN {c} > 0.66 THEN 'high' END"
    kinds = {"overall": "'all'", "month": "strftime(ts, '%Y-%m')", "quarter": "year(ts)::VARCHAR || 'Q' || quarter(ts)::VARCHAR", "volatility": third("kb"), "confidence": third("ke")}
    rows = " UNION ALL ".join(f"SELECT symbol, ts, net_return, benchmark_return, position, '{k}' AS segment_type, {v} AS segment FROM r" for k, v in kinds.items())
    return O.metrics(f"WITH r AS ({ranked}) SELECT * FROM ({rows}) WHERE segment IS NOT NULL", "symbol, segment_type, segment")


@query(rounded(robustness_sql(), ("symbol", "segment_type", "segment"), O.METRICS))
def robustness_segments(spark, d):
    return diagnostics.robustness(strategy(spark, d), S2)


TREND = chain(O.bars(120), {"cc": pct("close")}, {"trend_strength": f"abs({pct('close', 120)}) / nullif({total('abs(cc)', 120)}, 0)"}, {"market_regime": "CASE WHEN trend_strength >= 0.25 THEN 'trend' WHEN trend_strength IS NOT NULL THEN 'range' END"})


@query(rounded(TREND, (*ROWS, "market_regime"), ("trend_strength",)))
def trend_regime(spark, d):
    return composite.trend_strength(B.with_returns(bars_2h(spark, d))).select(*ROWS, "trend_strength", "market_regime")


@query(rounded(f"SELECT symbol, ts, w / avg(w) OVER (PARTITION BY symbol) AS decay_weight FROM (SELECT symbol, ts, greatest(0.25, pow(0.5, (row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1) / 400.0)) AS w FROM ({O.bars(120)}))", ROWS, ("decay_weight",)))
def time_decay_weights(spark, d):
    return composite.time_decay(bars_2h(spark, d).select(*ROWS), S2)


# portfolio

PF = PortfolioSettings(window=120, min_samples=40, max_weight=0.3, top_n=3, vol_window=60)


def portfolio_detail(spark, d) -> DataFrame:
    return strategy(spark, d).where("hour(ts) <> 4 OR symbol <> 'click'").select("symbol", "ts", F.col("net_return").alias("strategy_return"), "benchmark_return", "position", "calibrated_prob_edge", "directional_probability")


PDETAIL = f"SELECT symbol, ts, net_return AS strategy_return, benchmark_return, position, calibrated_prob_edge, directional_probability FROM ({STRATEGY}) WHERE hour(ts) <> 4 OR symbol <> 'click'"


def cap_sql(source: str, keep: str, raw: str, cap: float, out: str, passes: int) -> str:
    """Water-filling pass by pass over (method, ts)."""
    by = "OVER (PARTITION BY method, ts)"
    steps: list = [
        {"w0": f"CASE WHEN {keep} THEN greatest(coalesce({raw}, 0), 0) END"}, {"t0": f"sum(w0) {by}", "n0": f"count(w0) {by}"}, {"w": "CASE WHEN w0 IS NOT NULL THEN CASE WHEN t0 > 0 THEN w0 / t0 ELSE 1.0 / n0 END END"},
        {"f0": "CASE WHEN w IS NULL THEN 0.0::DOUBLE END", "b0": "1.0::DOUBLE"},
    ]
    for k in range(passes):
        steps += [
            {f"s{k}_": f"sum(CASE WHEN f{k} IS NULL THEN w END) {by}", f"c{k}": f"count(*) FILTER (f{k} IS NULL) {by}"},
            {f"x{k}": f"CASE WHEN f{k} IS NULL THEN CASE WHEN s{k}_ > 0 THEN w / s{k}_ * b{k} ELSE b{k} / c{k} END END"},
            {f"o{k}": f"count(*) FILTER (f{k} IS NULL AND s{k}_ > 0 AND x{k} > {cap}) {by}"},
            {f"f{k + 1}": f"CASE WHEN f{k} IS NOT NULL THEN f{k} WHEN o{k} = 0 THEN x{k} WHEN s{k}_ > 0 AND x{k} > {cap} THEN {cap} WHEN b{k} - {cap} * o{k} <= 0 THEN 0.0 END::DOUBLE", f"b{k + 1}": f"b{k} - {cap} * o{k}"},
        ]
    steps += [{"ft": f"sum(f{passes}) {by}"}, {out: f"coalesce(CASE WHEN n0 > 1 AND ft > 0 THEN f{passes} / ft ELSE w END, 0)"}]
    made = [c for s in steps for c in s if c != out]
    return f"SELECT * EXCLUDE ({', '.join(made)}) FROM ({chain(source, *steps)})"


PAST = f"OVER ({O.P} ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)"
SPINE = f"SELECT t.ts, s.symbol, d.* EXCLUDE (symbol, ts) FROM (SELECT DISTINCT ts FROM ({PDETAIL})) t CROSS JOIN (SELECT DISTINCT symbol FROM ({PDETAIL})) s LEFT JOIN ({PDETAIL}) d ON d.ts = t.ts AND d.symbol = s.symbol"
HISTORY = chain(SPINE, {"now": "abs(calibrated_prob_edge) * CASE WHEN directional_probability IS NOT NULL THEN greatest(0.0, least(1.0, directional_probability)) END", "m": f"avg(strategy_return) {PAST}", "v": f"stddev_pop(strategy_return) {PAST}", "c": f"count(strategy_return) {PAST}"},
    {"score": f"lag(now) OVER ({O.P})"}, "SELECT * FROM {prev}, unnest(['equal_weight', 'inverse_vol', 'positive_sharpe']) AS u(method)",
    {"sh": "greatest(m / nullif(v, 0), 0)", "good": "strategy_return IS NOT NULL AND c >= 40"}, {"known": "count(*) FILTER (good) OVER (PARTITION BY method, ts)", "ups": "coalesce(sum(CASE WHEN good THEN sh END) OVER (PARTITION BY method, ts), 0)"},
    {"rw": "CASE WHEN method = 'equal_weight' OR known = 0 THEN 1.0 WHEN c >= 40 THEN CASE WHEN method = 'inverse_vol' THEN 1 / nullif(v, 0) WHEN ups > 0 THEN CASE WHEN m / nullif(v, 0) IS NOT NULL THEN sh END ELSE 1.0 END ELSE 0.0 END"})
BASE_W = cap_sql(HISTORY, "strategy_return IS NOT NULL", "rw", 0.3, "base_weight", 5)
CHOSEN = chain(BASE_W, {"sc": "coalesce(score, 0)"}, {"ok": "base_weight > 0 AND sc > 0"}, {"place": "row_number() OVER (PARTITION BY method, ts ORDER BY ok DESC, sc DESC, symbol)"}, {"selected": "ok AND place <= 3"},
    {"boosts": "sum(CASE WHEN selected THEN sc END) OVER (PARTITION BY method, ts)"}, {"rw2": "base_weight * CASE WHEN boosts > 0 THEN sc ELSE 1.0 END"})
WEIGHTS = cap_sql(CHOSEN, "selected", "rw2", 0.3, "weight", 5)


@query(rounded(BASE_W, ("method", "ts", "symbol"), ("base_weight",)))
def portfolio_rolling_weights(spark, d):
    return portfolio.rolling_weights(portfolio.opportunity_scores(portfolio.spine(portfolio_detail(spark, d)), PF), PF).select("method", "ts", "symbol", "base_weight")


@query(rounded(WEIGHTS, ("method", "ts", "symbol", "selected"), ("score", "weight")))
def opportunity_topn(spark, d):
    grid = portfolio.opportunity_scores(portfolio.spine(portfolio_detail(spark, d)), PF)
    return portfolio.opportunity_selection(portfolio.rolling_weights(grid, PF), PF).select("method", "ts", "symbol", "selected", "score", "weight")


def wmean(x: str) -> str:
    return f"coalesce(sum({x} * weight) / nullif(sum(CASE WHEN {x} IS NOT NULL THEN weight END), 0), 0)"


BY_M = "PARTITION BY method ORDER BY ts"
RISK = chain(f"SELECT method, ts, {wmean('strategy_return')} AS raw_return, {wmean('benchmark_return')} AS benchmark_return, {wmean('abs(position)')} AS raw_abs_position, count(strategy_return) AS active_symbols FROM ({WEIGHTS}) GROUP BY 1, 2",
    f"SELECT *, (SELECT greatest(252, round_even(median(n) * 252, 0))::DOUBLE FROM (SELECT count(DISTINCT ts) AS n FROM ({PDETAIL}) GROUP BY ts::DATE)) AS periods FROM {{prev}}",
    {"sd": O.guarded("stddev_pop(raw_return)", "raw_return", 60, 15, BY_M), "nav0": f"product(1 + raw_return) OVER ({BY_M} ROWS UNBOUNDED PRECEDING)"}, {"dd0": f"nav0 / max(nav0) OVER ({BY_M} ROWS UNBOUNDED PRECEDING) - 1"},
    {"realized_annual_vol": f"lag(sd) OVER ({BY_M}) * sqrt(periods)", "before": f"coalesce(lag(dd0) OVER ({BY_M}), 0)"},
    {"vol_multiplier": "CASE WHEN coalesce(realized_annual_vol, 0) > 0 THEN greatest(0.0, least(1.0, 0.12 / realized_annual_vol)) ELSE 1.0 END", "drawdown_multiplier": "CASE WHEN before <= -0.12 THEN 0.0 WHEN before < -0.05 THEN (before + 0.12) / 0.07 ELSE 1.0 END"},
    {"risk_multiplier": "vol_multiplier * drawdown_multiplier"}, {"strategy_return": "raw_return * risk_multiplier", "avg_abs_position": "raw_abs_position * risk_multiplier"},
    {"nav": f"product(1 + strategy_return) OVER ({BY_M} ROWS UNBOUNDED PRECEDING)", "benchmark_nav": f"product(1 + benchmark_return) OVER ({BY_M} ROWS UNBOUNDED PRECEDING)"}, {"drawdown": f"nav / max(nav) OVER ({BY_M} ROWS UNBOUNDED PRECEDING) - 1"})
RISK_DOUBLES = ("raw_return", "benchmark_return", "raw_abs_position", "realized_annual_vol", "vol_multiplier", "drawdown_multiplier", "risk_multiplier", "strategy_return", "avg_abs_position", "nav", "benchmark_nav", "drawdown")


@query(rounded(RISK, ("method", "ts", "active_symbols"), RISK_DOUBLES))
def portfolio_returns(spark, d):
    return portfolio.portfolio(portfolio_detail(spark, d), PF)[0].select("method", "ts", "active_symbols", *RISK_DOUBLES)


@query(rounded(O.metrics(f"SELECT *, round(avg_abs_position, 9) AS position FROM ({RISK})", "method", "strategy_return", "benchmark_return", "periods"), ("method",), O.METRICS))
def portfolio_metrics(spark, d):
    return portfolio.portfolio_metrics(portfolio.portfolio(portfolio_detail(spark, d), PF)[0]).select("method", *O.METRICS)


@query(rounded(f"SELECT w.method, w.ts, w.symbol, coalesce(w.strategy_return, 0) * w.weight * r.risk_multiplier AS contribution FROM ({WEIGHTS}) w JOIN ({RISK}) r USING (method, ts)", ("method", "ts", "symbol"), ("contribution",)))
def portfolio_contribution(spark, d):
    result, weights = portfolio.portfolio(portfolio_detail(spark, d), PF)
    return portfolio.contributions(weights, result)


@query(rounded(f"""SELECT method, symbol, rw / sum(rw) OVER (PARTITION BY method) AS weight FROM (SELECT method, symbol, CASE method WHEN 'equal_weight' THEN 1.0 WHEN 'inverse_vol' THEN 1 / v WHEN 'positive_sharpe' THEN CASE WHEN sum(greatest(m / v, 0)) OVER (PARTITION BY method) > 0 THEN greatest(m / v, 0) ELSE 1.0 END END AS rw
    FROM (SELECT symbol, avg(strategy_return) AS m, stddev_pop(strategy_return) AS v FROM ({PDETAIL}) GROUP BY 1), unnest(['equal_weight', 'inverse_vol', 'positive_sharpe']) AS u(method))""", ("method", "symbol"), ("weight",)))  # fmt: skip
def portfolio_static_weights(spark, d):
    out = [portfolio.static_weights(portfolio_detail(spark, d), m).select(F.lit(m).alias("method"), "symbol", "weight") for m in portfolio.METHODS]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(rounded(f"SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, corr(a.strategy_return, b.strategy_return) AS corr FROM ({PDETAIL}) a JOIN ({PDETAIL}) b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.strategy_return IS NOT NULL AND b.strategy_return IS NOT NULL GROUP BY 1, 2", ("symbol_a", "symbol_b"), ("corr",)))
def strategy_corr(spark, d):
    return portfolio.strategy_correlation(portfolio_detail(spark, d))


SECTOR = "CASE WHEN symbol < 'l' THEN 'a' ELSE 'b' END"
SECTORS = cap_sql(f"SELECT method, ts, {SECTOR} AS sector, sum(base_weight) AS raw FROM ({BASE_W}) GROUP BY ALL", "raw > 0", "raw", 0.6, "cap", 5)


@query(rounded(f"SELECT w.method, w.ts, w.symbol, s.sector, coalesce(w.base_weight * s.cap / nullif(s.raw, 0), 0) AS base_weight FROM (SELECT *, {SECTOR} AS sector FROM ({BASE_W})) w JOIN ({SECTORS}) s USING (method, ts, sector)", ("method", "ts", "symbol", "sector"), ("base_weight",)))
def sector_budget(spark, d):
    detail = portfolio_detail(spark, d)
    grid = portfolio.rolling_weights(portfolio.opportunity_scores(portfolio.spine(detail), PF), PF)
    sectors = detail.select("symbol").distinct().withColumn("sector", F.when(F.col("symbol") < "l", "a").otherwise("b"))
    return portfolio.group_budget(grid, sectors, 0.6, "base_weight").select("method", "ts", "symbol", "sector", "base_weight")


@query(rounded(f"SELECT *, total / nullif(sum(total) OVER (PARTITION BY symbol), 0) AS share FROM (SELECT symbol, factor, sum(m * w) AS total, avg(m * w) AS mean, count(*) AS n FROM (SELECT symbol, factor, avg(abs(value)) AS m FROM ({O.scores()}) GROUP BY 1, 2), (VALUES (1.0::DOUBLE), (0.5::DOUBLE)) AS u(w) GROUP BY 1, 2)", ("symbol", "factor", "n"), ("total", "mean", "share")))
def factor_contribution(spark, d):
    """A value and a signal feature of each factor, the signal weighing half."""
    mean = score_rows(spark, d).groupBy(*SF).agg(F.avg(F.abs("value")).alias("m"))
    both = mean.withColumn("u", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in (("_value", 1.0), ("_signal", 0.5))])))
    return diagnostics.importance_share(both.select("symbol", F.concat("factor", "u.x").alias("feature"), (F.col("m") * F.col("u.w")).alias("importance")), S2)


# models: no SQL; tests compare with brute force

FEATURES = ["f_value", "f_edge", "f_cc", "f_oc"]
SMALL = ModelSettings(train_window=120, min_samples=60, retrain_every=10, min_directional=20)


def model_rows(spark, d) -> DataFrame:
    rows = composite.with_labels(surrogate(spark, d), 1)
    return rows.select(*ROWS, "target_direction", F.col("value").alias("f_value"), F.col("edge").alias("f_edge"), F.col("cc").alias("f_cc"), F.col("oc").alias("f_oc"))


@query()
def model_rolling_logistic(spark, d):
    return models.rolling_predictions(model_rows(spark, d), FEATURES, SMALL)


def _trees(kind: str) -> Callable:
    return lambda spark, d: tidy(models.rolling_predictions(model_rows(spark, d), FEATURES, SMALL, kind=kind))


QUERIES |= {f"model_rolling_{kind}": _trees(kind) for kind in ("boosted", "forest", "extra")}


#: Six factors' signals and values of daily bars: each refit chooses two factors in its own window.
CHOOSING = replace(SMALL, train_window=400, min_samples=200, retrain_every=50, best=2, select_in_window=True)


@query()
def model_rolling_selected(spark, d):
    """Walk-forward refits: factors, thresholds and direction from each window."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = composite.market_state(composite.with_labels(B.with_returns(bars_1d(spark, d)), 1), CHOOSING)
    wide_ = composite.feature_matrix(score_rows(spark, d), list(O.NAMES))
    extra = {f"back_{k}_value": F.col("close") / F.nullif(F.lag("close", k).over(w), F.lit(0.0)) - 1 for k in (3, 20)}
    rows = rows.join(wide_, list(KEY), "left").withColumns(extra).withColumns({f"back_{k}_signal": F.signum(f"back_{k}_value") for k in (3, 20)})
    named = [*O.NAMES, "back_3", "back_20"]
    factors = {f"{n}_signal": [f"{n}_value", f"{n}_signal"] for n in named}
    out = models.rolling_predictions(rows, [c for some in factors.values() for c in some], CHOOSING, factors=factors, calibrate=True)
    return out.withColumn("selected", F.array_join("selected", ","))


@query()
def model_pooled_boosted(spark, d):
    """One boosted model of all symbols' training bars, its probabilities on the others."""
    rows = backtest.segments(model_rows(spark, d))
    model = boosting.fit_pooled(rows.where("segment = 'train'"), FEATURES)
    return tidy(boosting.predict_pooled(model, rows.where("segment <> 'train'").select(*ROWS, "segment", *FEATURES), FEATURES).select(*ROWS, "segment", "prob_down", "prob_flat", "prob_up"))


def _static(kind: str) -> Callable:
    def run(spark, d):
        rows = backtest.segments(model_rows(spark, d))
        return tidy(models.predict(models.fit(rows.where("segment = 'train'"), FEATURES, kind), rows.where("segment <> 'train'"), FEATURES).select(*ROWS, "segment", "prob_down", "prob_flat", "prob_up", "predicted_direction"))

    return run


QUERIES["model_logistic"], QUERIES["model_forest"] = _static("logistic"), _static("forest")


def streamed(spark, d, events_of: Callable, folder: str) -> str:
    """Closed bars of a stream that ends, as a table: a run over the events, and one that closes what is open."""
    from .streaming.bars import close_stream, read_events, streaming_bars, write_bars

    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = read_events(spark, path + "*" if not path.endswith("/") else path, schema, f"{folder}/marks")
    for last in (False, True):
        if last:
            close_stream(spark, schema, f"{folder}/marks")
        write_bars(streaming_bars(events_of(events), 30, "1 hour"), f"{folder}/bars", f"{folder}/state").awaitTermination()
    return f"{folder}/bars"


@query(rounded(O.bars(30), KEY, BAR))
def stream_bars(spark, d):
    """The events as a stream; a mark at its end lets the watermark pass the last windows."""
    return spark.read.schema(B.BAR_SCHEMA).parquet(streamed(spark, d, lambda e: e, scratch(spark))).select(*KEY, *BAR)


STREAMED = chain(O.bars(30), {"m": mean("close", 20)}, "SELECT *, CASE WHEN close / m - 1 > 0.01 THEN 1.0 WHEN close / m - 1 < -0.01 THEN -1.0 ELSE 0.0 END::DOUBLE AS t FROM {prev}")


@query(rounded(rules_sql(f"SELECT symbol, ts, t FROM ({STREAMED})"), ROWS, ("ruled_position",)))
def stream_positions(spark, d):
    """A moving factor and the position rules in the state of a stream of bars, fed in two runs."""
    from .streaming.positions import streamed_positions

    folder = scratch(spark)
    bars = bars_30m(spark, d).select("symbol", "ts", "close")
    half = bars.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5).alias("t")).first()["t"]
    early = F.unix_micros(F.col("ts").cast("timestamp")) <= F.lit(half)
    for part in (early, ~early):
        bars.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = streamed_positions(spark.readStream.schema(bars.schema).parquet(f"{folder}/in"))
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "ruled_position")


def flagship(spark, sf_dir: str) -> DataFrame:
    """Bars, z-scored momentum, signal, lagged position, backtest, metrics of each symbol."""
    bars = B.with_returns(bars_30m(spark, sf_dir))
    frames = Frames()
    scored = frames.apply(bars, {"value": frames.z(frames.pct("close", 12))}, ["symbol", "ts", *SCORE_COLS])
    return tidy(backtest.performance(backtest.backtest(backtest.signals(scored, S2), S2, COST.cost), S2))


FLAGSHIP = rounded(O.metrics(chain(O.bars(30), O.RETURNS, {"raw": pct("close", 12)}, {"value": z("raw")}, {"raw_signal": O.SIGNAL["raw_signal"]}, {"position": f"lag(raw_signal, 1, 0.0::DOUBLE) OVER ({O.P})"}, *O.detail_steps("symbol", COST.cost)), "symbol"), ("symbol",), O.METRICS)
QUERIES["momentum_strategy"], SQL["momentum_strategy"] = flagship, FLAGSHIP
