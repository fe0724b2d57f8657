"""Weights of symbols over time, opportunity selection, risk control.

All tables are long: a row for each bar and symbol. Weights of a bar are normalised by windows on (method, ts), whose
groups hold one row for each symbol.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PortfolioSettings
from .backtest import annual_periods, performance, with_nav

METHODS = ("equal_weight", "inverse_vol", "positive_sharpe")


def spine(detail: DataFrame) -> DataFrame:
    """Every time with every symbol; the details where there are any. Symbols are a dimension of bounded size."""
    times, symbols = detail.select("ts").distinct(), detail.select("symbol").distinct()
    grid = times.join(symbols)
    return grid.join(detail, ["symbol", "ts"], "left")


def periods_of(detail: DataFrame, annual_days: int = 252) -> DataFrame:
    """(periods): one row; bars a day of the joint timeline, times trading days."""
    days = detail.select("ts").distinct().groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("bars_in_day"))
    return days.agg(annual_periods(annual_days).alias("periods"))


def capped(rows: DataFrame, group: list[str], raw: str, cap: float, output: str = "weight", keep: Column | None = None) -> DataFrame:
    """rows with weights that sum to 1 in each group and exceed the cap only where it can't be kept: water-filling.

    keep: rows that take part (others get 0). A pass fixes all weights above the cap and shares what is left among the
    others; every pass but the last uses up one cap at least, so 1 / cap passes do.
    """
    keep = keep if keep is not None else F.lit(True)
    by = Window.partitionBy(*group)
    clean = F.when(keep, F.greatest(F.coalesce(F.when(F.abs(F.col(raw)) < float("inf"), F.col(raw)), F.lit(0.0)), F.lit(0.0)))
    out = rows.withColumn("_w", clean).withColumn("_sum", F.sum("_w").over(by)).withColumn("_n", F.count("_w").over(by))
    out = out.withColumn("_w", F.when(F.col("_w").isNotNull(), F.when(F.col("_sum") > 0, F.col("_w") / F.col("_sum")).otherwise(1.0 / F.col("_n"))))
    if not 0 < cap < 1:
        return out.withColumn(output, F.coalesce("_w", F.lit(0.0))).drop("_w", "_sum", "_n")
    out = out.withColumn("_set", F.when(F.col("_w").isNull(), 0.0)).withColumn("_budget", F.lit(1.0))
    for _ in range(math.ceil(1 / cap) + 1):
        loose = F.col("_set").isNull()
        out = out.withColumn("_s", F.sum(F.when(loose, F.col("_w"))).over(by)).withColumn("_k", F.count_if(loose).over(by))
        share = F.when(F.col("_s") > 0, F.col("_w") / F.col("_s") * F.col("_budget")).otherwise(F.col("_budget") / F.col("_k"))
        out = out.withColumn("_x", F.when(loose, share))
        over = loose & (F.col("_s") > 0) & (F.col("_x") > cap)
        out = out.withColumn("_o", F.count_if(over).over(by))
        left = F.col("_budget") - cap * F.col("_o")
        out = out.withColumn("_set", F.when(~loose, F.col("_set")).when(F.col("_o") == 0, F.col("_x")).when(over, cap).when(left <= 0, 0.0)).withColumn("_budget", left)
    total = F.sum("_set").over(by)
    many = F.col("_n") > 1
    out = out.withColumn("_t", total).withColumn(output, F.coalesce(F.when(many & (F.col("_t") > 0), F.col("_set") / F.col("_t")).otherwise(F.col("_w")), F.lit(0.0)))
    return out.drop("_w", "_sum", "_n", "_set", "_budget", "_s", "_k", "_x", "_o", "_t")


def static_weights(detail: DataFrame, method: str) -> DataFrame:
    """(symbol, weight) over all of the history."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    facts = detail.where("strategy_return IS NOT NULL").groupBy("symbol").agg(F.avg("strategy_return").alias("m"), F.stddev_pop("strategy_return").alias("v"))
    raw = {"equal_weight": F.lit(1.0), "inverse_vol": 1 / F.nullif(F.col("v"), F.lit(0.0)), "positive_sharpe": F.greatest(F.col("m") / F.nullif(F.col("v"), F.lit(0.0)), F.lit(0.0))}[method]
    return capped(facts.withColumn("g", F.lit(0)).withColumn("raw", raw), ["g"], "raw", 1.0).select("symbol", "weight")


def rolling_weights(grid: DataFrame, s: PortfolioSettings = PortfolioSettings(), methods: tuple[str, ...] = METHODS) -> DataFrame:
    """grid for each method with base_weight: from the `window` bars before, of symbols with a return now.

    Symbols without enough history get 0 where another has it; where none has, all weigh alike.
    """
    past = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-s.window, -1)
    r = F.col("strategy_return")
    out = grid.withColumn("_m", F.avg(r).over(past)).withColumn("_v", F.stddev_pop(r).over(past)).withColumn("_c", F.count(r).over(past))
    out = out.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    here, old = r.isNotNull(), F.col("_c") >= s.min_samples
    by = Window.partitionBy("method", "ts")
    sharpe = F.greatest(F.col("_m") / F.nullif(F.col("_v"), F.lit(0.0)), F.lit(0.0))
    out = out.withColumn("_known", F.count_if(here & old).over(by)).withColumn("_up", F.sum(F.when(here & old, sharpe)).over(by))
    by_history = F.when(F.col("method") == "inverse_vol", 1 / F.nullif(F.col("_v"), F.lit(0.0))).otherwise(F.when(F.coalesce("_up", F.lit(0.0)) > 0, sharpe).otherwise(1.0))
    raw = F.when((F.col("method") == "equal_weight") | (F.col("_known") == 0), 1.0).when(old, by_history).otherwise(0.0)
    out = out.withColumn("_raw", raw)
    return capped(out, ["method", "ts"], "_raw", s.max_weight, "base_weight", here).drop("_m", "_v", "_c", "_known", "_up", "_raw")


def opportunity_scores(grid: DataFrame, s: PortfolioSettings = PortfolioSettings()) -> DataFrame:
    """grid with score: how sure the model was at the bar before. Without model columns the position's size."""
    w = Window.partitionBy("symbol").orderBy("ts")
    unit = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))))
    if "calibrated_prob_edge" in grid.columns and s.score_mode in ("edge", "edge_probability", "edge_rank"):
        now = F.abs("calibrated_prob_edge")
        extra = {"edge_probability": "directional_probability", "edge_rank": "confidence_rank"}.get(s.score_mode)
        if extra in grid.columns:
            now = now * unit(extra)
        return grid.withColumn("_now", now).withColumn("score", F.lag("_now").over(w)).drop("_now")
    return grid.withColumn("score", F.abs("position") if "position" in grid.columns else F.col("strategy_return").isNotNull().cast("double"))


def opportunity_selection(weighted: DataFrame, s: PortfolioSettings = PortfolioSettings()) -> DataFrame:
    """weighted with selected and weight: of each bar the top_n symbols by score, weights times score ** power. No symbol, no weight."""
    score = F.coalesce("score", F.lit(0.0))
    good = (F.col("base_weight") > 0) & ((score > 0) if s.min_score <= 0 else (score >= s.min_score))
    out = weighted.withColumn("_good", good)
    place = F.row_number().over(Window.partitionBy("method", "ts").orderBy(F.desc("_good"), F.desc(score), "symbol"))
    out = out.withColumn("_place", place)
    chosen = F.col("_good") & (F.col("_place") <= s.top_n) if s.top_n > 0 else F.col("_good")
    by = Window.partitionBy("method", "ts")
    out = out.withColumn("selected", chosen).withColumn("_boost", F.when(F.col("selected"), F.pow(score, F.lit(s.power)))).withColumn("_boosts", F.sum("_boost").over(by))
    out = out.withColumn("_raw", F.col("base_weight") * F.when(F.col("_boosts") > 0, F.col("_boost")).otherwise(1.0))
    return capped(out, ["method", "ts"], "_raw", s.max_weight, "weight", F.col("selected")).drop("_good", "_place", "_boost", "_boosts", "_raw")


def weighted_mean(value: str, weight: str = "weight") -> Column:
    """Over present values; 0 where their weights are."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return F.coalesce(F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0))


def portfolio_returns(selected: DataFrame) -> DataFrame:
    """(method, ts, raw_return, benchmark_return, raw_abs_position, active_symbols)"""
    rows = selected.withColumn("_p", F.abs("position"))
    return rows.groupBy("method", "ts").agg(
        weighted_mean("strategy_return").alias("raw_return"), weighted_mean("benchmark_return").alias("benchmark_return"), weighted_mean("_p").alias("raw_abs_position"),
        F.count("strategy_return").alias("active_symbols"),
    )


def risk_multiplier(returns: DataFrame, periods: DataFrame, s: PortfolioSettings = PortfolioSettings()) -> DataFrame:
    """returns with risk_multiplier: target volatility over that of the bars before, and less after losses.

    The drawdown that counts is of the returns before any multiplier.
    """
    w = Window.partitionBy("method").orderBy("ts")
    window, run = w.rowsBetween(1 - s.vol_window, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    out = returns.join(periods)  # one row
    std = F.when(F.count("raw_return").over(window) >= max(2, s.vol_window // 4), F.stddev_pop("raw_return").over(window))
    out = out.withColumn("_std", std).withColumn("_nav", F.product(1 + F.col("raw_return")).over(run)).withColumn("_dd", F.col("_nav") / F.max("_nav").over(run) - 1)
    out = out.withColumn("realized_annual_vol", F.lag("_std").over(w) * F.sqrt("periods")).withColumn("_before", F.coalesce(F.lag("_dd").over(w), F.lit(0.0)))
    target = F.greatest(F.lit(0.0), F.least(F.lit(s.leverage), F.lit(s.target_vol) / F.nullif(F.col("realized_annual_vol"), F.lit(0.0))))
    out = out.withColumn("vol_multiplier", F.when(F.coalesce("realized_annual_vol", F.lit(0.0)) > 0, target).otherwise(1.0))
    stop, start = sorted((s.stop, s.reduce_start))
    slope = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_before") - stop) / (start - stop))) if start != stop else F.lit(1.0)
    out = out.withColumn("drawdown_multiplier", F.when(F.col("_before") <= stop, 0.0).when(F.col("_before") < start, slope).otherwise(1.0))
    return out.withColumn("risk_multiplier", F.col("vol_multiplier") * F.col("drawdown_multiplier")).drop("_std", "_nav", "_dd", "_before")


def portfolio(detail: DataFrame, s: PortfolioSettings = PortfolioSettings(), methods: tuple[str, ...] = METHODS, sectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(portfolio by method and time, weights by method, time and symbol). detail: symbol, ts, strategy_return, benchmark_return, position. sectors: symbol, sector, which share at most sector_cap."""
    grid = opportunity_scores(spine(detail), s)
    weights = opportunity_selection(rolling_weights(grid, s, methods), s)
    weights = group_budget(weights, sectors, s.sector_cap) if sectors is not None else weights
    out = risk_multiplier(portfolio_returns(weights), periods_of(detail, s.annual_days), s)
    out = out.withColumn("strategy_return", F.col("raw_return") * F.col("risk_multiplier")).withColumn("avg_abs_position", F.col("raw_abs_position") * F.col("risk_multiplier"))
    return with_nav(out, ["method"], "strategy_return"), weights


def portfolio_metrics(result: DataFrame) -> DataFrame:
    rows = result.withColumn("position", F.round("avg_abs_position", 9))  # equal positions are one trade, whatever the last bits
    more = result.groupBy("method").agg(F.avg("risk_multiplier").alias("mean_multiplier"), F.min("risk_multiplier").alias("min_multiplier"), F.avg("active_symbols").alias("mean_active_symbols"), F.avg("avg_abs_position").alias("mean_abs_position"))
    return performance(rows, ["method"], net="strategy_return", periods="periods").join(more, "method")


def contributions(weights: DataFrame, result: DataFrame) -> DataFrame:
    """(method, ts, symbol, contribution): the symbol's part of the portfolio's return, not re-normalised."""
    scaled = weights.join(result.select("method", "ts", "risk_multiplier"), ["method", "ts"])
    return scaled.select("method", "ts", "symbol", (F.coalesce("strategy_return", F.lit(0.0)) * F.col("weight") * F.col("risk_multiplier")).alias("contribution"))


def group_budget(weights: DataFrame, groups: DataFrame, cap: float, weight: str = "weight") -> DataFrame:
    """weights with group weights capped: a sector's symbols share at most `cap`, as far as there are sectors enough."""
    rows = weights.join(groups, "symbol", "left").withColumn("sector", F.coalesce("sector", F.col("symbol")))
    total = rows.groupBy("method", "ts", "sector").agg(F.sum(weight).alias("_raw"))
    limit = capped(total, ["method", "ts"], "_raw", cap, "_cap", F.col("_raw") > 0)
    return rows.join(limit, ["method", "ts", "sector"]).withColumn(weight, F.coalesce(F.col(weight) * F.col("_cap") / F.nullif(F.col("_raw"), F.lit(0.0)), F.lit(0.0))).drop("_raw", "_cap")


def strategy_correlation(detail: DataFrame) -> DataFrame:
    """(symbol_a, symbol_b, corr) of strategy returns where both have one, each pair once."""
    from .selection import correlations

    rows = detail.select(F.lit("all").alias("scope"), F.col("symbol").alias("factor"), "ts", F.col("strategy_return").alias("value"))
    return correlations(rows, ["scope"]).select(F.col("factor_a").alias("symbol_a"), F.col("factor_b").alias("symbol_b"), "corr")
