"""Signals, segments, vectorised backtests and their metrics.

A factor's rows of a segment are one window partition, so all factors of all symbols are tested in one plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BacktestSettings

ALL_BEFORE = (Window.unboundedPreceding, 0)


def threshold_signal(score: Column, threshold: float) -> Column:
    """1 above the threshold, -1 below its negative, else 0 (missing scores too)."""
    return F.when(score > threshold, 1.0).when(score < -threshold, -1.0).otherwise(0.0)


def signals(scores: DataFrame, keys: list[str], threshold: float = 0.7, score: str = "value", direction: Column | None = None) -> DataFrame:
    """scores with composite_score, raw_signal and position: the signal of the bar before."""
    directed = F.col(score) * (direction if direction is not None else F.lit(1.0))
    out = scores.withColumn("composite_score", directed).withColumn("raw_signal", threshold_signal(F.col("composite_score"), threshold))
    return out.withColumn("position", F.lag("raw_signal", 1, 0.0).over(Window.partitionBy(*keys).orderBy("ts")))


def segments(bars: DataFrame, train: float = 0.7, validation: float = 0.15, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """bars with `segment`: train, validation or test by place; each has a bar at least."""
    by = Window.partitionBy(*keys)
    placed = bars.withColumn("_n", F.count("*").over(by)).withColumn("_row", F.row_number().over(by.orderBy("ts")) - 1)
    placed = placed.withColumn("_first", F.least(F.greatest(F.floor(F.col("_n") * F.lit(train)), F.lit(1)), F.col("_n") - 2))
    placed = placed.withColumn("_second", F.least(F.greatest(F.floor(F.col("_n") * F.lit(train + validation)), F.col("_first") + 1), F.col("_n") - 1))
    segment = F.when(F.col("_row") < F.col("_first"), "train").when(F.col("_row") < F.col("_second"), "validation").otherwise("test")
    return placed.withColumn("segment", segment).drop("_n", "_row", "_first", "_second")


def two_segments(bars: DataFrame, train: float = 0.7, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    by = Window.partitionBy(*keys)
    placed = bars.withColumn("_n", F.count("*").over(by)).withColumn("_row", F.row_number().over(by.orderBy("ts")) - 1)
    cut = F.least(F.greatest(F.floor(F.col("_n") * F.lit(train)), F.lit(1)), F.col("_n") - 1)
    return placed.withColumn("segment", F.when(F.col("_row") < cut, "train").otherwise("test")).drop("_n", "_row")


# Running figures of a series are windows over it, or with `block` (month, quarter, ...) windows over such spans of it that go
# on from what all spans before them come to: a series of any length is then many tasks, and a span is one row in between.


def spans(rows: DataFrame, block: str | None) -> tuple[DataFrame, list[str]]:
    """rows with the span that they lie in, and the columns that part them beside their keys."""
    return (rows.withColumn("_span", F.date_trunc(block, F.col("ts").cast("timestamp"))), ["_span"]) if block else (rows, [])


def carried(rows: DataFrame, keys: list[str], cells: dict[str, tuple[Column, Callable]]) -> DataFrame:
    """rows with a column for each cell: its aggregate of a span, folded over all spans before the row's."""
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(*keys, "_span").agg(*[one.alias(name) for name, (one, _) in cells.items()])
    return rows.join(each.select(*keys, "_span", *[fold(name).over(before).alias(name) for name, (_, fold) in cells.items()]), [*keys, "_span"])


def latest(name: str) -> Column:
    return F.last(name, True)


def newest(x: Column) -> Column:
    """The value of the last row that has one."""
    return F.max_by(x, F.when(x.isNotNull(), F.col("ts")))


def backtest(rows: DataFrame, keys: list[str], cost: float = 0.0, block: str | None = None) -> DataFrame:
    """Returns, net asset values and drawdowns within each key's rows. rows: position, composite_score, close, oc.

    Rows without position, score or return go first; turnover, benchmark and all running figures are of the rest.
    """
    rows, part = spans(rows.dropna(subset=["position", "composite_score", "oc"]), block)
    w = Window.partitionBy(*keys, *part).orderBy("ts")
    run = w.rowsBetween(*ALL_BEFORE)
    price = F.nullif(F.col("close"), F.lit(0.0))
    rows = carried(rows, keys, {"_position": (F.max_by("position", "ts"), latest), "_close": (newest(price), latest)}) if block else rows.withColumns({"_position": F.lit(None).cast("double"), "_close": F.lit(None).cast("double")})
    before = F.coalesce(F.last(price, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_close"))
    now = F.coalesce(F.last(price, True).over(run), F.col("_close"))
    turnover = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.col("_position"), F.lit(0.0)))
    out = rows.withColumn("turnover", turnover).withColumn("benchmark_return", F.coalesce(now / before - 1, F.lit(0.0))).drop("_position", "_close", *part)
    out = out.withColumn("trading_cost", F.col("turnover") * cost).withColumn("gross_return", F.col("position") * F.col("oc"))
    out = out.withColumn("net_return", F.col("gross_return") - F.col("trading_cost"))
    return with_nav(out, keys, block=block)


def with_nav(out: DataFrame, keys: list[str], net: str = "net_return", benchmark: str = "benchmark_return", block: str | None = None) -> DataFrame:
    """out with nav, benchmark_nav and drawdown from the highest nav so far."""
    out, part = spans(out, block)
    run = Window.partitionBy(*keys, *part).orderBy("ts").rowsBetween(*ALL_BEFORE)
    out = out.withColumn("nav", F.product(1 + F.col(net)).over(run)).withColumn("benchmark_nav", F.product(1 + F.col(benchmark)).over(run))
    if not block:
        return out.withColumn("drawdown", F.col("nav") / F.max("nav").over(run) - 1)
    out = out.withColumn("_high", F.max("nav").over(run)).withColumn("_low", F.min("nav").over(run))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    each = out.groupBy(*keys, "_span").agg(F.product(1 + F.col(net)).alias("_n"), F.product(1 + F.col(benchmark)).alias("_b"), F.max("nav").alias("_h"), F.min("nav").alias("_l"))
    each = each.withColumns({"_n0": F.product("_n").over(before), "_b0": F.product("_b").over(before)})
    start = F.coalesce("_n0", F.lit(1.0))
    peak = lambda high, low: F.when(start >= 0, start * F.col(high)).otherwise(start * F.col(low))
    each = each.withColumn("_peak", peak("_h", "_l")).withColumn("_p0", F.max("_peak").over(before)).select(*keys, "_span", "_n0", "_b0", "_p0")
    out = out.join(each, [*keys, "_span"]).withColumn("_top", F.greatest("_p0", peak("_high", "_low")))
    go_on = lambda now, so_far: F.coalesce(F.coalesce(so_far, F.lit(1.0)) * F.col(now), F.col(so_far))
    out = out.withColumns({"nav": go_on("nav", "_n0"), "benchmark_nav": go_on("benchmark_nav", "_b0")})
    return out.withColumn("drawdown", F.col("nav") / F.col("_top") - 1).drop("_span", "_high", "_low", "_n0", "_b0", "_p0", "_top")


METRICS = ("total_return", "benchmark_total_return", "annual_return", "annual_vol", "sharpe", "max_drawdown", "win_rate", "trade_count", "bar_count", "annual_periods")


def with_trades(detail: DataFrame, keys: list[str], block: str | None = None) -> DataFrame:
    """detail with trade: the number of the trade that a bar with a position belongs to. A changed size is a new trade."""
    detail, part = spans(detail, block)
    w = Window.partitionBy(*keys, *part).orderBy("ts")
    active = F.col("position") != 0
    detail = carried(detail, keys, {"_before": (F.max_by("position", "ts"), latest)}) if block else detail.withColumn("_before", F.lit(None).cast("double"))
    first = F.row_number().over(w) == 1
    earlier = F.when(first, F.col("_before")).otherwise(F.lag("position").over(w))
    out = detail.withColumn("_new", (active & (F.col("position") != F.coalesce(earlier, F.lit(0.0)))).cast("long"))
    out = carried(out, keys, {"_count": (F.sum("_new"), F.sum)}) if block else out.withColumn("_count", F.lit(0))
    number = F.coalesce("_count", F.lit(0)) + F.sum("_new").over(w.rowsBetween(*ALL_BEFORE))
    return out.withColumn("trade", F.when(active, number)).drop("_before", "_count", *part)


def annual_periods(annual_days: int) -> Column:
    """Over rows with bars_in_day on one row of each day."""
    return F.greatest(F.lit(annual_days), F.bround(F.percentile("bars_in_day", 0.5) * annual_days)).cast("double")


def performance(detail: DataFrame, keys: list[str], annual_days: int = 252, net: str = "net_return", benchmark: str = "benchmark_return", periods: str | None = None, block: str | None = None) -> DataFrame:
    """Ten metrics of each key. periods: a column with the periods a year, else they come from the bars of a day.

    Trades and days are marked by windows on the keys' own partitioning, so one exchange and one aggregation do it all. With
    `block` they are groups of their own, added up before any exchange.
    """
    rows = detail.where(F.col(net).isNotNull())
    if block:
        return _performance_of_spans(rows, keys, annual_days, net, benchmark, periods, block)
    day = F.to_date("ts")
    marked = with_trades(rows, keys).withColumn("_day", day)
    trade, by_day = Window.partitionBy(*keys, "trade"), Window.partitionBy(*keys, "_day")
    marked = marked.withColumn("_pnl", F.sum(net).over(trade)).withColumn("_first", F.row_number().over(trade.orderBy("ts")))
    marked = marked.withColumn("_pnl", F.when(F.col("trade").isNotNull() & (F.col("_first") == 1), F.col("_pnl")))
    marked = marked.withColumn("_n", F.count("*").over(by_day)).withColumn("bars_in_day", F.when(F.row_number().over(by_day.orderBy("ts")) == 1, F.col("_n")))
    marked = with_nav(marked.drop("nav", "benchmark_nav", "drawdown"), keys, net, benchmark)
    sums = marked.groupBy(*keys).agg(
        *_sums(net, benchmark), F.avg((F.col("_pnl") > 0).cast("double")).alias("win_rate"), F.count("_pnl").cast("double").alias("trade_count"),
        (F.first(periods) if periods else annual_periods(annual_days)).cast("double").alias("annual_periods"),
    )
    return _annual(sums, keys)


def _sums(net: str, benchmark: str) -> list[Column]:
    return [
        F.product(1 + F.col(net)).alias("equity"), (F.product(1 + F.coalesce(benchmark, F.lit(0.0))) - 1).alias("benchmark_total_return"), F.stddev_pop(net).alias("_std"),
        F.min("drawdown").alias("max_drawdown"), F.count("*").cast("double").alias("bar_count"),
    ]


def _annual(sums: DataFrame, keys: list[str]) -> DataFrame:
    annual = F.when(F.col("equity") >= 0, F.pow("equity", F.col("annual_periods") / F.col("bar_count")) - 1)
    out = sums.withColumn("total_return", F.col("equity") - 1).withColumn("annual_return", annual).withColumn("annual_vol", F.col("_std") * F.sqrt("annual_periods"))
    return out.withColumn("sharpe", F.when(F.col("annual_vol") > 0, F.col("annual_return") / F.col("annual_vol"))).select(*keys, *METRICS)


def _performance_of_spans(rows: DataFrame, keys: list[str], annual_days: int, net: str, benchmark: str, periods: str | None, block: str) -> DataFrame:
    pnl = with_trades(rows, keys, block).where("trade IS NOT NULL").groupBy(*keys, "trade").agg(F.sum(net).alias("_pnl"))
    trades = pnl.groupBy(*keys).agg(F.avg((F.col("_pnl") > 0).cast("double")).alias("win_rate"), F.count("_pnl").cast("double").alias("trade_count"))
    if periods:
        a_year = rows.groupBy(*keys).agg(F.first(periods).cast("double").alias("annual_periods"))
    else:
        a_year = rows.groupBy(*keys, F.to_date("ts").alias("_day")).agg(F.count("*").alias("bars_in_day")).groupBy(*keys).agg(annual_periods(annual_days).alias("annual_periods"))
    sums = with_nav(rows.drop("nav", "benchmark_nav", "drawdown"), keys, net, benchmark, block).groupBy(*keys).agg(*_sums(net, benchmark))
    return _annual(sums.join(a_year, keys).join(trades, keys, "left").withColumn("trade_count", F.coalesce("trade_count", F.lit(0.0))), keys)


def with_status(metrics: DataFrame, every: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every key, `status` ok or no_bars: a series that could not be tested does not stop the others and is not lost."""
    out = every.select(*keys).distinct().join(metrics, keys, "left")
    return out.withColumn("status", F.when(F.col("bar_count").isNull(), "no_bars").otherwise("ok"))


def coverage(detail: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, signal_coverage, position_coverage): shares of bars with a signal, with a position."""
    share = lambda c: F.avg(F.coalesce(F.col(c) != 0, F.lit(False)).cast("double"))
    return detail.groupBy(*keys).agg(share("raw_signal").alias("signal_coverage"), share("position").alias("position_coverage"))


def monthly_stability(detail: DataFrame, keys: list[str]) -> DataFrame:
    """Seven figures of each key's monthly returns; months without bars between the first and last count with 0."""
    month = F.trunc(F.to_date("ts"), "month")
    months = detail.groupBy(*keys, month.alias("month")).agg((F.product(1 + F.coalesce("net_return", F.lit(0.0))) - 1).alias("r"))
    spine = months.groupBy(*keys).agg(F.min("month").alias("a"), F.max("month").alias("b")).select(*keys, F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    every = spine.join(months, [*keys, "month"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    gain = F.greatest("r", F.lit(0.0))
    return every.groupBy(*keys).agg(
        F.count("*").cast("double").alias("month_count"), F.avg((F.col("r") > 0).cast("double")).alias("profitable_month_share"), F.avg("r").alias("month_mean"), F.stddev_pop("r").alias("month_std"),
        F.min("r").alias("month_worst"), F.max("r").alias("month_best"), (F.max(gain) / F.nullif(F.sum(gain), F.lit(0.0))).alias("month_concentration"),
    )


def choose_direction(scores: DataFrame, keys: list[str], settings: BacktestSettings = BacktestSettings(), threshold: float = 0.7) -> DataFrame:
    """(keys, direction, positive_/negative_ sharpe and return): the better sign on training rows by (sharpe, return), 1 if equal.

    scores: value, close, oc, segment. Both signs are tested in one plan, as two rows of each bar.
    """
    both = scores.withColumn("sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    test = signals(both, [*keys, "sign"], threshold, direction=F.col("sign")).where("segment = 'train'")
    found = performance(backtest(test, [*keys, "sign"], settings.cost), [*keys, "sign"], settings.annual_days)
    of = lambda c, s: F.max(F.when(F.col("sign") == s, F.col(c)))
    one = found.groupBy(*keys).agg(*[of(c, s).alias(f"{name}_{c}") for name, s in (("positive", 1.0), ("negative", -1.0)) for c in ("sharpe", "total_return")])
    low = F.lit(float("-inf"))
    key = lambda name: F.struct(F.coalesce(f"{name}_sharpe", low), F.coalesce(f"{name}_total_return", low))
    return one.withColumn("direction", F.when(key("positive") >= key("negative"), 1.0).otherwise(-1.0))


def cost_stress(detail: DataFrame, keys: list[str], bps: tuple[float, ...], annual_days: int = 252) -> DataFrame:
    """(keys, cost_bps, mean_cost, metrics): the same positions at other costs of a unit of turnover."""
    each = detail.withColumn("cost_bps", F.explode(F.array(*map(F.lit, map(float, bps)))))
    each = each.withColumn("cost", F.coalesce("turnover", F.lit(0.0)) * F.col("cost_bps") / 10000).withColumn("net_return", F.coalesce("gross_return", F.lit(0.0)) - F.col("cost"))
    keys = [*keys, "cost_bps"]
    return performance(each, keys, annual_days).join(each.groupBy(*keys).agg(F.avg("cost").alias("mean_cost")), keys)
