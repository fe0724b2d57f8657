"""Bars of other symbols and daily series on the bars of a main symbol, without look-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.bars import MEASURES


def pairs_of(bars: DataFrame, related: list[str]) -> DataFrame:
    """(symbol, related): every symbol with each related one but itself. A table of symbols, not of bars."""
    symbols = bars.select("symbol").distinct()
    return symbols.select("symbol", F.explode(F.array(*map(F.lit, related))).alias("related")).where("symbol <> related")


def filled(x: str, keys: list[str], limit: int) -> Column:
    """The value, or the last one of at most `limit` rows before."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(-limit, 0)
    return F.last(x, True).over(w) if limit else F.col(x)


def align_related(main: DataFrame, related: DataFrame, pairs: DataFrame, limit: int = 2) -> DataFrame:
    """main's rows for each pair, with the related bars of the same time as r_ columns, missing ones filled from the last `limit` bars."""
    columns = [c for c in MEASURES if c in related.columns]
    other = related.select(F.col("symbol").alias("related"), "ts", *[F.col(c).alias(f"r_{c}") for c in columns])
    joined = main.join(pairs, "symbol").join(other, ["related", "ts"], "left")
    rest = [c for c in joined.columns if not c.startswith("r_")]
    return joined.select(*rest, *[filled(f"r_{c}", ["symbol", "related"], limit).alias(f"r_{c}") for c in columns])


def lagged_daily(macro: DataFrame, lag: int = 1) -> DataFrame:
    """The daily series, each value at the date `lag` rows later."""
    if not lag:
        return macro
    return macro.withColumn("close", F.lag("close", lag).over(Window.partitionBy("symbol").orderBy("date")))


def align_macro(bars: DataFrame, macro: DataFrame, lag: int = 1) -> DataFrame:
    """bars for each daily symbol, with m_close: the value of the last date up to the bar's, `lag` days late.

    Each date stands until the next one, so the series is spread over calendar days (a small table) and joined by
    equality; bars after the last date take the last value.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    daily = lagged_daily(macro, lag).withColumn("until", F.date_sub(F.lead("date").over(w), 1))
    spread = daily.where("until IS NOT NULL").select(F.col("symbol").alias("macro"), F.explode(F.sequence("date", "until")).alias("day"), F.struct("close").alias("in_range"))
    last = daily.where("until IS NULL").select(F.col("symbol").alias("macro"), F.col("date").alias("last_date"), F.col("close").alias("last_close"))
    each = bars.withColumn("day", F.to_date("ts")).join(last)  # a row for each daily symbol: a dimension, as small as its list
    out = each.join(spread, ["macro", "day"], "left")
    value = F.coalesce(F.col("in_range.close"), F.when(F.col("day") >= F.col("last_date"), F.col("last_close")))
    return out.select(*bars.columns, "macro", value.alias("m_close"))


def related_coverage(main: DataFrame, related: DataFrame, pairs: DataFrame, limit: int = 2) -> DataFrame:
    """How well related bars cover main ones: 17 figures for each pair."""
    raw = related.groupBy(F.col("symbol").alias("related")).agg(
        F.count("*").alias("raw_rows"), F.min("ts").alias("raw_start"), F.max("ts").alias("raw_end"), (F.count("*") - F.countDistinct("ts")).alias("raw_duplicate_timestamps"),
    )
    aligned = main.select("symbol", "ts").join(pairs, "symbol")
    once = related.select(F.col("symbol").alias("related"), "ts", "close").dropDuplicates(["related", "ts"])
    aligned = aligned.join(once.withColumn("seen", F.col("ts")), ["related", "ts"], "left")
    # the last raw bar up to each main bar: both timelines merged, so no range join
    both = aligned.select("symbol", "related", "ts", "close", F.lit(True).alias("main")).unionByName(
        once.join(pairs, "related").join(main.select("symbol", "ts"), ["symbol", "ts"], "left_anti").select("symbol", "related", "ts", F.lit(None).cast("double").alias("close"), F.lit(False).alias("main"))
    )
    keys = ["symbol", "related"]
    w = Window.partitionBy(*keys).orderBy("ts")
    present = both.join(once.select("related", "ts", F.col("ts").alias("raw_ts")), ["related", "ts"], "left")
    timed = present.withColumn("last_raw", F.last("raw_ts", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("main")
    value = timed.withColumn("filled", filled("close", keys, limit)).select(*keys, "ts", "close", "filled", "last_raw")
    missing = F.col("filled").isNull()
    run = F.sum(F.when(missing, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = value.withColumn("run", run)
    longest = F.sum(missing.cast("long")).over(Window.partitionBy(*keys, "run"))
    lag = F.when(~missing, (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last_raw").cast("timestamp"))) / 60e6)
    direct, usable = F.col("close").isNotNull(), ~missing
    counts = runs.withColumn("longest", longest).groupBy(*keys).agg(
        F.count("*").alias("main_rows"), F.count_if(direct).alias("direct_aligned_rows"), F.count_if(usable & ~direct).alias("ffill_added_rows"), F.count_if(usable).alias("usable_rows"),
        F.count_if(missing).alias("missing_rows_after_ffill"), F.max("longest").alias("max_consecutive_missing_after_ffill"),
        F.max(lag).alias("max_alignment_lag_minutes"), F.avg(lag).alias("avg_alignment_lag_minutes"),
    )
    rate = lambda n, d: F.col(n) / F.nullif(F.col(d), F.lit(0))
    return counts.join(raw, "related").withColumns({
        "direct_coverage_rate": rate("direct_aligned_rows", "main_rows"), "usable_coverage_rate": rate("usable_rows", "main_rows"),
        "missing_rate_after_ffill": rate("missing_rows_after_ffill", "main_rows"), "ffill_share_in_usable": rate("ffill_added_rows", "usable_rows"),
    })
