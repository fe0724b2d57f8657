"""Data-quality report of bars and daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.bars import gaps, usual_gap


def interval_stats(bars: DataFrame, expected: float | None = None) -> DataFrame:
    """(symbol, inferred_minutes, abnormal_gaps, abnormal_gap_share, max_gap_minutes); expected: minutes (None: the usual gap)."""
    usual = usual_gap(bars)
    target = F.lit(float(expected)) if expected is not None else F.col("inferred_minutes")
    odd = F.bround("minutes") != F.bround(target)
    return gaps(bars).join(usual, "symbol").groupBy("symbol").agg(
        F.first("inferred_minutes").alias("inferred_minutes"), F.count_if(odd).alias("abnormal_gaps"), F.avg(odd.cast("double")).alias("abnormal_gap_share"), F.max("minutes").alias("max_gap_minutes"),
    )


def _share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def quality_report(bars: DataFrame, role: str = "intraday", expected: float | None = 30, extreme: float = 0.08) -> DataFrame:
    """19 figures for each symbol: rows, span, duplicates, missing and odd values, extreme returns, gaps."""
    w = Window.partitionBy("symbol").orderBy("ts")
    price = F.nullif(F.col("close"), F.lit(0.0))
    priced = bars.withColumn("_c", price)
    now = F.last("_c", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("_c", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    priced = priced.withColumn("_r", now / before - 1)
    broken = F.expr("high < low OR open > high OR open < low OR close > high OR close < low")
    far = F.abs("_r") > extreme
    out = priced.groupBy("symbol").agg(
        F.count("*").alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end"), (F.count("*") - F.countDistinct("ts")).alias("duplicate_timestamps"),
        F.avg(F.expr("(CAST(open IS NULL AS double) + CAST(high IS NULL AS double) + CAST(low IS NULL AS double) + CAST(close IS NULL AS double)) / 4")).alias("missing_price_share"),
        F.avg(F.col("volume").isNull().cast("double")).alias("missing_volume_share"), F.avg((F.coalesce("volume", F.lit(0.0)) == 0).cast("double")).alias("zero_volume_share"),
        F.count_if(broken).alias("ohlc_violations"), _share(broken).alias("ohlc_violation_share"), F.count_if(far).alias("extreme_returns"), _share(far).alias("extreme_return_share"),
        F.max("_r").alias("max_return"), F.min("_r").alias("min_return"),
    )
    stats = interval_stats(bars, expected)
    return out.join(stats, "symbol", "left").withColumn("abnormal_gaps", F.coalesce("abnormal_gaps", F.lit(0))).withColumn("role", F.lit(role))


def macro_quality(macro: DataFrame) -> DataFrame:
    """The report of daily series: only the close is looked at, 5 % is extreme, the usual gap is expected."""
    rows = macro.select("symbol", F.col("date").cast("timestamp_ntz").alias("ts"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(None).cast("double").alias("volume"))
    out = quality_report(rows, "macro_daily", None, 0.05)
    nothing = ("missing_volume_share", "zero_volume_share", "ohlc_violations", "ohlc_violation_share")
    return out.withColumns({c: F.lit(None).cast(dict(out.dtypes)[c]) for c in nothing})
