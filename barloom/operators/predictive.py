"""How well scores foretell returns: rank correlations, rolling quantile groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BacktestSettings
from ..functions.frames import Frames, in_blocks


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank among the key's rows, equal values at their mean rank."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def correlation(x: str, y: str) -> Column:
    """NULL where one side is constant or rows are few."""
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)) & (F.count("*") >= 3)
    return F.when(varied, F.covar_samp(x, y) / F.nullif(spread, F.lit(0.0)))


def predictive_frame(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segment, ts, score, future_return): rows whose next bar is in the same segment. scores: value, oc, segment."""
    w = Window.partitionBy(*keys).orderBy("ts")
    ahead = scores.select(*keys, "segment", "ts", F.col("value").alias("score"), F.lead("oc").over(w).alias("future_return"), F.lead("segment").over(w).alias("_next"))
    return ahead.where("_next = segment AND score IS NOT NULL AND future_return IS NOT NULL").drop("_next")


def information(frame: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ic, rank_ic, ic_count): correlations of score and future return, of values and of ranks."""
    ranked = frame.withColumn("_a", average_rank("score", keys)).withColumn("_b", average_rank("future_return", keys))
    return ranked.groupBy(*keys).agg(correlation("score", "future_return").alias("ic"), correlation("_a", "_b").alias("rank_ic"), F.count("*").cast("double").alias("ic_count"))


def monthly_information(frame: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, icir, rank_icir, ic_win_rate, ic_month_count): mean over deviation of monthly correlations."""
    monthly = information(frame.withColumn("month", F.trunc(F.to_date("ts"), "month")), [*keys, "month"]).where("ic IS NOT NULL OR rank_ic IS NOT NULL")
    ratio = lambda c: F.avg(c) / F.nullif(F.stddev_pop(c), F.lit(0.0))
    return monthly.groupBy(*keys).agg(ratio("ic").alias("icir"), ratio("rank_ic").alias("rank_icir"), F.avg((F.col("ic") > 0).cast("double")).alias("ic_win_rate"), F.count("*").cast("double").alias("ic_month_count"))


def qcut_labels(scores: DataFrame, keys: list[str], settings: BacktestSettings = BacktestSettings(), score: str = "value", block_rows: int = 32768) -> DataFrame:
    """scores with qcut_label: 1 + how many of the past window's quantiles the score exceeds; effective_group: the label before.

    NULL without enough history, for constant history and for missing scores.
    """
    w, least, groups = settings.qcut_window, min(settings.qcut_least, settings.qcut_window), settings.qcut_groups
    frames = Frames((*keys, "block"))
    cuts = {f"_q{k}": frames.quantile(score, w, k / groups, least) for k in range(1, groups)}
    cut = in_blocks(scores, max(block_rows, w + 1), w + 1, tuple(keys))  # the label before a block's first row needs its frame too
    out = frames.apply(cut, cuts | {"_std": frames.std(score, w, least)}, [*scores.columns, "block", "own"])
    label = sum((F.when(F.col(score) > F.col(c), 1.0).otherwise(0.0) for c in cuts), F.lit(1.0))
    good = F.col(score).isNotNull() & (F.col("_std") > 0) & reduce(Column.__and__, [F.col(c).isNotNull() for c in cuts], F.lit(True))
    out = out.withColumn("qcut_label", F.when(good, label))
    out = out.withColumn("effective_group", F.lag("qcut_label").over(Window.partitionBy(*keys, "block").orderBy("ts")))
    return out.where("own").drop(*cuts, "_std", "block", "own")


def qcut_nav(labelled: DataFrame, keys: list[str], groups: int = 5) -> DataFrame:
    """(keys, ts, group_id, group_return, group_nav): the bar's return in its group, 0 in the others. labelled: oc, effective_group."""
    each = labelled.withColumn("group_id", F.explode(F.sequence(F.lit(1), F.lit(groups))))
    each = each.withColumn("group_return", F.when(F.col("effective_group") == F.col("group_id"), F.coalesce("oc", F.lit(0.0))).otherwise(0.0))
    run = Window.partitionBy(*keys, "group_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return each.select(*keys, "ts", "group_id", "group_return", F.product(1 + F.col("group_return")).over(run).alias("group_nav"))


def qcut_summary(labelled: DataFrame, keys: list[str], groups: int = 5) -> DataFrame:
    """(keys, group_id, n, mean_return, win_rate) of every group, those without bars too."""
    oc = F.coalesce("oc", F.lit(0.0))
    found = labelled.where("effective_group IS NOT NULL").groupBy(*keys, F.col("effective_group").cast("int").alias("group_id")).agg(F.count("*").alias("n"), F.avg(oc).alias("mean_return"), F.avg((oc > 0).cast("double")).alias("win_rate"))
    spine = labelled.select(*keys).distinct().withColumn("group_id", F.explode(F.sequence(F.lit(1), F.lit(groups))))
    return spine.join(found, [*keys, "group_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def monotonicity(summary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, monotonicity, group_spread, top_group_mean, bottom_group_mean): rank correlation of group and mean return, three groups at least."""
    rows = summary.where("mean_return IS NOT NULL")
    ranked = rows.withColumn("_a", average_rank("group_id", keys)).withColumn("_b", average_rank("mean_return", keys))
    out = ranked.groupBy(*keys).agg(correlation("_a", "_b").alias("monotonicity"), F.max_by("mean_return", "group_id").alias("top_group_mean"), F.min_by("mean_return", "group_id").alias("bottom_group_mean"))
    known = F.col("monotonicity").isNotNull()
    return out.select(*keys, "monotonicity", F.when(known, F.col("top_group_mean") - F.col("bottom_group_mean")).alias("group_spread"), F.when(known, F.col("top_group_mean")).alias("top_group_mean"), F.when(known, F.col("bottom_group_mean")).alias("bottom_group_mean"))
