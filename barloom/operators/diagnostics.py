"""Reports on predictions and on how returns depend on time and state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import Frames, absolute
from .backtest import performance

# Right-closed edge buckets.
EDGES = (-0.20, -0.10, -0.05, 0.0, 0.05, 0.10, 0.20)
LABELS = ("<=-0.20", "-0.20~-0.10", "-0.10~-0.05", "-0.05~0", "0~0.05", "0.05~0.10", "0.10~0.20", ">0.20")
TERCILES = (0.33, 0.66)


def _valid(rows: DataFrame) -> DataFrame:
    return rows.where("target_direction IS NOT NULL AND future_return IS NOT NULL AND predicted_direction IS NOT NULL")


def prediction_diagnostics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """15 figures of each key. rows: target_direction, future_return, predicted_direction, calibrated_direction, raw_signal, calibrated_prob_edge, trade_allowed, confidence_trade_allowed."""
    t, p, c, g = (F.col(x) for x in ("target_direction", "predicted_direction", "calibrated_direction", "raw_signal"))
    traded, tradable = g != 0, F.coalesce(F.col("trade_allowed") > 0, F.lit(False))
    share = lambda x: F.avg(x.cast("double"))
    share_where = lambda x, where: F.avg(F.when(where, x.cast("double")))
    same = F.signum(c) == F.signum(t)
    edge = "calibrated_prob_edge"
    spread = F.stddev_samp(F.when(F.col(edge).isNotNull(), F.col("future_return"))) * F.stddev_samp(edge)
    return _valid(rows).groupBy(*keys).agg(
        F.count("*").alias("n"), share(t > 0).alias("target_up_share"), share(t < 0).alias("target_down_share"), share(t == 0).alias("target_neutral_share"),
        share(p == t).alias("raw_accuracy"), share(c == t).alias("calibrated_accuracy"), share_where(same, t != 0).alias("directional_accuracy"),
        F.count_if(traded).alias("traded_n"), share_where(F.signum(g) == F.signum(t), traded).alias("traded_accuracy"), F.count_if(tradable).alias("tradable_n"),
        share_where(same, tradable).alias("tradable_accuracy"), F.count_if(F.coalesce(F.col("confidence_trade_allowed") > 0, F.lit(False))).alias("confident_n"),
        (F.covar_samp(edge, "future_return") / F.nullif(spread, F.lit(0.0))).alias("edge_return_corr"), F.avg("future_return").alias("mean_future_return"),
        F.avg(F.when(traded, F.col("future_return"))).alias("traded_mean_future_return"),
    )


def confusion_matrix(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target_direction, pred_down, pred_flat, pred_up): counts."""
    c = F.col("calibrated_direction")
    return _valid(rows).groupBy(*keys, "target_direction").agg(*[F.count_if(c == v).alias(name) for name, v in (("pred_down", -1), ("pred_flat", 0), ("pred_up", 1))])


def edge_buckets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, edge_bucket, six figures) of the buckets that have rows; a value on a border is in the lower bucket."""
    edge = F.col("calibrated_prob_edge")
    label = F.when(edge.isNull(), None)
    for limit, name in zip(EDGES, LABELS, strict=False):
        label = label.when(edge <= limit, name)
    label = label.otherwise(LABELS[-1])
    share = lambda x: F.avg(x.cast("double"))
    return _valid(rows).withColumn("edge_bucket", label).where("edge_bucket IS NOT NULL").groupBy(*keys, "edge_bucket").agg(
        F.count("*").alias("n"), F.avg(edge).alias("mean_edge"), F.avg("future_return").alias("mean_future_return"), share(F.col("future_return") > 0).alias("up_share"),
        share(F.col("future_return") < 0).alias("down_share"), F.avg("target_direction").alias("mean_target"), share(F.col("raw_signal") != 0).alias("traded_share"),
    )


def robustness(detail: DataFrame, keys: list[str], annual_days: int = 252) -> DataFrame:
    """(keys, segment_type, segment, metrics): overall, by month and quarter, by terciles of volatility and of confidence.

    A bar's tags are exploded into rows, so all segments are one aggregation.
    """
    frames = Frames(tuple(keys))
    ranks = {"_vol": frames.rank(absolute("benchmark_return"), 120, 20)}
    if "calibrated_prob_edge" in detail.columns:
        ranks["_conf"] = frames.rank(absolute("calibrated_prob_edge"), 120, 20)
    ranked = frames.apply(detail, ranks, detail.columns).drop("segment", "segment_type")  # the report has its own
    day = F.to_date("ts")
    tag = lambda kind, name: F.struct(F.lit(kind).alias("segment_type"), name.alias("segment"))
    tercile = lambda c: F.when(F.col(c) <= TERCILES[0], "low").when(F.col(c) <= TERCILES[1], "middle").when(F.col(c) > TERCILES[1], "high")
    tags = [tag("overall", F.lit("all")), tag("month", F.date_format(day, "yyyy-MM")), tag("quarter", F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")))]
    tags += [tag("volatility", tercile("_vol"))] + ([tag("confidence", tercile("_conf"))] if "_conf" in ranks else [])
    each = ranked.withColumn("_t", F.explode(F.array(*tags))).select("*", "_t.segment_type", "_t.segment").where("segment IS NOT NULL AND net_return IS NOT NULL").drop("_t", *ranks)
    return performance(each, [*keys, "segment_type", "segment"], annual_days)


def importance_share(importance: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, factor, total, mean, n, share): importances of a factor's features together. importance: feature, importance."""
    base = F.regexp_replace("feature", "_(value|signal)$", "")
    out = importance.groupBy(*keys, base.alias("factor")).agg(F.sum("importance").alias("total"), F.avg("importance").alias("mean"), F.count("*").alias("n"))
    return out.withColumn("share", F.col("total") / F.nullif(F.sum("total").over(Window.partitionBy(*keys)), F.lit(0.0)))


def validation_gap(metrics: DataFrame, keys: list[str], warn: float = 0.5) -> DataFrame:
    """(keys, ratio, warned): test over validation sharpe; a ratio below `warn` is a warning. metrics: segment, sharpe."""
    of = lambda s: F.max(F.when(F.col("segment") == s, F.col("sharpe")))
    out = metrics.groupBy(*keys).agg(of("validation").alias("validation_sharpe"), of("test").alias("test_sharpe"))
    out = out.withColumn("ratio", F.col("test_sharpe") / F.nullif(F.col("validation_sharpe"), F.lit(0.0)))
    return out.withColumn("warned", F.coalesce(F.col("ratio") < warn, F.lit(False)))
