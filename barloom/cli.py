"""Command line: check bars (quality), test factors of symbols (single), combine them in models (composite), build the portfolio (multi)."""

from __future__ import annotations

import argparse
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .config import Settings, read_settings, universe
from .operators import align, backtest, composite, diagnostics, models, portfolio, predictive, quality, selection
from .plans.factors import build_factors, catalog_frame, names_in_scope
from .session import make_session
from .sources import bars as B
from .sources.sinks import fingerprint, saved, settings_hash, tracked, write_table

SEG = ["symbol", "factor", "segment"]
#: Running figures of backtests go over spans of time, from one to the next.
SPAN = "quarter"


def bars_key(bars: DataFrame) -> list:
    """What identifies a table of bars: its files, and a sum over its rows."""
    return [sorted(bars.columns), B.source_files(bars), list(bars.agg(F.count("*"), F.sum(F.xxhash64(*bars.columns).cast("decimal(38,0)"))).first())]


def factor_values(s: Settings, bars: DataFrame, names: set[str] | None, others: DataFrame | None, macro: DataFrame | None, pruned: set[str]) -> DataFrame:
    """Factors of the bars, with those that need related bars or daily series where these are given."""
    f = s.factors
    pairs = align.align_related(bars, others, align.pairs_of(bars, list(f.related_symbols)), f.related_fill_bars) if others is not None else None
    daily = align.align_macro(bars, macro.where(F.col("symbol").isin(list(f.macro_symbols))), f.macro_lag_days) if macro is not None else None
    return build_factors(bars, names, pairs, daily, f.related_symbols if others is not None else (), f.macro_symbols if macro is not None else (), frozenset(pruned), f.zscore_window, f.block_rows, f.batch)


def single(spark: SparkSession, s: Settings, bars: DataFrame, names: set[str] | None, out: str, others: DataFrame | None = None, macro: DataFrame | None = None, pruned: set[str] = frozenset()) -> DataFrame:
    """Factors, backtests, rank and library of all symbols in one plan.

    others: bars of related symbols. macro: daily series. pruned: factors to leave out. Each table is kept under a
    fingerprint of what it follows from, so a run that was broken off goes on where it stopped.
    """
    key = fingerprint(settings_hash(s.factors), sorted(names) if names is not None else None, sorted(pruned), bars_key(bars), *(bars_key(x) if x is not None else None for x in (others, macro)))
    values = B.cached(spark, f"{out}/factors", lambda: factor_values(s, bars, names, others, macro, pruned), key)
    key = fingerprint(key, settings_hash(s.backtest), settings_hash(s.library))
    ranked = B.cached(spark, f"{out}/single_factor_summary", lambda: _ranked(spark, s, values, bars, names, out), key)
    if s.library.keep_history:
        earlier = f"{out}/summary_history"
        rows = ranked.select(*[c for c in ranked.columns if c != "status"])
        merged = saved(selection.merge_history(spark.read.parquet(earlier), rows, SEG[:2])) if B.exists(spark, f"{earlier}/_SUCCESS") else rows
        write_table(merged, earlier)
    library = B.cached(spark, f"{out}/factor_library", lambda: selection.admit_in_rounds(ranked, values, s.library, s.factors.signal_threshold), key)
    figures = ranked.drop("status").join(library.select("symbol", "factor", "status"), SEG[:2])
    write_table(selection.family_summary(figures), f"{out}/family_summary")
    write_table(selection.active_summary(figures), f"{out}/active_summary")
    write_table(selection.prune_candidates(ranked, library.where("status = 'active'"), s.library), f"{out}/prune_candidates")
    return library


def _ranked(spark: SparkSession, s: Settings, values: DataFrame, bars: DataFrame, names: set[str] | None, out: str) -> DataFrame:
    rows = values.join(B.with_returns(bars), ["symbol", "ts"])
    rows = backtest.segments(rows, s.backtest.train_ratio, s.backtest.validation_ratio, ("symbol", "factor"))
    way = backtest.choose_direction(rows, SEG[:2], s.backtest, s.factors.signal_threshold).select("symbol", "factor", "direction")
    rows = rows.join(way, SEG[:2]).withColumn("value", F.col("value") * F.col("direction"))
    detail = backtest.backtest(backtest.signals(rows, SEG[:2], s.factors.signal_threshold), SEG, s.backtest.cost, SPAN)
    labelled = predictive.qcut_labels(rows, SEG[:2], s.backtest)
    facts = backtest.performance(detail, SEG, s.backtest.annual_days, block=SPAN).join(backtest.coverage(detail, SEG), SEG).join(backtest.monthly_stability(detail, SEG), SEG)
    for more in (predictive.information(predictive.predictive_frame(rows, SEG[:2]), SEG), predictive.monotonicity(predictive.qcut_summary(labelled, SEG, s.backtest.qcut_groups), SEG)):
        facts = facts.join(more, SEG, "left")
    facts = saved(facts)
    write_table(diagnostics.validation_gap(facts.select(*SEG, "sharpe"), SEG[:2]), f"{out}/factor_gap")
    figures = [c for c in facts.columns if c not in SEG]
    cells = [F.max(F.when(F.col("segment") == part, F.col(c))).alias(f"{part}_{c}") for part in ("train", "validation", "test") for c in figures]
    ids = catalog_frame(spark, s.factors.related_symbols, s.factors.macro_symbols, names).select("factor", "factor_id")
    summary = facts.groupBy("symbol", "factor").agg(*cells).join(way, SEG[:2]).join(ids, "factor", "left")
    return selection.rank_summary(summary, s.library.keep).withColumn("reason", selection.reject_reason(s.library))


def features_of(spark: SparkSession, s: Settings, out: str) -> DataFrame:
    """(symbol, factor, slot, way): the factors that models may take, the best by rank first. A symbol's k-th factor is its k-th slot."""
    ranked, m = spark.read.parquet(f"{out}/single_factor_summary"), s.model
    if m.feature_scope == "library":
        some = spark.read.parquet(f"{out}/factor_library").where("status = 'active'").select("symbol", "factor")
    elif m.feature_scope == "best":
        train = ranked.select("symbol", "factor", "factor_id", F.col("train_sharpe").alias("sharpe"), F.col("train_total_return").alias("total_return"))
        some = selection.best_on_training(train, m.best_min_sharpe, m.best_min_return, m.best).select("symbol", "factor")
    elif m.feature_scope in ("all", "selected"):
        some = ranked.select("symbol", "factor")
        some = some.where(F.col("factor").isin(list(m.selected))) if m.feature_scope == "selected" else some
    else:
        raise ValueError("feature_scope is library, best, all or selected")
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("rank", "factor"))
    limit = max(m.best, m.best * max(1, m.candidate_multiplier)) if m.select_in_window else m.best
    chosen = some.join(ranked.select("symbol", "factor", "rank", F.col("direction").alias("way")), ["symbol", "factor"])
    return chosen.withColumn("slot", place).where(F.col("slot") <= limit).drop("rank")


def composed(spark: SparkSession, s: Settings, bars: DataFrame, out: str) -> DataFrame:
    """Rolling models of the chosen factors, their signals and backtests, all symbols in one plan for each kind of model.

    Each refit learns from its own window only: the model, with select_in_window its factors, its thresholds and its
    direction, so no bar's position depends on later bars. The models are compared, segment by segment, with an equal vote
    of the same factors; the first of them trades.
    """
    key, m = ["symbol"], s.model
    if m.feature_mode not in ("signal", "continuous", "both"):
        raise ValueError("feature_mode is signal, continuous or both")
    slots = saved(features_of(spark, s, out))
    values = spark.read.parquet(f"{out}/factors").join(slots, ["symbol", "factor"])
    values = values.withColumn("signal", backtest.threshold_signal(F.col("value") * F.coalesce("way", F.lit(1.0)), s.factors.signal_threshold))
    parts = {"signal": ["signal"], "continuous": ["value"], "both": ["value", "signal"]}[m.feature_mode]
    if m.state_features:
        values = composite.state_features(values, ["symbol", "factor"], s.factors.signal_threshold, signal=F.col("signal"))
        parts = [*parts, "value_diff_1", "value_lag_1", "signal_lag_1", "signal_change_1", "signal_streak"]
    most = slots.agg(F.max("slot").alias("n")).first()["n"] or 0
    columns = dict.fromkeys([*parts, "signal"])
    wide = values.groupBy("symbol", "ts").agg(*[F.max(F.when(F.col("slot") == k, F.col(c))).alias(f"f{k}_{c}") for k in range(1, most + 1) for c in columns])
    factors = {f"f{k}_signal": [f"f{k}_{c}" for c in parts] for k in range(1, most + 1)}
    names = [c for some in factors.values() for c in some]
    rows = composite.market_state(composite.with_labels(B.with_returns(bars), m.horizon, m.neutral_bps), m)
    rows = saved(backtest.segments(rows, s.backtest.train_ratio, s.backtest.validation_ratio))
    features = saved(rows.join(wide, ["symbol", "ts"], "left").select("symbol", "ts", "target_direction", "next_return", "trade_allowed", *dict.fromkeys([*names, *factors])))
    stamp = fingerprint(settings_hash(m), settings_hash(s.backtest), names, list(features.agg(F.count("*"), F.sum(F.xxhash64(*features.columns).cast("decimal(38,0)"))).first()))
    told: dict[str, DataFrame] = {}
    for kind in m.kinds:
        chances = B.cached(spark, f"{out}/predictions/{kind}", lambda kind=kind: models.rolling_predictions(features, names, m, importance=True, kind=kind, factors=factors, calibrate=True), stamp)
        told[kind] = traded(s, rows, chances)
    first = m.kinds[0]
    write_table(backtest.backtest(told[first], key, s.backtest.cost), f"{out}/composite_detail")
    chances = spark.read.parquet(f"{out}/predictions/{first}")
    compared(s, rows, told, chances, out)
    place = spark.createDataFrame([(i, k) for i, (k, _) in enumerate((k, c) for k in range(1, most + 1) for c in parts)], "at int, slot int")  # a row for each feature
    weights = chances.where("importance IS NOT NULL").select("symbol", "ts", F.posexplode("importance").alias("at", "importance")).join(place, "at")
    weights = weights.groupBy("symbol", "ts", "slot").agg(F.sum("importance").alias("importance")).groupBy("symbol", "slot").agg(F.avg("importance").alias("importance"))
    weights = weights.join(slots.select("symbol", "slot", F.col("factor").alias("feature")), ["symbol", "slot"])
    write_table(weights.select("symbol", "feature", "importance"), f"{out}/feature_importance")
    write_table(diagnostics.importance_share(weights, key), f"{out}/factor_contribution")
    if m.select_in_window:
        picked = chances.where("selected IS NOT NULL").select("symbol", "ts", F.posexplode("selected").alias("place", "name"))
        picked = picked.select("symbol", "ts", (F.col("place") + 1).alias("place"), F.regexp_extract("name", r"f(\d+)_", 1).cast("int").alias("slot")).join(slots.select("symbol", "slot", "factor"), ["symbol", "slot"])
        write_table(picked.select("symbol", "ts", "place", "factor"), f"{out}/window_selection")
    detail = spark.read.parquet(f"{out}/composite_detail")
    write_table(diagnostics.robustness(detail, ["symbol"], s.backtest.annual_days), f"{out}/robustness")
    write_table(backtest.cost_stress(detail, ["symbol"], s.backtest.cost_stress_bps, s.backtest.annual_days), f"{out}/cost_stress")
    return detail


def traded(s: Settings, rows: DataFrame, chances: DataFrame) -> DataFrame:
    """A model's signal and positions, by the thresholds and the direction that came with its predictions."""
    told = chances.select("symbol", "ts", "prob_down", "prob_flat", "prob_up", "min_edge", "min_probability", F.coalesce("direction", F.lit(1.0)).alias("direction"))
    rows = rows.join(told, ["symbol", "ts"], "left").withColumn("edge", (F.col("prob_up") - F.col("prob_down")) * F.col("direction"))
    return composite.composite_signal(composite.confidence_rank(rows, s.model), ["symbol"], s.model, s.factors.block_rows)


def compared(s: Settings, rows: DataFrame, told: dict[str, DataFrame], chances: DataFrame, out: str) -> None:
    """Tables of the models against the vote by segment, of the gap between validation and test, and of the predictions."""
    score, least = F.col("vote_score"), s.model.vote_least
    vote = rows.join(chances.select("symbol", "ts", "vote_score"), ["symbol", "ts"], "left").withColumn("raw_signal", F.when(score > least, 1.0).when(score < -least, -1.0).otherwise(0.0)).withColumn("composite_score", F.coalesce(score, F.lit(0.0)))
    vote = vote.withColumn("position", F.lag("raw_signal", 1, 0.0).over(Window.partitionBy("symbol").orderBy("ts")))
    columns = ["symbol", "segment", "ts", "close", "oc", "raw_signal", "position", "composite_score"]
    named = {f"rolling_{kind}": signal for kind, signal in told.items()} | {"equal_vote_benchmark": vote}
    both = saved(reduce(DataFrame.unionByName, [signal.select(*columns, F.lit(name).alias("model")) for name, signal in named.items()]))
    keys = ["symbol", "model", "segment"]
    figures = saved(backtest.performance(backtest.backtest(both, keys, s.backtest.cost), keys, s.backtest.annual_days))
    write_table(backtest.with_status(figures, both, keys), f"{out}/model_comparison")
    write_table(diagnostics.validation_gap(figures, keys[:2]), f"{out}/model_gap")
    first = told[s.model.kinds[0]].withColumn("predicted_direction", composite.likeliest()).withColumn("calibrated_direction", F.col("predicted_direction") * F.col("direction"))
    for name, report in (("prediction_diagnostics", diagnostics.prediction_diagnostics), ("confusion_matrix", diagnostics.confusion_matrix), ("edge_buckets", diagnostics.edge_buckets)):
        write_table(report(first, ["symbol"]), f"{out}/{name}")


def quality_tables(spark: SparkSession, s: Settings, bars: DataFrame, out: str, others: DataFrame | None = None, macro: DataFrame | None = None) -> DataFrame:
    """Reports of the bars, of related bars and how they cover the main ones, and of the daily series; bars of another length are an error."""
    reports = [quality.quality_report(B.check_bar_size(bars, s.bar_minutes), "main", s.bar_minutes)]
    if others is not None:
        reports.append(quality.quality_report(others.where(F.col("symbol").isin(list(s.factors.related_symbols))), "related", s.bar_minutes))
        write_table(align.related_coverage(bars, others, align.pairs_of(bars, list(s.factors.related_symbols)), s.factors.related_fill_bars), f"{out}/related_coverage")
    if macro is not None:
        reports.append(quality.macro_quality(macro.where(F.col("symbol").isin(list(s.factors.macro_symbols)))))
    write_table(reduce(DataFrame.unionByName, reports), f"{out}/data_quality")
    return spark.read.parquet(f"{out}/data_quality")


def multi(spark: SparkSession, s: Settings, out: str) -> DataFrame:
    """The portfolio of all symbols' composite strategies; sectors share at most sector_cap where that is set."""
    detail = spark.read.parquet(f"{out}/composite_detail").withColumn("strategy_return", F.col("net_return"))
    sectors = spark.createDataFrame(sorted(s.portfolio.sectors.items()), "symbol string, sector string") if s.portfolio.sector_cap is not None else None
    result, weights = portfolio.portfolio(detail, s.portfolio, sectors=sectors)
    write_table(weights, f"{out}/portfolio_weights")
    write_table(result, f"{out}/portfolio")
    result = spark.read.parquet(f"{out}/portfolio")
    write_table(portfolio.portfolio_metrics(result), f"{out}/portfolio_metrics")
    write_table(portfolio.contributions(spark.read.parquet(f"{out}/portfolio_weights"), result), f"{out}/contributions")
    return result


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="barloom")
    p.add_argument("verb", choices=("quality", "single", "composite", "multi"))
    p.add_argument("--bars", required=True, help="Parquet table of bars, partitioned by symbol; or CSV files {symbol}_{minutes}min_data.csv (a name with * or .csv)")
    p.add_argument("--macro", help="Parquet table of daily series: symbol, date, close")
    p.add_argument("--out", required=True)
    p.add_argument("--settings", help="JSON file")
    p.add_argument("--symbols", help="comma-separated, or liquid_commodity")
    p.add_argument("--factors", help="comma-separated names; scope: those of the settings' scope; default: the basic ones", default="momentum,reversal,breakout,volume_confirm")
    p.add_argument("--related", action="store_true", help="use the settings' related symbols from the same table of bars")
    p.add_argument("--prune", help="table or CSV with a column `factor` of factors to leave out")
    p.add_argument("--start")
    p.add_argument("--end")
    return p


def prune_list(spark: SparkSession, path: str | None) -> set[str]:
    """Names in a column `factor`; at most as many as the catalogue has."""
    if path is None:
        return set()
    table = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    return {r["factor"] for r in table.select("factor").distinct().collect()}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    s = read_settings(args.settings) if args.settings else Settings()
    s = replace(s, **{k: v for k, v in {"symbols": tuple(universe(args.symbols)) if args.symbols else None, "start": args.start, "end": args.end}.items() if v is not None})
    spark = make_session()

    def read(symbols: tuple[str, ...]) -> DataFrame:
        if "*" in args.bars or args.bars.endswith(".csv"):
            return B.time_range(B.read_bars_csv(spark, [args.bars]), s.start, s.end).where(F.col("symbol").isin(list(symbols)))
        return B.read_bars(spark, args.bars, list(symbols), s.start, s.end)

    bars = read(s.symbols)
    others = read(s.factors.related_symbols) if args.related else None
    macro = spark.read.schema(B.MACRO_SCHEMA).parquet(args.macro) if args.macro else None

    def run_single() -> DataFrame:
        f = s.factors
        names = names_in_scope(f.related_symbols, f.macro_symbols, f.scope, f.new_from, f.selected) if args.factors == "scope" else set(args.factors.split(","))
        return single(spark, s, bars, names, args.out, others, macro, prune_list(spark, args.prune))

    work = {"quality": lambda: quality_tables(spark, s, bars, args.out, others, macro), "single": run_single, "composite": lambda: composed(spark, s, bars, args.out), "multi": lambda: multi(spark, s, args.out)}
    tracked(args.verb, s, args.out, work[args.verb])


if __name__ == "__main__":
    main()
