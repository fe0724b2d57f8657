"""Ranking factors, admitting them to the library, pruning them across symbols."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LibrarySettings
from ..functions import names
from ..sources.sinks import saved, scratch
from .backtest import threshold_signal
from .pairs import SPAN, columns_of, correlation, correlations, moments, packed, types, unpacked

ORDER = ("selection_valid", "selection_sharpe", "selection_rank_ic", "selection_monotonicity", "selection_return")


def rank_summary(summary: DataFrame, keep: int = 200, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """summary with the weaker of train and validation figures, rank and status: the best `keep` of a symbol are active.

    least() skips a missing side. Equal factors keep the order of their number.
    """
    weaker = lambda c: F.least(f"train_{c}", f"validation_{c}")
    out = summary.withColumns({
        "selection_sharpe": weaker("sharpe"), "selection_return": weaker("total_return"), "selection_rank_ic": weaker("rank_ic"), "selection_monotonicity": weaker("monotonicity"),
    })
    out = out.withColumn("family", names.family(F.col("factor"))).withColumn("selection_valid", F.col("selection_sharpe").isNotNull() & F.col("selection_return").isNotNull())
    order = [F.col(c).desc_nulls_last() for c in ORDER]
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order, "factor_id")))
    return out.withColumn("status", F.when(F.col("rank") <= max(1, keep), "active").otherwise("rejected"))


def merge_history(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All records, new ones in place of old ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new")))
    return both.withColumn("_row", last).where("_row = 1").drop("_row", "_new")


def reject_reason(s: LibrarySettings, available: Column | None = None) -> Column:
    """The first gate that a ranked factor fails, in order; NULL if none. Missing figures pass, as far as they have a default."""
    c = F.col
    worse = lambda column, least: F.coalesce(c(column) < F.lit(float(least)), F.lit(False))
    gates = [
        ("factor_not_available", ~(available if available is not None else F.lit(True))),
        ("invalid_score", ~c("selection_valid")),
        ("low_selection_sharpe", worse("selection_sharpe", s.min_sharpe)),
        ("low_selection_total_return", worse("selection_return", s.min_total_return)),
        ("low_train_sharpe", worse("train_sharpe", s.min_train_sharpe)),
        ("low_train_total_return", worse("train_total_return", s.min_train_total_return)),
        ("low_train_win_rate", F.coalesce(c("train_win_rate") <= s.min_train_win_rate, F.lit(False))),
        ("low_selection_win_rate", F.coalesce(c("validation_win_rate") <= s.min_selection_win_rate, F.lit(False))),
    ]
    if s.min_selection_rank_ic is not None:
        gates.append(("low_selection_rank_ic", worse("selection_rank_ic", s.min_selection_rank_ic)))
    if s.min_selection_monotonicity is not None:
        gates.append(("low_selection_monotonicity", worse("selection_monotonicity", s.min_selection_monotonicity)))
    gates += [
        ("low_selection_trade_count", worse("validation_trade_count", s.min_selection_trades)),
        ("low_train_trade_count", worse("train_trade_count", s.min_train_trades)),
        ("low_selection_signal_coverage", worse("validation_signal_coverage", s.min_selection_signal_coverage)),
        ("low_train_signal_coverage", worse("train_signal_coverage", s.min_train_signal_coverage)),
    ]
    if s.max_selection_drawdown is not None:
        gates.append(("high_selection_drawdown", worse("validation_max_drawdown", s.max_selection_drawdown)))
    if s.max_train_drawdown is not None:
        gates.append(("high_train_drawdown", worse("train_max_drawdown", s.max_train_drawdown)))
    out = F.lit(None).cast("string")
    for reason, failed in reversed(gates):
        out = F.when(failed, reason).otherwise(out)
    return out


def library_correlations(values: DataFrame, keys: list[str], threshold: float = 0.7) -> DataFrame:
    """(keys, factor_a, factor_b, value_corr, signal_corr): absolute correlations of values and of their signals."""
    one = correlations(values, keys).withColumn("value_corr", F.abs("corr")).drop("corr")
    signal = values.withColumn("signal", threshold_signal(F.col("value"), threshold))
    two = correlations(signal, keys, "signal").withColumn("signal_corr", F.abs("corr")).drop("corr")
    return one.join(two, [*keys, "factor_a", "factor_b"], "full")


def admit(ranked: DataFrame, pairs: DataFrame, s: LibrarySettings = LibrarySettings()) -> DataFrame:
    """Greedy admission in rank order, symbol by symbol: family quotas, the library's size, correlation with those admitted.

    ranked: symbol, factor, family, rank, reason (NULL: passed the gates). One symbol's candidates are a group: its
    factors, not its bars. Only pairs of candidates that passed are looked at.
    """
    passed = ranked.where("reason IS NULL").select("symbol", F.col("factor").alias("factor_a"))
    near = pairs.join(passed, ["symbol", "factor_a"], "left_semi").join(passed.withColumnRenamed("factor_a", "factor_b"), ["symbol", "factor_b"], "left_semi")
    near = near.select("symbol", "factor_a", "factor_b", "value_corr", "signal_corr")
    schema = "symbol string, factor string, status string, reason string, family_count int, max_value_corr double, max_signal_corr double, max_library_corr double"

    def greedy(candidates: pd.DataFrame, corr: pd.DataFrame) -> pd.DataFrame:
        of: dict[str, list[tuple[str, float, float]]] = {}
        for a, b, v, g in zip(corr["factor_a"], corr["factor_b"], corr["value_corr"], corr["signal_corr"], strict=True):
            of.setdefault(a, []).append((b, v, g))
            of.setdefault(b, []).append((a, v, g))
        chosen, families, out = set(), {}, []
        for row in candidates.sort_values("rank").itertuples():
            reason, count, quota = row.reason, families.get(row.family, 0), s.family_quota.get(row.family)
            status, most = "rejected", [None, None, None]
            if reason is None or reason != reason:
                reason = None
                if quota is not None and count >= quota:
                    status, reason = "retired", "family_quota_exceeded"
                elif len(chosen) >= max(1, s.keep):
                    status, reason = "retired", "rank_outside_top_n"
                else:
                    near = [(v, g) for other, v, g in of.get(row.factor, ()) if other in chosen]
                    most = [max((x[i] for x in near if x[i] is not None and x[i] == x[i]), default=None) for i in (0, 1)]
                    most.append(max((x for x in most if x is not None), default=None))
                    if most[2] is not None and most[2] >= s.max_corr:
                        reason = "high_corr"
                    else:
                        status = "active"
                        chosen.add(row.factor)
                        families[row.family] = count + 1
            out.append((row.symbol, row.factor, status, reason, families.get(row.family, 0), *most))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    want = ranked.select("symbol", "factor", "family", "rank", "reason")
    return want.groupBy("symbol").cogroup(near.groupBy("symbol")).applyInPandas(greedy, schema)


DECIDED = "symbol string, factor string, family string, rank int, status string, reason string, max_value_corr double, max_signal_corr double, max_library_corr double, slot int"


def admit_in_rounds(ranked: DataFrame, values: DataFrame, s: LibrarySettings = LibrarySettings(), threshold: float = 0.7, lot: int = 128) -> DataFrame:
    """admit() for any number of candidates: their values, not all pairs, come in.

    Those that passed the gates are dealt to lots by rank; a round takes every symbol's next lot and multiplies it with
    itself and with what is admitted so far (at most `keep`), span by span of time, for values and signals at once. A task
    holds the bars of one span for lot + keep factors, or a symbol's sums of that size; each lot's values are written and
    read once. Symbols whose library is full take no part in later rounds. The driver sees one number a symbol.
    """
    spark, keep = ranked.sparkSession, max(1, s.keep)
    want = saved(ranked.select("symbol", "factor", "family", F.col("rank").cast("int").alias("rank"), "reason"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("rank", "factor")) - 1
    passed = saved(want.where("reason IS NULL").drop("reason").withColumn("_p", place).selectExpr("*", f"CAST(_p DIV {lot} AS INT) lot", f"CAST(_p % {lot} AS INT) col").drop("_p"))
    folder = scratch(spark)
    rows = values.join(passed.select("symbol", "factor", "lot", "col"), ["symbol", "factor"])
    rows = rows.select("symbol", "factor", "ts", "value", "col", "lot")
    rows.repartition("lot", "symbol", "factor").write.partitionBy("lot").parquet(f"{folder}/values")
    pool = spark.read.schema(rows.schema).parquet(f"{folder}/values")  # there may be no candidates, and no files
    sizes = {r["symbol"]: r["lots"] for r in passed.groupBy("symbol").agg((F.max("lot") + 1).alias("lots")).collect()}  # one row a symbol
    held: dict[str, int] = {}
    rounds: list[DataFrame] = []
    for k in range(max(sizes.values(), default=0)):
        open_ = [x for x, lots in sizes.items() if lots > k and held.get(x, 0) < keep]
        if not open_:
            break
        mine = passed.where((F.col("lot") == k) & F.col("symbol").isin(open_))
        new = pool.where((F.col("lot") == k) & F.col("symbol").isin(open_)).select("symbol", "ts", "value", "col", F.lit(True).alias("new"))
        chosen = rounds and [r.where("status = 'active'").select("symbol", "factor", "family", "slot") for r in rounds]
        if any(held.values()):
            old = spark.read.parquet(f"{folder}/chosen").where(F.col("symbol").isin(open_)).select("symbol", "ts", "value", F.col("slot").alias("col"), F.lit(False).alias("new"))
            new = new.unionByName(old)
        families = _all(chosen).groupBy("symbol", "family").agg(F.count("*").cast("int").alias("had")) if chosen else None
        mine = mine.join(families, ["symbol", "family"], "left") if chosen else mine.withColumn("had", F.lit(0))
        sums = _lot_sums(new, lot, max(held.values(), default=0), threshold)
        before = F.create_map(*[F.lit(x) for pair in held.items() for x in pair])[F.col("symbol")] if held else F.lit(0)
        mine = mine.withColumn("held", F.coalesce(before, F.lit(0)).cast("int")).withColumn("had", F.coalesce("had", F.lit(0)))
        decided = saved(mine.groupBy("symbol").cogroup(sums.groupBy("symbol")).applyInArrow(_greedy(s, lot), DECIDED))
        active = decided.where("status = 'active'").select("symbol", "factor", "slot")
        pool.where(F.col("lot") == k).join(active, ["symbol", "factor"]).select("symbol", "ts", "value", "slot").write.mode("append").parquet(f"{folder}/chosen")
        held |= {r["symbol"]: r["n"] for r in active.groupBy("symbol").agg((F.max("slot") + 1).alias("n")).collect()}  # one row a symbol
        rounds.append(decided)
    seen = _all(rounds).drop("slot") if rounds else spark.createDataFrame([], DECIDED).drop("slot")
    # what is left: gates not passed, or a full library
    rest = want.join(seen.select("symbol", "factor"), ["symbol", "factor"], "left_anti")
    late = F.col("reason").isNull()
    full = seen.where("status = 'active'").groupBy("symbol", "family").agg(F.count("*").alias("had"))
    quota = F.create_map(*[F.lit(x) for pair in s.family_quota.items() for x in pair])[F.col("family")] if s.family_quota else F.lit(None).cast("int")
    rest = rest.join(full, ["symbol", "family"], "left").withColumn("why", F.when(F.coalesce("had", F.lit(0)) >= quota, "family_quota_exceeded").otherwise("rank_outside_top_n"))
    none = F.lit(None).cast("double")
    rest = rest.select("symbol", "factor", "family", "rank", F.when(late, "retired").otherwise("rejected").alias("status"), F.when(late, F.col("why")).otherwise(F.col("reason")).alias("reason"), *[none.alias(c) for c in ("max_value_corr", "max_signal_corr", "max_library_corr")])
    every = seen.unionByName(rest)
    earlier = Window.partitionBy("symbol", "family").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("family_count", F.count_if(F.col("status") == "active").over(earlier).cast("int"))
    return every.select("symbol", "factor", "status", "reason", "family_count", "max_value_corr", "max_signal_corr", "max_library_corr")


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _lot_sums(rows: DataFrame, lot: int, held: int, threshold: float) -> DataFrame:
    """(symbol, sums): moments of a lot's values and signals with those of the lot and of what is admitted. rows: symbol, ts, value, col, new."""
    rows = rows.withColumn("span", F.date_trunc(SPAN, F.col("ts").cast("timestamp"))).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))

    def products(part: pa.Table) -> pa.Table:
        col = part["col"].to_numpy() + np.where(part["new"].to_numpy(), 0, lot)
        _, x = columns_of(part["at"].to_numpy(), col, part["value"].cast(pa.float64()).to_numpy(), lot + held)
        _, there = columns_of(part["at"].to_numpy(), col, np.ones(len(part)), lot + held)
        signal = np.where(np.isnan(there), np.nan, np.where(x > threshold, 1.0, np.where(x < -threshold, -1.0, 0.0)))  # a bar without value has no signal: 0
        data = np.stack([moments(x[:, :lot], x), moments(signal[:, :lot], signal)])
        return part.select(["symbol", "span"]).slice(0, 1).append_column("sums", pa.array([packed(data)], pa.binary()))

    def add(part: pa.Table) -> pa.Table:
        total = 0.0
        for x in part["sums"]:
            total = total + unpacked(x.as_py())
        return part.select(["symbol"]).slice(0, 1).append_column("sums", pa.array([packed(total)], pa.binary()))

    parts = rows.select("symbol", "span", "at", "value", "col", "new").groupBy("symbol", "span").applyInArrow(products, f"{types(rows, ['symbol', 'span'])}, sums binary")
    for by in ([F.year("span").alias("part")], []):  # years, then all
        parts = parts.select("symbol", *by, "sums", *(["span"] if by else [])).groupBy("symbol", *(["part"] if by else [])).applyInArrow(lambda t: add(t), "symbol string, sums binary")
    return parts


def _greedy(s: LibrarySettings, lot: int):
    def run(candidates: pa.Table, sums: pa.Table) -> pa.Table:
        """A symbol's lot in rank order against what is admitted, and what this lot admits."""
        rows = sorted(candidates.to_pylist(), key=lambda r: r["col"])
        if sums.num_rows:
            t = unpacked(sums["sums"][0].as_py()).reshape(2, 6, lot, -1)
            both = [np.abs(correlation(x)) for x in t]
        else:  # no values at all
            both = [np.full((lot, lot), np.nan)] * 2
        held = rows[0]["held"] if rows else 0
        chosen, more, out = [lot + i for i in range(held)], {}, []
        for r in rows:
            count, quota = r["had"] + more.get(r["family"], 0), s.family_quota.get(r["family"])
            status, reason, most, slot = "retired", None, [None, None, None], None
            if quota is not None and count >= quota:
                reason = "family_quota_exceeded"
            elif len(chosen) >= max(1, s.keep):
                reason = "rank_outside_top_n"
            else:
                near = [c[r["col"], [i for i in chosen if i < c.shape[1]]] for c in both]
                near = [x[~np.isnan(x)] for x in near]
                most = [float(x.max()) if len(x) else None for x in near]
                most.append(max((x for x in most if x is not None), default=None))
                if most[2] is not None and most[2] >= s.max_corr:
                    status, reason = "rejected", "high_corr"
                else:
                    status, slot = "active", len(chosen)
                    chosen.append(r["col"])
                    more[r["family"]] = more.get(r["family"], 0) + 1
            out.append((r["symbol"], r["factor"], r["family"], r["rank"], status, reason, *most, slot))
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
        fields = [c.split() for c in DECIDED.split(", ")]
        return pa.table({name: pa.array([o[i] for o in out], kinds[kind]) for i, (name, kind) in enumerate(fields)})

    return run


def family_summary(library: DataFrame) -> DataFrame:
    return library.groupBy("symbol", "family").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("active"), F.avg("selection_sharpe").alias("mean_selection_sharpe"), F.max("selection_sharpe").alias("max_selection_sharpe"),
    )


def active_summary(library: DataFrame) -> DataFrame:
    """(symbol, active_factors, mean_active_sharpe, max_active_sharpe) of every symbol; validation figures where no active factor has a selection figure. library: status, selection_sharpe, validation_sharpe."""
    active = F.col("status") == "active"
    figure = lambda f: F.coalesce(f(F.when(active, F.col("selection_sharpe"))), f(F.when(active, F.col("validation_sharpe"))))
    return library.groupBy("symbol").agg(F.count_if(active).alias("active_factors"), figure(F.avg).alias("mean_active_sharpe"), figure(F.max).alias("max_active_sharpe"))


def prune_candidates(summary: DataFrame, active: DataFrame, s: LibrarySettings = LibrarySettings()) -> DataFrame:
    """Factors tested on enough symbols that show promise on none and are active nowhere. summary: symbol, factor, selection_sharpe, selection_return."""
    tested = summary.groupBy("factor").agg(
        F.countDistinct("symbol").alias("tested_symbols"), F.max("selection_sharpe").alias("best_sharpe"), F.max("selection_return").alias("best_return"), F.array_sort(F.collect_set("symbol")).alias("symbols"),
    )
    used = active.groupBy("factor").agg(F.countDistinct("symbol").alias("active_symbols"))
    out = tested.join(used, "factor", "left").withColumn("active_symbols", F.coalesce("active_symbols", F.lit(0)))
    promise = F.coalesce(F.col("best_sharpe") >= s.prune_keep_sharpe, F.lit(False)) | F.coalesce(F.col("best_return") >= s.prune_keep_return, F.lit(False))
    kept = F.lit(s.prune_keep_active) & (F.col("active_symbols") > 0)
    out = out.where((F.col("tested_symbols") >= s.prune_min_symbols) & ~kept & ~promise)
    return out.withColumn("symbols", F.array_join("symbols", ","))


def best_on_training(train: DataFrame, min_sharpe: float = 1.0, min_return: float = 0.0, best: int = 50) -> DataFrame:
    """The best factors of each symbol by training figures. train: symbol, factor, factor_id, sharpe, total_return."""
    good = train.where((F.col("sharpe") >= min_sharpe) & (F.col("total_return") >= min_return))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("sharpe"), F.desc("total_return"), "factor_id"))
    return good.withColumn("place", place).where(F.col("place") <= best)


def target_correlation(values: DataFrame, target: str = "target") -> DataFrame:
    """(symbol, factor, corr, n): correlation of each factor with the target where both are present."""
    both = values.where(F.col("value").isNotNull() & F.col(target).isNotNull())
    spread = F.stddev_samp("value") * F.stddev_samp(target)
    return both.groupBy("symbol", "factor").agg((F.covar_samp("value", target) / F.nullif(spread, F.lit(0.0))).alias("corr"), F.count("*").alias("n"))


def select_in_window(values: DataFrame, best: int = 50, multiplier: int = 5, max_corr: float = 0.85, least: int = 600) -> DataFrame:
    """(symbol, factor, place): factors by absolute correlation with the target, each little correlated with those before. values: target."""
    target = target_correlation(values).where((F.col("n") >= least) & F.col("corr").isNotNull())
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(F.abs("corr")), "factor"))
    top = target.withColumn("place", place).where(F.col("place") <= max(best, best * multiplier)).select("symbol", "factor", "place")
    pairs = correlations(values.join(top, ["symbol", "factor"], "left_semi"), ["symbol"]).where(F.abs("corr") >= max_corr)

    def greedy(candidates: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        clash: dict[str, set[str]] = {}
        for a, b in zip(near["factor_a"], near["factor_b"], strict=True):
            clash.setdefault(a, set()).add(b)
            clash.setdefault(b, set()).add(a)
        chosen: list[tuple[str, str, int]] = []
        for row in candidates.sort_values("place").itertuples():
            if len(chosen) < best and not clash.get(row.factor, set()) & {f for _, f, _ in chosen}:
                chosen.append((row.symbol, row.factor, row.place))
        return pd.DataFrame(chosen, columns=["symbol", "factor", "place"])

    return top.groupBy("symbol").cogroup(pairs.groupBy("symbol")).applyInPandas(greedy, "symbol string, factor string, place int")
