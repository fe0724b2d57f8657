"""From class probabilities to positions: labels, filters, thresholds, sizes, position rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..config import ModelSettings
from ..functions.frames import Frames, absolute, in_blocks, nz, term
from ..sources.sinks import saved
from .backtest import threshold_signal

# labels and features


def with_labels(bars: DataFrame, horizon: int = 1, neutral_bps: float | None = 3.0, cost_bps: float = 0.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """bars with future_return (next open to the close `horizon` bars on), next_return, and target_direction: its sign beyond the neutral zone."""
    w = Window.partitionBy(*keys).orderBy("ts")
    ahead = F.lead("close", max(1, horizon)).over(w) / F.nullif(F.lead("open", 1).over(w), F.lit(0.0)) - 1
    limit = max(0.0, cost_bps if neutral_bps is None else neutral_bps) / 10000
    direction = F.when(F.col("future_return").isNull(), None).when(F.col("future_return") > limit, 1.0).when(F.col("future_return") < -limit, -1.0).otherwise(0.0)
    return bars.withColumn("future_return", ahead).withColumn("next_return", F.lead("oc", 1).over(w)).withColumn("target_direction", direction)


def sample_weight(target: Column, directional: float = 1.5, neutral: float = 0.8) -> Column:
    return F.when(target.isNull(), 0.0).when(target == 0, neutral).otherwise(directional)


def streak(signals: DataFrame, keys: list[str], signal: str = "signal") -> DataFrame:
    """signals with signal_streak: how many bars in a row have had this signal; 0 without one."""
    w = Window.partitionBy(*keys).orderBy("ts")
    clean = F.coalesce(signal, F.lit(0.0))
    new = F.coalesce((clean != F.lag(clean).over(w)).cast("int"), F.lit(1))
    out = signals.withColumn("_new", new)
    out = out.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*keys, "_island").orderBy("ts"))
    return out.withColumn("signal_streak", F.when(clean != 0, place.cast("double")).otherwise(0.0)).drop("_new", "_island")


def state_features(values: DataFrame, keys: list[str], threshold: float = 0.7, signal: Column | None = None) -> DataFrame:
    """values with the factor's signal and how both change: value_diff_1, value_lag_1, signal_lag_1, signal_change_1, signal_streak."""
    w = Window.partitionBy(*keys).orderBy("ts")
    out = values.withColumn("signal", signal if signal is not None else threshold_signal(F.col("value"), threshold))
    out = out.withColumns({
        "value_diff_1": F.col("value") - F.lag("value").over(w), "value_lag_1": F.lag("value").over(w),
        "signal_lag_1": F.lag("signal").over(w), "signal_change_1": F.col("signal") - F.lag("signal").over(w),
    })
    return streak(out, keys)


def feature_matrix(values: DataFrame, factors: list[str], mode: str = "both", threshold: float = 0.7) -> DataFrame:
    """(symbol, ts, a column for each factor's value and signal): the listed factors only, so the pivot needs no pass of its own."""
    if mode not in ("signal", "continuous", "both"):
        raise ValueError("mode is signal, continuous or both")
    rows = values.where(F.col("factor").isin(factors)).withColumn("signal", threshold_signal(F.col("value"), threshold))
    parts = []
    for f in factors:
        at = F.when(F.col("factor") == f, F.col("value")), F.when(F.col("factor") == f, F.col("signal"))
        if mode != "signal":
            parts.append(F.max(at[0]).alias(f"{f}_value" if mode == "both" else f))
        if mode != "continuous":
            parts.append(F.max(at[1]).alias(f"{f}_signal" if mode == "both" else f))
    return rows.groupBy("symbol", "ts").agg(*parts)


def vote(signals: DataFrame, least: float = 0.0, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """(keys, vote_score, vote_signal): the mean of all factors' signals, and its sign beyond `least`."""
    mean = signals.groupBy(*keys).agg(F.avg("signal").alias("vote_score"))
    s = F.col("vote_score")
    return mean.withColumn("vote_signal", F.when(s.isNull(), None).when(s > least, 1.0).when(s < -least, -1.0).otherwise(0.0))


def signal_direction(rows: DataFrame, keys: list[str], signal: str = "raw_signal", ahead: str = "next_return") -> DataFrame:
    """(keys, direction): -1 if the signals would have earned more the other way round, else 1."""
    both = rows.where(F.col(signal).isNotNull() & F.col(ahead).isNotNull())
    return both.groupBy(*keys).agg(F.when(F.sum(F.col(signal) * F.col(ahead)) < 0, -1.0).otherwise(1.0).alias("direction"))


# filters


def market_state(bars: DataFrame, settings: ModelSettings = ModelSettings(), keys: tuple[str, ...] = ("symbol",), liquidity: str = "amt") -> DataFrame:
    """bars with volatility_rank, liquidity_rank (moving ranks) and trade_allowed."""
    frames, w = Frames(keys), max(20, settings.filter_window)
    least = max(20, w // 3)
    ranks = {"volatility_rank": frames.rank(absolute("oc"), w, least), "liquidity_rank": frames.rank(absolute(nz(liquidity)), w, least)}
    out = frames.apply(bars, ranks, bars.columns)
    allowed = F.col("oc").isNotNull()
    for rank, low in (("volatility_rank", settings.min_volatility_rank), ("liquidity_rank", settings.min_liquidity_rank)):
        if low > 0:
            allowed = allowed & (F.coalesce(rank, F.lit(0.0)) >= min(1.0, low))
    return out.withColumn("trade_allowed", allowed.cast("double"))


def confidence_rank(rows: DataFrame, settings: ModelSettings = ModelSettings(), keys: tuple[str, ...] = ("symbol",), score: str = "edge") -> DataFrame:
    """rows with confidence_rank (moving rank of the absolute score) and confidence_trade_allowed."""
    frames, w = Frames(keys), max(20, settings.confidence_window)
    out = frames.apply(rows, {"confidence_rank": frames.rank(absolute(term(score)), w, max(20, w // 3))}, rows.columns)
    allowed = F.col(score).isNotNull()
    if settings.min_confidence_rank > 0:
        allowed = allowed & (F.coalesce("confidence_rank", F.lit(0.0)) >= min(1.0, settings.min_confidence_rank))
    return out.withColumn("confidence_trade_allowed", allowed.cast("double"))


# probabilities


def _unknown() -> Column:
    return F.col("prob_up").isNull() | F.col("prob_down").isNull()


def trade_signal(min_edge: Column, min_probability: Column) -> Column:
    """1, -1 or 0 from prob_up and prob_down: edge and the larger probability reach their thresholds; NULL if one is missing."""
    edge, most = F.col("prob_up") - F.col("prob_down"), F.greatest("prob_up", "prob_down")
    sure = most >= min_probability
    return F.when(_unknown(), None).when((edge >= min_edge) & sure, 1.0).when((edge <= -min_edge) & sure, -1.0).otherwise(0.0)


def position_size(min_edge: Column, min_probability: Column, s: ModelSettings = ModelSettings()) -> Column:
    """How much to hold: full if confidence is above 0, or growing with it; confidence is the larger share of edge or probability above its threshold."""
    share = lambda x, low: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / F.greatest(1 - low, F.lit(1e-9))))
    confidence = F.greatest(share(F.abs(F.col("prob_up") - F.col("prob_down")), min_edge), share(F.greatest("prob_up", "prob_down"), min_probability))
    if s.dynamic_size:
        low = min(s.size_max, max(0.0, s.size_min))
        size = F.when(confidence > 0, low + (s.size_max - low) * F.pow(confidence, F.lit(max(0.25, s.size_power)))).otherwise(0.0)
    else:
        size = F.when(confidence > 0, s.size_max).otherwise(0.0)
    return F.when(_unknown(), None).otherwise(size)


def likeliest() -> Column:
    """1, -1 or 0: the class of the largest probability, up before down before flat; NULL without probabilities."""
    up, down, flat = F.col("prob_up"), F.col("prob_down"), F.col("prob_flat")
    return F.when(up.isNull(), None).when((up >= flat) & (up >= down), 1.0).when(down >= flat, -1.0).otherwise(0.0)


def threshold_grid(s: ModelSettings) -> list[tuple[float, float]]:
    edges = sorted({s.min_edge, *(max(s.min_edge, x) for x in s.edge_grid)})
    chances = sorted({s.min_probability, *(max(s.min_probability, x) for x in s.probability_grid)})
    return [(e, p) for e in edges for p in chances]


def calibrated_thresholds(rows: DataFrame, keys: list[str], s: ModelSettings = ModelSettings(), ahead: str = "next_return", allowed: str = "trade_allowed") -> DataFrame:
    """(keys, min_edge, min_probability): the pair with the best mean over deviation of returns, of enough trades; the first of equals, else the base pair."""
    grid = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(p).alias("p")) for e, p in threshold_grid(s)])
    each = rows.withColumn("g", F.explode(grid)).withColumn("e", F.col("g.e")).withColumn("p", F.col("g.p"))
    signal = F.when(F.coalesce(F.col(allowed) > 0, F.lit(False)), trade_signal(F.col("e"), F.col("p"))).otherwise(0.0)
    each = each.withColumn("_s", signal).withColumn("_r", F.col("_s") * F.col(ahead))
    found = each.groupBy(*keys, "e", "p").agg(F.count_if(F.coalesce(F.col("_s") != 0, F.lit(False))).alias("trades"), F.avg("_r").alias("m"), F.stddev_pop("_r").alias("v"))
    good = found.withColumn("score", F.when(F.col("v") > 0, F.col("m") / F.col("v")).otherwise(F.col("m"))).where((F.col("trades") >= max(1, s.threshold_min_trades)) & F.col("score").isNotNull())
    best = good.groupBy(*keys).agg(F.max_by(F.struct("e", "p"), F.struct("score", -F.col("e"), -F.col("p"))).alias("b"))
    every = rows.select(*keys).distinct().join(best, keys, "left")
    return every.select(*keys, F.coalesce("b.e", F.lit(s.min_edge)).alias("min_edge"), F.coalesce("b.p", F.lit(s.min_probability)).alias("min_probability"))


# position rules: a state machine over sorted rows


def scan(df: DataFrame, keys: list[str], inputs: list[str], output: str, start: Callable[[], list], step: Callable[[list, tuple], float]) -> DataFrame:
    """df with one more column: step(state, inputs) row by row in time order, with a new state for each key.

    Partitions are sorted and read as a stream; a batch is held at a time, whatever a key's number of rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, start()
        for part in batches:
            out = []
            for key, row in zip(part[keys].itertuples(index=False, name=None), part[inputs].itertuples(index=False, name=None), strict=True):
                if key != current:
                    current, state = key, start()
                out.append(step(state, row))
            yield part.assign(**{output: pd.Series(out, index=part.index, dtype="float64")})

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, "ts")
    return ordered.mapInPandas(run, StructType([*df.schema, StructField(output, DoubleType())]))


def scan_blocks(df: DataFrame, keys: list[str], inputs: list[str], output: str, start: Callable[[], list], step: Callable[[list, tuple], float], alike: Callable[[list], list], block_rows: int) -> DataFrame:
    """scan() with a series cut into blocks, all of which run at once.

    Every block first runs from the start state. A block whose state before it turns out to be another runs again from
    that one, until no block's does; rules that forget need one such round or two, and only for the blocks concerned. The
    first block's state is right, so each round settles one more block at least. alike: the state as far as it matters;
    it is an array of doubles. The rows are written once; between rounds a block is one row.
    """
    cut = saved(in_blocks(df, block_rows, 0, tuple(keys)).drop("own", "tail"))
    by = [*keys, "block"]
    kinds = dict(cut.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in by)

    def run(part: pd.DataFrame, before: list) -> tuple[list[float], list]:
        state = [float(x) for x in before]
        out = [step(state, row) for row in part[inputs].itertuples(index=False, name=None)]
        return out, alike(state)

    def ends(key: tuple, part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        before = list(told["before"].iloc[0])
        after = run(part.sort_values("ts"), before)[1]
        return pd.DataFrame([(*key, before, after)], columns=[*by, "before", "after"])

    def outputs(key: tuple, part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts", ignore_index=True)
        return part.assign(**{output: pd.Series(run(part, list(told["before"].iloc[0]))[0], index=part.index, dtype="float64")}).drop(columns="block")

    flat = F.array(*[F.lit(float(x)) for x in start()])
    rows = cut.select(*by, "ts", *inputs).groupBy(*by)
    todo = saved(cut.select(*by).distinct().withColumn("before", flat))
    states = None
    while True:
        ran = rows.cogroup(todo.groupBy(*by)).applyInPandas(lambda k, a, b: ends(k, a, b) if len(b) else pd.DataFrame(columns=[*by, "before", "after"]), f"{head}, before array<double>, after array<double>")
        states = saved(ran if states is None else ran.unionByName(states.join(todo.select(*by), by, "left_anti")))
        want = F.coalesce(F.lag("after").over(Window.partitionBy(*keys).orderBy("block")), flat)
        todo = saved(states.withColumn("want", want).where("want <> before").select(*by, F.col("want").alias("before")))
        if todo.isEmpty():
            break
    return cut.groupBy(*by).cogroup(states.select(*by, "before").groupBy(*by)).applyInPandas(outputs, StructType([*df.schema, StructField(output, DoubleType())]))


def rule_step(s: ModelSettings) -> Callable[[list, tuple], float]:
    """The rules as a step: from the state (position held, bars since it was taken, bars to wait) and a target to the next position."""
    min_holding, cooldown, min_change, alpha = s.min_holding, s.cooldown, s.min_change, s.smoothing

    def step(state: list, row: tuple) -> float:
        held, bars, wait = state
        want = row[0] if row[0] == row[0] and row[0] is not None and abs(row[0]) != float("inf") else 0.0
        side, aim, after = (held > 0) - (held < 0), (want > 0) - (want < 0), want
        if wait > 0 and side == 0:
            wait -= 1
            if aim:
                after, aim = 0.0, 0
        if side:
            leaving, turning = aim == 0, aim != 0 and aim != side
            if bars < min_holding and (leaving or turning):
                after = held
            elif leaving or turning:
                after, wait = (want if turning and cooldown <= 0 else 0.0), cooldown
            elif abs(want - held) < min_change:
                after = held
        if alpha < 1:
            after = alpha * after + (1 - alpha) * held
        if abs(after) < 1e-12:
            after = 0.0
        now = (after > 0) - (after < 0)
        state[:] = after, 0 if now == 0 else bars + 1 if now == side else 1, wait
        return after

    return step


def position_rules(df: DataFrame, keys: list[str], target: str = "target_position", s: ModelSettings = ModelSettings(), output: str = "ruled_position", block_rows: int | None = None) -> DataFrame:
    """df with the position after the rules: hold at least min_holding bars, wait cooldown bars after an exit, skip changes below min_change, smooth.

    block_rows: cut series into blocks of so many rows that run side by side.
    """
    step = rule_step(s)
    if block_rows is None:
        return scan(df, keys, [target], output, lambda: [0.0, 0, 0], step)
    alike = lambda state: [float(state[0]), float(min(state[1], s.min_holding)), float(state[2])]
    return scan_blocks(df, keys, [target], output, lambda: [0.0, 0, 0], step, alike, block_rows)


def composite_signal(rows: DataFrame, keys: list[str], s: ModelSettings = ModelSettings(), block_rows: int | None = None) -> DataFrame:
    """The tradeable signal out of probabilities. rows: prob_up, prob_down, direction, min_edge, min_probability, trade_allowed, confidence_trade_allowed."""
    edge, chance = F.coalesce("min_edge", F.lit(s.min_edge)), F.coalesce("min_probability", F.lit(s.min_probability))
    out = rows.withColumn("calibrated_prob_edge", (F.col("prob_up") - F.col("prob_down")) * F.col("direction")).withColumn("directional_probability", F.greatest("prob_up", "prob_down"))
    open_ = (F.coalesce("trade_allowed", F.lit(0.0)) > 0) & (F.coalesce("confidence_trade_allowed", F.lit(0.0)) > 0)
    raw = F.when(open_, F.coalesce(trade_signal(edge, chance) * F.col("direction"), F.lit(0.0))).otherwise(0.0)
    out = out.withColumn("position_size", position_size(edge, chance, s)).withColumn("target_position", F.coalesce(raw * F.col("position_size"), F.lit(0.0)))
    out = position_rules(out, keys, "target_position", s, block_rows=block_rows)
    w = Window.partitionBy(*keys).orderBy("ts")
    return out.withColumn("raw_signal", F.signum("ruled_position")).withColumn("position", F.lag("ruled_position", 1, 0.0).over(w)).withColumn("composite_score", F.col("calibrated_prob_edge"))


# documented extensions


def trend_strength(bars: DataFrame, w: int = 120, threshold: float = 0.25, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """bars with trend_strength (the window's return over the sum of absolute bar returns) and market_regime."""
    frames = Frames(keys)
    strength = absolute(frames.pct("close", w)) / frames.total(absolute("cc"), w)
    out = frames.apply(bars, {"trend_strength": strength}, bars.columns)
    return out.withColumn("market_regime", F.when(F.col("trend_strength") >= threshold, "trend").when(F.col("trend_strength").isNotNull(), "range"))


def time_decay(rows: DataFrame, keys: list[str], half_life: float = 400, floor: float = 0.25) -> DataFrame:
    """rows with decay_weight: half for every half_life bars of age, `floor` at least, mean 1 in each key."""
    age = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"))) - 1
    out = rows.withColumn("_w", F.greatest(F.lit(floor), F.pow(F.lit(0.5), age / half_life)))
    return out.withColumn("decay_weight", F.col("_w") / F.avg("_w").over(Window.partitionBy(*keys))).drop("_w")
