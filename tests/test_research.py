"""Admission in rounds, tiled correlations, walk-forward refits, running figures over blocks: against brute force."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_engine import bar_rows

from barloom import cli, config
from barloom.config import LibrarySettings, ModelSettings
from barloom.functions import kernels
from barloom.functions.frames import Frames, Term, in_blocks
from barloom.operators import backtest, boosting, composite, models, pairs, predictive, selection, trees, walkforward
from barloom.plans.factors import names_in_scope
from barloom.sources import bars as B

START = datetime(2023, 11, 1)


def series_rows(symbols: str, factors: int, bars: int, seed: int = 3, gaps: float = 0.1):
    """Values of factors in a few families of near copies, with gaps; ten bars a month, so spans of time are many."""
    r = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        base = r.normal(size=(bars, max(2, factors // 4)))
        for f in range(factors):
            x = base[:, f % base.shape[1]] + r.choice([0.1, 0.6, 2.0]) * r.normal(size=bars)
            x = np.where(r.random(bars) < gaps, np.nan, x)
            rows += [(s, f"f{f:03d}", START + timedelta(days=3 * t), None if np.isnan(v) else float(v)) for t, v in enumerate(x)]
    return rows


@pytest.fixture(scope="module")
def many(spark):
    return spark.createDataFrame(series_rows("AB", 40, 150), "symbol string, factor string, ts timestamp_ntz, value double").repartition(5).cache()


def plain_correlations(df, at_least=None):
    out = {}
    for s, part in df.toPandas().groupby("symbol"):
        r = part.pivot(index="ts", columns="factor", values="value").corr(min_periods=2)
        for i, a in enumerate(r.columns):
            for b in r.columns[i + 1 :]:
                if at_least is None or abs(r.loc[a, b]) >= at_least:
                    out[s, a, b] = r.loc[a, b]
    return out


@pytest.mark.parametrize(("at_least", "screen"), [(None, False), (0.7, False), (0.7, True)])
def test_correlations_of_tiles_are_all_pairs(many, at_least, screen):
    """Three tiles, the last one not full."""
    got = {(r["symbol"], r["factor_a"], r["factor_b"]): r["corr"] for r in pairs.correlations(many, ["symbol"], at_least=at_least, screen=screen, tile=16, complete=0.8).collect()}
    want = plain_correlations(many, at_least)
    assert got.keys() == want.keys() and len(got) > 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_sketches_leave_unlike_tiles_out(spark):
    """Tiles of one family each: the sketches keep the pairs of a tile with itself only."""
    r = np.random.default_rng(1)
    rows = []
    for family in range(6):
        base = r.normal(size=900)
        for k in range(8):
            x = base + 0.3 * r.normal(size=900)
            rows += [("A", f"f{family}{k}", START + timedelta(hours=t), float(v)) for t, v in enumerate(x)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "factor", "ts", "value"])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    listed = pairs.numbered(df, ["symbol"])
    tiles = pairs.tiles_of(df, listed, ["symbol"], "value", F.date_trunc("month", "ts"), 8)
    facts = spark.createDataFrame([("A", 5, 900)], "symbol string, last int, bars long")
    assert sorted((x["i"], x["j"]) for x in pairs._likely_tiles(tiles, facts, ["symbol"], 0.8).collect()) == [(i, i) for i in range(6)]
    assert pairs.correlations(df, ["symbol"], at_least=0.8, screen=True, tile=8).count() == 6 * 28
    with pytest.raises(ValueError, match="threshold"):
        pairs.correlations(df, ["symbol"], screen=True)


def test_constant_and_single_factors_have_no_correlation(spark):
    rows = [("A", f, START + timedelta(days=t), float(v)) for t in range(30) for f, v in (("flat", 0.1), ("x", t), ("y", -t))]
    got = {(r["factor_a"], r["factor_b"]): r["corr"] for r in pairs.correlations(spark.createDataFrame(rows, "symbol string, factor string, ts timestamp_ntz, value double"), ["symbol"]).collect()}
    assert got == {("flat", "x"): None, ("flat", "y"): None, ("x", "y"): pytest.approx(-1)}
    assert pairs.correlations(spark.createDataFrame(rows[:1], "symbol string, factor string, ts timestamp_ntz, value double"), ["symbol"]).collect() == []


@pytest.mark.parametrize(("lot", "s"), [(7, LibrarySettings(keep=9, max_corr=0.7, family_quota={"basic": 3, "calendar": 5})), (64, LibrarySettings(keep=4, max_corr=0.5)), (5, LibrarySettings(keep=100, max_corr=0.99))])
def test_admission_in_rounds_is_the_greedy_one(spark, many, lot, s):
    r = random.Random(8)
    rows = [(sym, f"f{f:03d}", r.choice(["basic", "calendar", "macro_state"]), rank, r.choice([None, None, None, "low_train_sharpe"])) for sym in "ABC" for rank, f in enumerate(r.sample(range(41), 41), 1)]  # C has no values, f040 neither
    ranked = spark.createDataFrame(rows, "symbol string, factor string, family string, rank int, reason string")
    key = lambda df: {(x["symbol"], x["factor"]): tuple(round(v, 9) if isinstance(v, float) else v for v in x[2:]) for x in df.collect()}
    want = key(selection.admit(ranked, selection.library_correlations(many, ["symbol"]), s))
    got = key(selection.admit_in_rounds(ranked, many, s, lot=lot))
    assert got == want and len({v[1] for v in got.values()}) >= 3


def brute_selection(x: pd.DataFrame, y: pd.Series, s: ModelSettings) -> list[str]:
    frame = x.assign(t=y).dropna(subset=["t"])
    scores = {c: abs(frame[c].corr(frame["t"])) for c in x if frame[c].std(ddof=0) > 0 and frame[c].notna().sum() >= s.min_samples}
    ranked = sorted((c for c in scores if scores[c] == scores[c]), key=lambda c: (-round(scores[c], 12), c))[: s.best * s.candidate_multiplier]
    taken: list[str] = []
    for c in ranked:
        if len(taken) < s.best and not any(abs(frame[c].corr(frame[o])) >= s.max_feature_corr for o in taken):
            taken.append(c)
    return taken


def model_table(n: int = 420, k: int = 9):
    r = np.random.default_rng(12)
    base = r.normal(size=(n, 3))
    x = np.stack([base[:, i % 3] + (0.2 if i < 6 else 1.5) * r.normal(size=n) for i in range(k)], 1)
    signal = np.where(x > 0.5, 1.0, np.where(x < -0.5, -1.0, 0.0))
    signal[r.random((n, k)) < 0.05] = np.nan
    shift = np.where(np.arange(n) < n // 2, base[:, 0], base[:, 1])  # what matters changes
    target = np.sign(np.round(shift + 0.5 * r.normal(size=n)))
    ahead = 0.01 * shift + 0.01 * r.normal(size=n)
    ts = [START + timedelta(minutes=30 * i) for i in range(n)]
    rows = pd.DataFrame({"symbol": "A", "ts": ts, "target_direction": target, "next_return": ahead, "trade_allowed": (r.random(n) > 0.1).astype(float)})
    for i in range(k):
        rows[f"f{i}_value"], rows[f"f{i}_signal"] = x[:, i], signal[:, i]
    rows.loc[n - 1, ["target_direction", "next_return"]] = np.nan
    return rows


def test_refits_choose_their_factors_and_learn_how_to_trade(spark):
    rows = model_table()
    s = ModelSettings(train_window=150, min_samples=90, retrain_every=20, min_directional=10, best=3, candidate_multiplier=2, max_feature_corr=0.6, select_in_window=True, threshold_min_trades=5)
    plain = rows.astype(object).where(rows.notna(), None)
    df = spark.createDataFrame([tuple(v.to_pydatetime() if isinstance(v, datetime) else v for v in row) for row in plain.itertuples(index=False)], "symbol string, ts timestamp_ntz, target_direction double, next_return double, trade_allowed double, " + ", ".join(f"f{i}_value double, f{i}_signal double" for i in range(9)))
    factors = {f"f{i}_signal": [f"f{i}_value", f"f{i}_signal"] for i in range(9)}
    features = [c for some in factors.values() for c in some]
    got = models.rolling_predictions(df, features, s, importance=True, factors=factors, calibrate=True).toPandas().sort_values("ts", ignore_index=True)
    at = {x: i for i, x in enumerate(got["ts"])}
    seen = set()
    for t in range(90, 420, 20):
        window = rows.iloc[max(0, t - 150) : t]
        want = brute_selection(window[list(factors)], window["target_direction"], s)
        assert (rows["ts"][t] in at) == bool(want)  # signals with gaps are too few at first
        if not want:
            continue
        row = got.iloc[at[rows["ts"][t]]]
        assert list(row["selected"]) == want
        seen.add(tuple(want))
        use = [c for f in want for c in factors[f]]
        share = dict(zip(features, row["importance"], strict=True))
        assert sum(share.values()) == pytest.approx(1) and all(share[c] == 0 for c in features if c not in use)
        learn = window.dropna(subset=["target_direction"])
        x, y = learn[use].fillna(0.0).to_numpy(), learn["target_direction"].to_numpy()
        m = models.softmax_fit(x, (y + 1).astype(int), np.where(y == 0, s.neutral_weight, s.directional_weight))
        p = models.softmax_predict(m, x)
        assert row[["min_edge", "min_probability", "direction"]].tolist() == pytest.approx(brute_calibration(p, learn["next_return"].to_numpy(), learn["trade_allowed"].to_numpy() > 0, s))
        now = rows.iloc[[t]]
        np.testing.assert_allclose(row[["prob_down", "prob_flat", "prob_up"]].to_numpy(float), models.softmax_predict(m, now[use].fillna(0.0).to_numpy())[0], atol=1e-9)
        vote = learn[want].mean(axis=1)
        gain = (np.sign(vote.fillna(0.0)) * learn["trade_allowed"] * learn["next_return"]).sum()
        score = now[want].mean(axis=1).iloc[0] * (-1 if gain < 0 else 1)
        assert row["vote_score"] == pytest.approx(score, nan_ok=True)
    assert len(seen) > 3


def brute_calibration(p, ahead, allowed, s):
    best, most = (s.min_edge, s.min_probability), -np.inf
    for e, c in composite.threshold_grid(s):
        signal = np.array([(0 if not a or max(q[0], q[2]) < c else 1 if q[2] - q[0] >= e else -1 if q[2] - q[0] <= -e else 0) for q, a in zip(p, allowed, strict=True)], float)
        if (signal != 0).sum() < s.threshold_min_trades:
            continue
        gain = pd.Series(signal * ahead).dropna()
        score = gain.mean() / gain.std(ddof=0) if gain.std(ddof=0) > 0 else gain.mean()
        if score > most:
            best, most, kept = (e, c), score, gain
    return [*best, -1.0 if most > -np.inf and kept.sum() < 0 else 1.0]


def test_calibration_in_a_window_is_that_of_the_table(spark):
    r = np.random.default_rng(2)
    p = r.dirichlet([2, 1, 2], 200)
    ahead, allowed = r.normal(size=200), r.random(200) > 0.2
    s = ModelSettings()
    rows = spark.createDataFrame([("A", *map(float, q), float(a), float(b)) for q, a, b in zip(p, ahead, allowed, strict=True)], "symbol string, prob_down double, prob_flat double, prob_up double, next_return double, trade_allowed double")
    want = composite.calibrated_thresholds(rows, ["symbol"], s).first()
    assert walkforward.calibrate(p, ahead, allowed, s)[:2] == (want["min_edge"], want["min_probability"])


def test_window_sums_move_forward():
    r = np.random.default_rng(5)
    x = np.where(r.random((300, 6)) < 0.2, np.nan, r.normal(size=(300, 6)) * 10 + 1e4)
    x[100:160, 2] = 7.0
    window = walkforward.WindowMoments(x)
    for low, high in ((0, 40), (0, 60), (20, 120), (100, 160), (240, 300)):
        got, n = window.correlations(low, high)
        frame = pd.DataFrame(x[low:high])
        want = frame.corr(min_periods=2).to_numpy()
        want[2] = np.where(frame[2].nunique() < 2, np.nan, want[2])
        want[:, 2] = np.where(frame[2].nunique() < 2, np.nan, want[:, 2])
        np.testing.assert_allclose(got, want, atol=1e-9, equal_nan=True)
        assert n[0, 0] == frame[0].notna().sum()
    with pytest.raises(ValueError, match="forward"):
        window.correlations(0, 300)


def test_kernels_equal_pandas_and_do_not_depend_on_the_frame():
    r = np.random.default_rng(0)
    for n in (1, 5, 50, 600):
        for w in (1, 2, 3, 10, 48, 240):
            x = np.round(np.cumsum(r.normal(size=n)), 1) + 100
            x[r.random(n) < 0.3] = np.nan
            if n > 100:
                x[200:320], x[400:520] = 7.25, np.nan
            with np.errstate(all="ignore"):
                got = kernels.single(x, w, {"avg({})", "stddev_samp({})", "max({})", "min({})", "pct_rank({})", "percentile({}, 0.5D)", "percentile({}, 0.2D)"})
            s = pd.Series(x).rolling(w, min_periods=1)
            want = {"avg({})": s.mean(), "max({})": s.max(), "min({})": s.min(), "percentile({}, 0.5D)": s.quantile(0.5), "percentile({}, 0.2D)": s.quantile(0.2), "pct_rank({})": s.rank(pct=True)}
            for name, value in want.items():
                np.testing.assert_allclose(got[name], value.to_numpy(), rtol=1e-9, atol=1e-9, err_msg=f"{name} {n} {w}")
            np.testing.assert_allclose(got["stddev_samp({})"], s.std().to_numpy(), atol=1e-6)
            assert not np.nan_to_num(got["stddev_samp({})"][(s.max() == s.min()).to_numpy()]).any()


def test_decay_over_blocks_is_that_of_the_whole_series(spark):
    bars = spark.createDataFrame(bar_rows("AB", 700), B.BAR_SCHEMA)
    gap = Term("(CASE WHEN hour(ts) NOT IN (5, 6, 7) AND day(ts) <> 4 THEN close END)")
    cut, whole = Frames(("symbol", "block")), Frames()
    terms = lambda f: {"e": f.ewm(gap, 400, 5), "fast": f.ewm("close", 3, 1), "later": f.mean(f.ewm(gap, 50, 5), 9, 2), "twice": f.ewm(f.ewm("close", 9, 1), 30, 1)}
    a = cut.apply(in_blocks(bars, 64, 32), terms(cut), ["symbol", "ts", "own"]).where("own").drop("own")
    b = whole.apply(bars, terms(whole), ["symbol", "ts", "close"])
    a, b = (x.toPandas().sort_values(["symbol", "ts"], ignore_index=True) for x in (a, b))
    for c in ("e", "fast", "later", "twice"):
        np.testing.assert_allclose(a[c], b[c], rtol=1e-12, atol=1e-12)
    one = b[b["symbol"] == "A"]
    np.testing.assert_allclose(one["twice"], one["close"].ewm(span=9, adjust=False).mean().ewm(span=30, adjust=False).mean(), rtol=1e-12)


def test_quantile_groups_over_blocks(spark, many):
    s = config.BacktestSettings(qcut_window=30, qcut_least=12, qcut_groups=4)
    key = lambda df: {(r["symbol"], r["factor"], r["ts"]): (r["qcut_label"], r["effective_group"]) for r in df.collect()}
    assert key(predictive.qcut_labels(many, ["symbol", "factor"], s, block_rows=35)) == key(predictive.qcut_labels(many, ["symbol", "factor"], s))


def test_running_figures_over_spans(spark):
    r = random.Random(11)
    rows = []
    for s in "ABC":
        for t in range(400):
            p = r.choice([-1.0, -0.5, 0.0, 0.0, 1.0]) if s != "C" else 0.0
            rows.append((s, START + timedelta(hours=11 * t), p if t % 17 else None, 0.1, r.choice([None, 0.0, 100 + r.random()]), r.choice([None, r.gauss(0, 0.3), r.gauss(0, 0.01), -2.5 if s == "B" else 0.0])))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, position double, composite_score double, close double, oc double")
    one, two = (backtest.backtest(df, ["symbol"], 0.001, block) for block in (None, "month"))
    a, b = (x.toPandas().sort_values(["symbol", "ts"], ignore_index=True) for x in (one, two))
    pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-9)
    a, b = (backtest.with_trades(one, ["symbol"], block).toPandas().sort_values(["symbol", "ts"], ignore_index=True) for block in (None, "month"))
    pd.testing.assert_series_equal(a["trade"], b["trade"], check_dtype=False)
    a, b = (backtest.performance(one, ["symbol"], block=block).toPandas().sort_values("symbol", ignore_index=True) for block in (None, "month"))
    pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-9)
    assert len(a) == 3 and a["trade_count"].max() > 50


@pytest.mark.parametrize("s", [ModelSettings(), ModelSettings(min_holding=40, cooldown=30), ModelSettings(smoothing=0.6), ModelSettings(min_change=0.9)])
def test_position_rules_over_blocks(spark, s):
    r = random.Random(9)
    rows = [(k, START + timedelta(minutes=i), r.choice([None, 0.0, 0.5, 0.55, 1.0, -0.5])) for k in "ab" for i in range(500)]
    rows += [("c", START + timedelta(minutes=i), 1.0) for i in range(300)]  # never flat
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, target_position double")
    a, b = (composite.position_rules(df, ["symbol"], s=s, block_rows=n).toPandas().sort_values(["symbol", "ts"], ignore_index=True) for n in (None, 50))
    pd.testing.assert_frame_equal(a, b[a.columns])


SETTINGS = {"library": {"min_sharpe": -1e9, "min_total_return": -1.0, "min_train_sharpe": -1e9, "min_train_total_return": -1.0, "min_train_win_rate": -1.0, "min_selection_win_rate": -1.0, "max_corr": 0.95},
            "factors": {"related_symbols": ["B.X", "C"], "macro_symbols": ["M.X"], "block_rows": 500, "scope": "selected", "selected": ["momentum", "reversal", "cross_ratio_zdist_b_x_5", "cross_relret_c_5", "macro_ret_1_m_x", "calendar_time_sin"]},
            "model": {"kinds": ["logistic"], "best": 2, "train_window": 120, "min_samples": 80, "min_directional": 10, "select_in_window": True, "state_features": True, "max_feature_corr": 0.95, "half_life": 60},
            "portfolio": {"min_samples": 10, "window": 60, "sectors": {"A": "one", "B.X": "one"}, "sector_cap": 0.6}}


NAMED = {"A": "A", "B": "B.X", "C": "C"}


def three_symbols(spark, n: int):
    return spark.createDataFrame([(NAMED[r[0]], *r[1:]) for name in "ABC" for r in bar_rows("ABC", 520) if r[0] == name and r[1] < datetime(2024, 1, 1) + timedelta(minutes=30 * n)], B.BAR_SCHEMA)


def run_of(spark, out: str, n: int, s):
    """A run over two main symbols, with the third as a related one and a daily series."""
    bars = three_symbols(spark, n)
    macro = spark.createDataFrame([("M.X", date(2023, 12, 20) + timedelta(days=k), 100.0 + (k * 7 % 5)) for k in range(40)], B.MACRO_SCHEMA)
    main = bars.where("symbol <> 'C'")
    f = s.factors
    library = cli.single(spark, s, main, names_in_scope(f.related_symbols, f.macro_symbols, f.scope, f.new_from, f.selected), out, bars, macro)
    return library, main, bars, macro


@pytest.fixture(scope="module")
def long_run(spark, tmp_path_factory):
    s = config.with_values(config.Settings(), SETTINGS)
    out = str(tmp_path_factory.mktemp("runs") / "long")
    return out, s, *run_of(spark, out, 520, s)


def test_a_run_with_cross_and_macro_factors(spark, long_run):
    out, s, library, main, bars, macro = long_run
    table = lambda name: spark.read.parquet(f"{out}/{name}")
    values = {(r["symbol"], r["factor"]): r["n"] for r in table("factors").groupBy("symbol", "factor").agg(F.count("value").alias("n")).collect()}
    assert {f for s_, f in values if s_ == "A"} == set(s.factors.selected) and min(values[k] for k in values if k[1].startswith(("cross", "macro"))) > 300
    assert table("single_factor_summary").where("factor_id IS NULL").count() == 0 and library.where("status = 'active'").count() >= 4
    kept = {name: B.source_files(table(name)) for name in ("factors", "single_factor_summary", "factor_library")}
    run_of(spark, out, 520, s)  # nothing is made anew
    assert {name: B.source_files(table(name)) for name in kept} == kept and table("summary_history").count() == table("single_factor_summary").count()
    report = cli.quality_tables(spark, s, main, out, bars, macro)
    assert {r["role"] for r in report.collect()} == {"main", "related", "macro_daily"} and table("related_coverage").count() == 3
    with pytest.raises(ValueError, match="bars of 45 minutes"):
        cli.quality_tables(spark, replace(s, bar_minutes=45), main, out)


def test_later_bars_change_no_earlier_position(spark, long_run, tmp_path):
    """Thresholds, directions and factors of a refit come from its own past: with more bars, the positions before them stay."""
    out, s, *_ = long_run
    cut = datetime(2024, 1, 1) + timedelta(minutes=30 * 420)
    found = []
    for n in (520, 420):
        folder = str(tmp_path / str(n))
        for name in ("single_factor_summary", "factor_library", "factors"):  # one library; values that end earlier
            rows = spark.read.parquet(f"{out}/{name}")
            (rows.where(F.col("ts") < F.lit(cut)) if name == "factors" and n == 420 else rows).write.parquet(f"{folder}/{name}")
        found.append(cli.composed(spark, s, three_symbols(spark, n).where("symbol <> 'C'"), folder).select("symbol", "ts", "position").toPandas())
        assert spark.read.parquet(f"{folder}/window_selection").groupBy("symbol", "ts").count().where("count > 2").count() == 0
    both = found[1].merge(found[0], on=["symbol", "ts"], suffixes=("", "_later"))
    assert len(both) == len(found[1]) > 300 and (both["position"] != 0).sum() > 20
    np.testing.assert_allclose(both["position"], both["position_later"], atol=1e-9)
    folder = str(tmp_path / "520")
    assert cli.multi(spark, s, folder).select("method").distinct().count() == 3
    weights = spark.read.parquet(f"{folder}/portfolio_weights")
    assert "sector" in weights.columns and spark.read.parquet(f"{folder}/contributions").count() > 0


def test_command_line_arguments(spark, tmp_path):
    args = cli.parser().parse_args(["quality", "--bars", "x", "--out", "y", "--related", "--macro", "m", "--prune", "p.csv"])
    assert args.related and args.macro == "m" and args.verb == "quality"
    path = str(tmp_path / "prune.csv")
    with open(path, "w") as f:
        f.write("factor\nmomentum\nreversal\n")
    assert cli.prune_list(spark, path) == {"momentum", "reversal"} and cli.prune_list(spark, None) == set()
    assert date(2024, 1, 1) == START.date() + timedelta(days=61)


def boosted_table(n: int = 600, symbols: str = "A"):
    r = np.random.default_rng(21)
    rows = []
    for s in symbols:
        x = r.normal(size=(n, 5))
        y = np.sign(np.round(x[:, 0] * x[:, 1] + 0.3 * r.normal(size=n)))
        rows += [(s, START + timedelta(minutes=30 * t), float(y[t]), *map(float, x[t])) for t in range(n)]
    return rows


FIVE = [f"x{i}" for i in range(5)]
BOOSTED = "symbol string, ts timestamp_ntz, target_direction double, " + ", ".join(f"{c} double" for c in FIVE)


@pytest.mark.parametrize("keep", [2, 99])
def test_pooled_boosting_grows_the_same_trees(spark, monkeypatch, keep):
    monkeypatch.setattr(boosting, "KEEP", keep)
    rows = boosted_table()
    s = ModelSettings(boost_rows=1.0, boost_columns=1.0, early_rounds=0, boost_rounds=5, boost_bins=16)
    x, y = np.array([r[3:] for r in rows]), np.array([r[2] for r in rows])
    want = trees.fit(x, (y + 1).astype(int), np.where(y == 0, s.neutral_weight, s.directional_weight), "boosted", s)
    df = spark.createDataFrame(rows, BOOSTED).repartition(3)
    got = boosting.fit_pooled(df, FIVE, s, edges=trees.cuts_of(x, 16))
    assert len(got.trees) == len(want.trees) == 15
    for a, b in zip(got.trees, want.trees, strict=True):
        assert (a[0] == b[0]).all() and (a[1][a[0] >= 0] == b[1][b[0] >= 0]).all()
        np.testing.assert_allclose(a[2], b[2], atol=1e-12)
    np.testing.assert_allclose(got.shares(), want.shares(), atol=1e-9)
    p = {r["ts"]: (r["prob_down"], r["prob_flat"], r["prob_up"]) for r in boosting.predict_pooled(got, df, FIVE).collect()}
    np.testing.assert_allclose([p[r[1]] for r in rows], trees.predict(want, x), atol=1e-9)


def test_pooled_boosting_learns_and_stops(spark):
    rows = boosted_table(900, "ABC")
    df = spark.createDataFrame(rows, BOOSTED)
    s = ModelSettings(boost_rate=0.5, boost_rounds=12, early_rounds=3, boost_bins=32)
    model = boosting.fit_pooled(df, FIVE, s)
    assert 6 <= len(model.trees) <= 36 and len(model.trees) % 3 == 0
    late = boosting.predict_pooled(model, df.where(F.col("ts") > START + timedelta(minutes=30 * 750)), FIVE).toPandas()
    hit = late[["prob_down", "prob_flat", "prob_up"]].to_numpy().argmax(1) - 1 == late["target_direction"]
    assert hit.mean() > 0.6 and np.allclose(late[["prob_down", "prob_flat", "prob_up"]].sum(axis=1), 1)
    assert model.shares()[:2].sum() > 0.8
    with pytest.raises(ValueError, match="labels"):
        boosting.fit_pooled(df.where("ts IS NULL"), FIVE, s)


def test_streamed_positions_equal_the_batch(spark, tmp_path):
    """Four runs of one stream; bars that come after later ones are counted and change nothing."""
    from barloom.streaming.positions import streamed_positions

    rows = [(r[0], r[1], r[5]) for r in bar_rows("AB", 160)]
    schema = "symbol string, ts timestamp_ntz, close double"
    first = min(r[1] for r in rows)
    folder, s = str(tmp_path), ModelSettings(min_holding=3)
    for k in range(4):
        part = [r for r in rows if k * 40 <= (r[1] - first) / timedelta(minutes=30) < (k + 1) * 40]
        part += [("A", first + timedelta(minutes=5), 1.0)] * (k == 2)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = streamed_positions(spark.readStream.schema(schema).parquet(f"{folder}/in"), s, 10, 0.005)
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{folder}/out").toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    want = pd.DataFrame(rows, columns=["symbol", "ts", "close"])
    value = want["close"] / want.groupby("symbol")["close"].transform(lambda c: c.rolling(10).mean()) - 1
    want["target_position"] = np.where(value > 0.005, 1.0, np.where(value < -0.005, -1.0, 0.0))
    want = composite.position_rules(spark.createDataFrame(want).withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["symbol"], s=s).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    assert len(got) == 320
    np.testing.assert_allclose(got["ruled_position"], want["ruled_position"])
    assert got.groupby("symbol")["late"].max().to_dict() == {"A": 1, "B": 0} and got["ruled_position"].abs().sum() > 50


def test_a_closed_stream_gives_all_bars(spark, tmp_path):
    from barloom.streaming.bars import close_stream, read_events, streaming_bars, write_bars

    folder = str(tmp_path)
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    events = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(minutes=7 * i), "ab"[i % 2], float(i)) for i in range(50)], schema)
    events.coalesce(1).write.parquet(f"{folder}/in")
    counts = []
    for last in (False, True):
        if last:
            close_stream(spark, events.schema, f"{folder}/marks")
        write_bars(streaming_bars(read_events(spark, f"{folder}/in", events.schema, f"{folder}/marks")), f"{folder}/bars", f"{folder}/state").awaitTermination()
        counts.append(spark.read.schema(B.BAR_SCHEMA).parquet(f"{folder}/bars").count())
    assert counts[0] < counts[1] == B.bars_from_events(events).count()
