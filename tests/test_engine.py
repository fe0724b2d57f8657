"""Rules of the engine: no look-ahead, blocks, the catalogue, brute force where SQL ends."""

from __future__ import annotations

import math
import random
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import __spark_entry__ as entry_point
from barloom import cli, config
from barloom import queries as Q
from barloom.config import LibrarySettings, ModelSettings
from barloom.functions.frames import Frames, Term, in_blocks
from barloom.operators import backtest, composite, models, portfolio, selection, trees
from barloom.plans import catalog, checks
from barloom.plans.factors import build_factors, scoped, wide
from barloom.sources import bars as B
from barloom.sources import sinks

RELATED, MACRO = Q.RELATED_DEFAULT, Q.MACRO_DEFAULT


def bar_rows(symbols: str, n: int, seed: int = 1):
    r = random.Random(seed)
    out = []
    for s in symbols:
        price = 100.0
        for k in range(n):
            o, c = price, price * (1 + r.gauss(0, 0.01))
            out.append((s, datetime(2024, 1, 1) + timedelta(minutes=30 * k), o, max(o, c) * 1.001, min(o, c) * 0.999, c, float(r.randint(0, 50)), float(r.randint(1, 9)) * 1000))
            price = c
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(bar_rows("AB", 400), B.BAR_SCHEMA).cache()


def test_catalogue_counts_and_numbers():
    every = catalog.catalog(RELATED, MACRO)
    assert len(every) == 127367 == len({name for _, name, _, _ in every})
    assert every[106884][1] == "calendar_time_sin" and every[126977][1].startswith("macro_ret_1_")
    assert [n for n, *_ in every[:3]] == [1, 2, 3]
    with_source = [f.source for _, _, f, _ in every]
    assert {s: with_source.count(s) for s in ("parametric", "additional", "struct", "mega", "cross", "crossmega", "omega", "crossomega", "macro")} == {
        "parametric": 1900, "additional": 1500, "struct": 3000, "mega": 10000, "cross": 480, "crossmega": 10000, "omega": 20000, "crossomega": 20000, "macro": 390}


def test_no_formula_looks_ahead_and_pruned_templates_are_found():
    assert checks.looks_ahead() == []
    names = {name for _, name, f, _ in catalog.catalog() if f.source == "ultra" and f.template == "skew"}
    assert checks.removable(names) == [("ultra", "skew")]


NAMES = {"momentum", "reversal", "obv_ma_gap_21", "mega_ewm_gap_bar_return_8", "omega_slow_rank_gap_gap_pressure_5", "ultra_kurt_body_pct_13", "hyper_ewm_cross_pressure_10"}


def pivot(df):
    return {(r["symbol"], r["ts"], r["factor"]): r["value"] for r in df.collect()}


def same(a: dict, b: dict) -> bool:
    return a.keys() == b.keys() and all((x is None) == (b[k] is None) and (x is None or math.isclose(x, b[k], abs_tol=1e-6)) for k, x in a.items())


def test_blocks_change_nothing(spark, bars):
    listed = [f for _, name, f, _ in catalog.catalog() if name in NAMES]
    rows = B.with_returns(bars)
    whole = wide(rows, listed).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    cut = wide(rows, listed, block_rows=400).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    pd.testing.assert_frame_equal(whole, cut)
    frames = Frames(("symbol", "block"))
    sums = frames.apply(in_blocks(rows, 64, 16), {"c": frames.cumsum("volume"), "m": frames.mean("volume", 5)}, ["symbol", "ts", "own"]).where("own").drop("own")
    plain = Frames()
    want = plain.apply(rows, {"c": plain.cumsum("volume"), "m": plain.mean("volume", 5)}, ["symbol", "ts"])
    a, b = (x.toPandas().sort_values(["symbol", "ts"], ignore_index=True) for x in (sums, want))
    pd.testing.assert_frame_equal(a, b)


def test_moving_functions_over_blocks_equal_windows(spark, bars):
    """Gaps, constant stretches, and a run of missing values longer than the rows that a block repeats."""
    rows = B.with_returns(bars).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    rows = rows.withColumns({"x": F.when(F.col("n") % 7 != 3, F.when(F.col("n").between(40, 90), 1.1).otherwise(F.col("close"))), "y": F.when(F.col("n") % 5 != 1, F.col("volume")), "v": F.when(~F.col("n").between(20, 150), F.col("close"))})

    def terms(f: Frames) -> dict[str, Term]:
        out = {"pct": f.pct("v"), "pct9": f.pct("v", 9), "later": f.mean(f.pct("v", 3), 6), "cov": f.cov("x", "y", 9, 4), "corr": f.corr("x", "y", 9, 4), "n": f.count("x", 6), "nested": f.std(f.std("x", 5, 2), 6, 3), "rank": f.rank("x", 11, 3)}
        out |= {name: getattr(f, name)("x", 11, 4) for name in ("mean", "total", "std", "var", "peak", "trough", "median", "skew", "kurt")}
        return out | {"low": f.quantile("x", 11, 0.2, 2), "one": f.mean("x", 1), "flat": f.std("x", 11, 1)}

    cut, whole = Frames(("symbol", "block")), Frames()
    a = cut.apply(in_blocks(rows, 64, 32), terms(cut), ["symbol", "ts", "own"]).where("own").drop("own")
    b = whole.apply(rows, terms(whole), ["symbol", "ts"])
    a, b = (x.toPandas().sort_values(["symbol", "ts"], ignore_index=True) for x in (a, b))
    assert len(b) > 300 and b.notna().sum().min() > 50
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-9)


def test_factors_know_nothing_of_later_bars(spark, bars):
    cut = datetime(2024, 1, 5)
    early = pivot(build_factors(bars.where(F.col("ts") <= F.lit(cut)), NAMES, block_rows=None))
    late = {k: v for k, v in pivot(build_factors(bars, NAMES, block_rows=None)).items() if k[1] <= cut}
    assert same(early, late)


def test_order_of_rows_changes_nothing(spark, bars):
    shuffled = bars.orderBy(F.rand(3)).repartition(7)
    assert same(pivot(build_factors(bars, NAMES, block_rows=None)), pivot(build_factors(shuffled, NAMES, block_rows=None)))


def test_ewm_and_moments_equal_pandas(spark, bars):
    frames = Frames()
    gap = Term("(CASE WHEN hour(ts) <> 5 THEN close END)")
    got = frames.apply(bars, {"e": frames.ewm(gap, 13, 6), "s": frames.skew("close", 9), "k": frames.kurt("close", 9), "q": frames.quantile("close", 9, 0.3)}, ["symbol", "ts", "close"]).where("symbol = 'A'").toPandas().sort_values("ts", ignore_index=True)
    x = got["close"].where(pd.to_datetime(got["ts"]).dt.hour != 5)
    want = {"e": x.ewm(span=13, adjust=False, min_periods=6).mean(), "s": got["close"].rolling(9).skew(), "k": got["close"].rolling(9).kurt(), "q": got["close"].rolling(9).quantile(0.3)}
    for c, w in want.items():
        np.testing.assert_allclose(got[c].to_numpy(float), w.to_numpy(), atol=1e-6, equal_nan=True)


def test_unknown_and_empty_requests(spark, bars):
    assert build_factors(bars, set()).count() == 0
    assert build_factors(bars, {"momentum"}, pruned={"momentum"}).count() == 0
    with pytest.raises(ValueError, match="unknown factors"):
        build_factors(bars, {"nonsense_7"})
    c = spark.createDataFrame([(1, "a"), (2, "b")], "factor_id long, factor string")
    assert [r["factor"] for r in scoped(c, "new", 2).collect()] == ["b"] and scoped(c, "selected", selected=("a",)).count() == 1
    with pytest.raises(ValueError, match="unknown"):
        scoped(c, "selected", selected=("zz",))


def test_nav_is_the_product_of_returns(spark, data):
    rows = Q.tested(spark, data).select("symbol", "factor", "segment", "ts", "net_return", "nav").toPandas().sort_values("ts")
    for _, part in rows.groupby(["symbol", "factor", "segment"]):
        np.testing.assert_allclose(part["nav"], (1 + part["net_return"]).cumprod(), rtol=1e-9)


def test_weights_sum_to_one_and_keep_the_cap(spark):
    r = random.Random(3)
    rows = [(m, t, s, r.choice([None, 0.0, -1.0, r.random(), 5 * r.random()])) for m in "ab" for t in range(40) for s in "uvwxyz"]
    got = portfolio.capped(spark.createDataFrame(rows, "method string, ts int, symbol string, raw double"), ["method", "ts"], "raw", 0.3).toPandas()

    def brute(raw):
        w = np.clip(np.nan_to_num(np.array(raw, float)), 0, None)
        w = np.ones(len(w)) / len(w) if w.sum() <= 0 else w / w.sum()
        fixed, left, budget = np.zeros(len(w)), list(range(len(w))), 1.0
        while left:
            total = sum(w[i] for i in left)
            share = {i: w[i] / total * budget if total > 0 else budget / len(left) for i in left}
            over = [i for i in left if share[i] > 0.3] if total > 0 else []
            if not over:
                for i in left:
                    fixed[i] = share[i]
                break
            for i in over:
                fixed[i] = 0.3
            budget -= 0.3 * len(over)
            left = [i for i in left if i not in over]
            if budget <= 0:
                break
        return fixed / fixed.sum()

    for _, part in got.groupby(["method", "ts"]):
        assert part["weight"].sum() == pytest.approx(1)
        np.testing.assert_allclose(part["weight"], brute(part["raw"].tolist()), atol=1e-9)


def test_admission_is_greedy_in_rank_order(spark):
    ranked = spark.createDataFrame([("A", f"f{k}", "basic" if k < 5 else "calendar", k, "low_train_sharpe" if k == 2 else None) for k in range(1, 8)], "symbol string, factor string, family string, rank int, reason string")
    pairs = spark.createDataFrame([("A", "f1", "f3", 0.9, 0.1), ("A", "f2", "f4", 0.99, 0.99), ("A", "f4", "f5", 0.2, None), ("A", "f1", "f6", 0.1, 0.85)], "symbol string, factor_a string, factor_b string, value_corr double, signal_corr double")
    got = {r["factor"]: (r["status"], r["reason"]) for r in selection.admit(ranked, pairs, LibrarySettings(keep=3, family_quota={"basic": 2})).collect()}
    assert got == {"f1": ("active", None), "f2": ("rejected", "low_train_sharpe"), "f3": ("rejected", "high_corr"), "f4": ("active", None), "f5": ("active", None), "f6": ("retired", "rank_outside_top_n"), "f7": ("retired", "rank_outside_top_n")}


def brute_rules(targets, s: ModelSettings):
    cur, hold, cool, out = 0.0, 0, 0, []
    sign = lambda x: (x > 0) - (x < 0)
    for t in targets:
        t = 0.0 if t is None or t != t else t
        cs, ds, nxt = sign(cur), sign(t), t
        if cool > 0 and cs == 0 and ds != 0:
            nxt, ds, cool = 0.0, 0, cool - 1
        elif cool > 0 and cs == 0:
            cool -= 1
        if cs != 0:
            if hold < s.min_holding and ds != cs:
                nxt = cur
            elif ds not in (0, cs):
                nxt, cool = (0.0 if s.cooldown > 0 else t), s.cooldown
            elif ds == 0:
                nxt, cool = 0.0, s.cooldown
            elif abs(t - cur) < s.min_change:
                nxt = cur
        nxt = s.smoothing * nxt + (1 - s.smoothing) * cur if s.smoothing < 1 else nxt
        nxt = 0.0 if abs(nxt) < 1e-12 else nxt
        hold = 0 if sign(nxt) == 0 else hold + 1 if sign(nxt) == cs else 1
        cur = nxt
        out.append(cur)
    return out


@pytest.mark.parametrize("s", [ModelSettings(), ModelSettings(min_holding=4, cooldown=3, smoothing=0.6), ModelSettings(cooldown=0)])
def test_position_rules_equal_brute_force(spark, s):
    r = random.Random(9)
    t = [r.choice([None, 0.0, 0.0, 0.5, 0.55, 1.0, -0.5, -1.0]) for _ in range(300)]
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=i), x) for k in "ab" for i, x in enumerate(t)]
    got = composite.position_rules(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, target_position double"), ["symbol"], s=s).toPandas()
    for _, part in got.groupby("symbol"):
        np.testing.assert_allclose(part.sort_values("ts")["ruled_position"], brute_rules(t, s), atol=1e-12)


def test_rolling_models_use_the_past_only(spark):
    r = random.Random(4)
    rows, x = [], 0.0
    for k in range(500):
        y = 1.0 if x > 0.3 else -1.0 if x < -0.3 else 0.0
        rows.append(("A", datetime(2024, 1, 1) + timedelta(minutes=30 * k), r.choice([y, y, y, 0.0]) if k < 499 else None, x, r.random()))
        x = r.gauss(0, 1)
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, target_direction double, f1 double, f2 double")
    s = ModelSettings(train_window=150, min_samples=80, retrain_every=20, min_directional=20)
    got = {a["ts"]: (a["prob_down"], a["prob_flat"], a["prob_up"]) for a in models.rolling_predictions(df, ["f1", "f2"], s).collect()}
    assert len(got) == 420 and all(sum(p) == pytest.approx(1) for p in got.values())
    table = np.array([[np.nan if v is None else v for v in row[2:]] for row in rows], float)
    for t in (80, 260, 440):  # models made at these bars, by hand
        learn = np.arange(max(0, t - 150), t)
        m = models.softmax_fit(table[learn, 1:], (table[learn, 0] + 1).astype(int), np.where(table[learn, 0] == 0, 0.8, 1.5))
        np.testing.assert_allclose(got[rows[t][1]], models.softmax_predict(m, table[t : t + 1, 1:])[0], atol=1e-9)
    right = sum(np.argmax(got[row[1]]) - 1 == row[2] for row in rows[80:499])
    assert right > 0.6 * 419


def test_static_models_learn(spark):
    r = random.Random(7)
    rows = [(float(np.sign(round(x := r.gauss(0, 1)))), x, r.random()) for _ in range(400)]
    df = spark.createDataFrame(rows, "target_direction double, f1 double, f2 double")
    for kind in ("logistic", "forest"):
        m = models.fit(df, ["f1", "f2"], kind)
        out = models.predict(m, df, ["f1", "f2"])
        assert out.where("predicted_direction = target_direction").count() > 320
        assert models.importances(m, ["f1", "f2"])["f1"] > 0.7


def test_cleaning_and_checks(spark, bars, tmp_path):
    rows = [("A", datetime(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, None, None, 7.0, 0), ("A", datetime(2024, 1, 1), 1.1, 2.0, 0.5, 1.5, float("inf"), None, 8.0, 1), ("A", datetime(2024, 1, 2), float("nan"), 2.0, 0.5, 1.5, 1.0, 1.0, 1.0, 0)]
    raw = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, OPEN double, high double, low double, close double, volume double, amt double, amount double, seq int")
    got = B.normalise_bars(raw, "seq").collect()
    assert len(got) == 1 and got[0]["open"] == 1.1 and got[0]["volume"] is None and got[0]["amt"] == 8.0
    with pytest.raises(ValueError, match="bars need"):
        B.normalise_bars(raw.drop("close"), "seq")
    assert B.check_bar_size(bars, 30) is bars
    with pytest.raises(ValueError, match="bars of 5 minutes"):
        B.check_bar_size(bars, 5)
    B.write_bars(bars, str(tmp_path / "bars"))
    assert B.read_bars(spark, str(tmp_path / "bars"), ["A"], "2024-01-02 00:00:00", "2024-01-02 12:00:00", strict=True).count() == 25
    with pytest.raises(ValueError, match="no bars"):
        B.read_bars(spark, str(tmp_path / "bars"), ["A", "ZZ"], strict=True)
    (tmp_path / "x_30min_data.csv").write_text("time,Open,High,Low,Close,Volume\n2024-01-01 00:00:00,1,2,0.5,1.5,3\n2024-01-01 00:30:00,oops,2,0.5,1.5,3\n")
    assert [r["symbol"] for r in B.read_bars_csv(spark, [str(tmp_path / "x_30min_data.csv")]).collect()] == ["x"]


def test_settings(tmp_path):
    assert len(config.universe("liquid_commodity")) == 60 and config.universe(" c.dce, C.DCE,m.dce") == ["C.DCE", "M.DCE"]
    s = config.with_values(config.Settings(), {"bar_minutes": 5, "library": {"keep": 0}})
    assert s.bar_minutes == 5 and s.library.keep == 0
    with pytest.raises(ValueError, match="unknown settings"):
        config.with_values(s, {"nope": 1})
    with pytest.raises(RuntimeError):
        sinks.tracked("x", s, str(tmp_path), lambda: (_ for _ in ()).throw(RuntimeError("no")))
    assert '"status": "failed"' in (tmp_path / "manifest.json").read_text() and len(sinks.formulas_hash()) == 16


@pytest.mark.parametrize("kind", ["boosted", "forest", "extra"])
def test_tree_models_learn_what_lines_cannot(kind):
    """A class in two opposite corners: no linear model tells it; unseen classes get 0; gains name the features."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 4))
    y = np.where(x[:, 0] * x[:, 2] > 0, 2, 0)
    s = config.ModelSettings(trees=60, tree_depth=6, boost_rate=0.3)
    m = trees.fit(x[:600], y[:600], np.ones(600), kind, s)
    p = trees.predict(m, x[600:])
    np.testing.assert_allclose(p.sum(1), 1)
    assert (p[:, 1] == 0).all() and (p.argmax(1) == y[600:]).mean() > 0.85
    assert set(np.argsort(-m.shares())[:2]) == {0, 2} and abs(m.shares().sum() - 1) < 1e-9


def test_a_tree_is_the_best_of_all_splits():
    """Depth 1, against every feature and bin by hand."""
    rng = np.random.default_rng(6)
    codes, g, h = rng.integers(0, 6, (80, 3)), rng.normal(size=(80, 1)), rng.random((80, 1)) + 0.1
    feature, cut, value, _ = trees.grow(codes, g, h, 1, rng, lambda n: np.ones((n, 3), bool), 2.0, 0.0, 1.0)
    def gain(f, b):
        side = codes[:, f] <= b
        parts = [(g[m].sum(), h[m].sum()) for m in (side, ~side, side | True)]
        return -np.inf if min(parts[0][1], parts[1][1]) < 1 else 0.5 * sum(k * a * a / (c + 2) for k, (a, c) in zip((1, 1, -1), parts, strict=True))

    best = max(((gain(f, b), -f, -b) for f in range(3) for b in range(6)))
    assert (feature[0], cut[0]) == (-best[1], -best[2])
    side = codes[:, feature[0]] <= cut[0]
    np.testing.assert_allclose(value[:, 0], [-g[m].sum() / (h[m].sum() + 2) for m in (side, ~side)])


def test_single_composite_multi_end_to_end(spark, bars, tmp_path):
    out = str(tmp_path / "run")
    s = config.with_values(config.Settings(), {"library": {"min_sharpe": -1e9, "min_total_return": -1.0, "min_train_sharpe": -1e9, "min_train_total_return": -1.0, "min_train_win_rate": -1.0, "min_selection_win_rate": -1.0},
                                               "model": {"best": 3, "train_window": 120, "min_samples": 80, "min_directional": 10}, "portfolio": {"min_samples": 10, "window": 60}})
    library = cli.single(spark, s, bars, {"momentum", "reversal", "volume_confirm"}, out)
    assert library.where("status = 'active'").count() >= 2
    assert cli.composed(spark, s, bars, out).where("position <> 0").count() > 0
    table = lambda name: spark.read.parquet(f"{out}/{name}")
    compared = table("model_comparison")
    assert {(r["model"], r["segment"]) for r in compared.where("status = 'ok'").collect()} >= {(m, p) for m in ("rolling_boosted", "rolling_logistic", "equal_vote_benchmark") for p in ("validation", "test")}
    assert all(abs(r["s"] - 1) < 1e-9 for r in table("factor_contribution").groupBy("symbol").agg(F.sum("share").alias("s")).collect())
    assert all(table(name).count() > 0 for name in ("family_summary", "active_summary", "factor_gap", "model_gap", "feature_importance", "prediction_diagnostics", "confusion_matrix", "edge_buckets"))
    assert cli.multi(spark, s, out).select("method").distinct().count() == 3


def test_queries_without_sql_have_rows(spark, data):
    for name in sorted(set(Q.QUERIES) - set(Q.SQL)):
        assert Q.QUERIES[name](spark, data).count() > 0, name


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() == 5 and set(df.columns) == {"symbol", *backtest.METRICS}
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_rest_works_without_the_text_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'bars_ohlcv' in e.queries() and not any(n.startswith('op') and '_' in n and n[2].isdigit() for n in e.queries()); assert 'barloom.llm' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_cached_tables_are_made_anew_when_their_fingerprint_changes(spark, tmp_path):
    made = []
    make = lambda n: lambda: made.append(n) or spark.range(n)
    path = str(tmp_path / "table")
    assert B.cached(spark, path, make(3), "a").count() == 3 and B.cached(spark, path, make(4), "a").count() == 3
    assert B.cached(spark, path, make(5), "b").count() == 5 and made == [3, 5]
