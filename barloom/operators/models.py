"""Three-class models: fitted on a segment with MLlib, or refitted on a rolling window in many tasks.

Rolling: bars are numbered; a model made at bar t predicts the next `retrain_every` bars from the window before t. The
models of different times don't depend on each other, so a task takes a stretch of EPOCHS of them with the window of bars
before it: bars are copied about twice, and no task holds a whole history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ModelSettings
from . import trees, walkforward
from .composite import sample_weight
from .walkforward import WindowMoments, choose

EPOCHS = 48
#: Labels -1, 0, 1 as classes 0, 1, 2.
CLASSES = (("prob_down", 0), ("prob_flat", 1), ("prob_up", 2))


def _prepared(rows: DataFrame, features: list[str], s: ModelSettings) -> DataFrame:
    filled = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    return filled.withColumn("label", F.col("target_direction") + 1).withColumn("weight", sample_weight(F.col("target_direction"), s.directional_weight, s.neutral_weight))


def fit(train: DataFrame, features: list[str], kind: str = "logistic", s: ModelSettings = ModelSettings(), seed: int = 42):
    """An MLlib pipeline over the features (missing ones are 0). kind: logistic or forest."""
    rows = _prepared(train, features, s).where("label IS NOT NULL AND weight > 0")
    assemble = VectorAssembler(inputCols=features, outputCol="raw")
    if kind == "logistic":
        steps = [assemble, StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", weightCol="weight", family="multinomial", regParam=1e-3, maxIter=100)]
    elif kind == "forest":
        steps = [assemble, RandomForestClassifier(featuresCol="raw", weightCol="weight", numTrees=s.trees, maxDepth=s.tree_depth, seed=seed)]
    else:
        raise ValueError("kind is logistic or forest")
    return Pipeline(stages=steps).fit(rows)


def predict(model, rows: DataFrame, features: list[str], s: ModelSettings = ModelSettings()) -> DataFrame:
    """rows with prob_down, prob_flat, prob_up and predicted_direction; classes that training never saw have probability 0."""
    out = model.transform(_prepared(rows, features, s)).withColumn("_p", vector_to_array("probability"))
    out = out.withColumns({name: F.coalesce(F.try_element_at("_p", F.lit(k + 1)), F.lit(0.0)) for name, k in CLASSES})
    return out.select(*rows.columns, *[name for name, _ in CLASSES], (F.col("prediction") - 1).alias("predicted_direction"))


def importances(model, features: list[str]) -> dict[str, float]:
    """Share of each feature: a forest's gains, or mean absolute coefficients."""
    last = model.stages[-1]
    raw = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficientMatrix.toArray()).mean(0)
    total = float(raw.sum())
    return {f: float(x) / total if total else 1 / len(features) for f, x in zip(features, raw, strict=True)}


def softmax_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 60):
    """Multinomial logistic regression with a ridge, by gradient steps with momentum on standardised features."""
    mean, std = x.mean(0), x.std(0)
    z = np.column_stack([(x - mean) / np.where(std > 0, std, 1.0), np.ones(len(x))])
    target = np.eye(3)[y] * weight[:, None]
    seen = np.isin(np.arange(3), y)
    w = np.zeros((z.shape[1], 3))
    step, velocity = 1.0 / (0.5 * (weight[:, None] * z * z).sum() / z.shape[1] * 2 + ridge), np.zeros_like(w)
    for _ in range(steps):
        p = z @ (w + 0.9 * velocity)
        p = np.where(seen, p, -np.inf)
        p = np.exp(p - p.max(1, keepdims=True))
        p *= (weight / p.sum(1))[:, None]
        g = z.T @ (p - target)
        g[:-1] += ridge * w[:-1]
        velocity = 0.9 * velocity - step * g
        w = w + velocity
    return mean, std, w, seen


def softmax_predict(model, x: np.ndarray) -> np.ndarray:
    mean, std, w, seen = model
    p = np.column_stack([(x - mean) / np.where(std > 0, std, 1.0), np.ones(len(x))]) @ w
    p = np.where(seen, p, -np.inf)
    p = np.exp(p - p.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def weight_shares(model) -> np.ndarray:
    size = np.abs(model[2][:-1][:, model[3]]).mean(1)
    return size / size.sum() if size.sum() > 0 else np.full(len(size), 1 / len(size))


def rolling_predictions(
    rows: DataFrame, features: list[str], s: ModelSettings = ModelSettings(), keys: tuple[str, ...] = ("symbol",), importance: bool = False, kind: str = "logistic",
    factors: dict[str, list[str]] | None = None, calibrate: bool = False,
) -> DataFrame:
    """(keys, ts, prob_down, prob_flat, prob_up) of bars from min_samples on. rows: features, target_direction, by key and time.

    A model made at bar t learns from labelled bars of [t - train_window, t - horizon]: their labels end before t. With
    too few bars, directional labels or classes no model is made and the bars of its turn have no prediction. importance:
    the first bar of a model's turn also holds the features' shares of its mean absolute weights or of its splits' gains.
    kind: logistic, boosted, forest or extra.

    factors: the feature columns of each factor, by the column of the factor's signal. With select_in_window each model
    takes the factors that its window's labelled bars choose (`selected` on the first bar of its turn), else all; the
    factors' equal vote, its direction learned from the window, is `vote_score`. calibrate: rows also hold next_return and
    trade_allowed, and min_edge, min_probability and direction are learned from the window's predictions too.
    train_market_filter: models learn from bars with trade_allowed only.
    """
    if kind not in ("logistic", "boosted", "forest", "extra"):
        raise ValueError("kind is logistic, boosted, forest or extra")
    first, k, w, h = s.min_samples, s.retrain_every, s.train_window, s.horizon
    span = EPOCHS * k
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1
    placed = rows.withColumn("_row", place)
    own = F.floor((F.col("_row") - first) / span)  # the stretch that predicts the bar; below 0: none
    reach = F.floor((F.col("_row") + w - first) / span)  # the last stretch whose windows reach back to it
    each = placed.withColumn("_stretch", F.explode(F.sequence(F.greatest(own, F.lit(0)), F.greatest(reach, own, F.lit(0))))).withColumn("_own", F.col("_stretch") == own)
    signals = list(factors or {})
    if s.select_in_window and not signals:
        raise ValueError("to choose factors takes their signals")
    told = ["min_edge", "min_probability", "direction"] * calibrate + ["vote_score"] * bool(signals)
    extra = [*(f"{c} double" for c in told), *(["importance array<double>"] if importance else []), *(["selected array<string>"] if s.select_in_window else [])]
    schema = ", ".join([*[f"{c} {dict(rows.dtypes)[c]}" for c in keys], "ts timestamp_ntz", *[f"{name} double" for name, _ in CLASSES], *extra])
    of = [[features.index(c) for c in (factors or {})[x]] for x in signals]
    market = ["next_return", "trade_allowed"] if calibrate else ["trade_allowed"] if s.train_market_filter else []

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_row", ignore_index=True)
        at, x = part["_row"].to_numpy(), part[features].fillna(0.0).to_numpy(float)
        y = part["target_direction"].to_numpy(float)
        labelled = np.isfinite(y)
        allowed = part["trade_allowed"].fillna(0.0).to_numpy(float) > 0 if market else np.ones(len(part), bool)
        ahead = part["next_return"].to_numpy(float) if calibrate else None
        signal = part[signals].to_numpy(float) if signals else None
        weight = np.where(y == 0, s.neutral_weight, s.directional_weight)
        window = WindowMoments(np.where(labelled[:, None], np.column_stack([signal, y]), np.nan)) if s.select_in_window else None
        out, shares, picked = np.full((len(part), 3), np.nan), np.full(len(part), None, object), np.full(len(part), None, object)
        more = {c: np.full(len(part), np.nan) for c in told}
        begin = first + int(key[-1]) * span
        for t in range(begin, begin + span, k):
            turn = part["_own"].to_numpy() & (at >= t) & (at < t + k)
            if not turn.any():
                continue
            low, high = np.searchsorted(at, (t - w, t - h + 1))
            taken = list(range(len(signals)))
            if window is not None:
                taken = choose(*window.correlations(low, max(low, high)), s)
            use = [i for f in taken for i in of[f]] if signals else list(range(len(features)))
            learn = labelled & (at >= t - w) & (at < t - h + 1) & (allowed | (not s.train_market_filter))
            if not use or learn.sum() < s.min_samples or (y[learn] != 0).sum() < s.min_directional or len(np.unique(y[learn])) < 2:
                continue
            seen = x[np.ix_(learn, use)], (y[learn] + 1).astype(int), weight[learn] * walkforward.age_weight(t - at[learn], s.half_life)
            model = softmax_fit(*seen) if kind == "logistic" else trees.fit(*seen, kind, s)
            chances = softmax_predict if kind == "logistic" else trees.predict
            out[turn] = chances(model, x[np.ix_(turn, use)])
            head = turn.argmax()
            if importance:
                share = np.zeros(len(features))
                share[use] = weight_shares(model) if kind == "logistic" else model.shares()
                shares[head] = list(share)
            if window is not None:
                picked[head] = [signals[i] for i in taken]
            if calibrate:
                found = walkforward.calibrate(chances(model, seen[0]), ahead[learn], allowed[learn], s)
                for c, v in zip(told, found, strict=False):
                    more[c][turn] = v
            if signals:
                score = walkforward.mean_of(signal[:, taken])
                side = walkforward.way(np.where(allowed[learn], np.sign(np.nan_to_num(score[learn])), 0.0), ahead[learn]) if calibrate else 1.0
                more["vote_score"][turn] = side * score[turn]
        done = np.isfinite(out[:, 0])
        cells = {c: part[c][done] for c in [*keys, "ts"]} | {name: out[done, i] for name, i in CLASSES} | {c: v[done] for c, v in more.items()}
        return pd.DataFrame(cells | ({"importance": shares[done]} if importance else {}) | ({"selected": picked[done]} if s.select_in_window else {}))

    want = each.select(*keys, "ts", "_row", "_own", "_stretch", "target_direction", *market, *dict.fromkeys([*features, *signals]))
    return want.groupBy(*keys, "_stretch").applyInPandas(run, schema)
