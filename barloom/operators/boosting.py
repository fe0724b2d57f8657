"""One boosted model of all symbols' bars, whatever their number: every level of its trees is one pass of histograms.

Cuts come from quantile sketches. Bars are packed into blocks of bin codes, written once. For each level the tasks sum the
gradients and weights of their bars by class, node, feature and bin; the tables are added up as a tree, and the driver
adds the last FAN of them and chooses the splits; a table's size is that of the model and not of the data. The trees of a round's three
classes grow together; the newest bars stay out and say when to stop, in the pass that the next round begins with. Bars'
margins follow from the trees; every KEEP rounds they are written beside the codes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..config import ModelSettings
from ..sources.sinks import saved
from . import trees
from .models import CLASSES
from .pairs import packed, unpacked

#: Rounds between two writes of the margins; tables that one task adds up.
KEEP, FAN = 16, 16
BLOCKS = "n int, codes binary, class binary, weight binary, id binary, held binary, margin binary"


def sketched(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Approximate quantiles of each feature, by one aggregation."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = rows.agg(*[F.percentile_approx(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), shares, 20 * bins).alias(c) for c in features]).first()
    return [np.unique(np.array(found[c] or [0.0])) for c in features]


def _pack(features: list[str], edges: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([np.nan_to_num(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in features])
            cell = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            row = [batch.num_rows, trees.binned(x, edges).astype(np.int16), cell("class").astype(np.int8), cell("weight").astype(float), cell("id").astype(np.int64), cell("held").astype(np.int8), np.zeros((batch.num_rows, 3))]
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *[pa.array([packed(a)], pa.binary()) for a in row[1:]]], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return run


def _blocks(batches, wide: int):
    """(codes, class, weight, id, held, margin) of each block."""
    for batch in batches:
        tab = pa.Table.from_batches([batch])
        for i in range(tab.num_rows):
            of = lambda name, kind, i=i: unpacked(tab[name][i].as_py(), kind)
            yield of("codes", np.int16).reshape(-1, wide).astype(np.int64), of("class", np.int8).astype(np.int64), of("weight", np.float64), of("id", np.int64), of("held", np.int8) > 0, of("margin", np.float64).reshape(-1, 3)


def _add(codes: np.ndarray, margin: np.ndarray, grown: list) -> np.ndarray:
    return sum((value[trees.leaves(codes, feature, cut)] for feature, cut, value in grown), margin.copy())


def taken(ids: np.ndarray, turn: int, share: float) -> np.ndarray:
    """The bars of a round: a share of all, by a hash of bar and round."""
    x = ids.astype(np.uint64) ^ np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) * 2.0**-53 < share


def _sums(blocks: DataFrame, wide: int, bins: int, grown: list, feature: np.ndarray, cut: np.ndarray, level: int, turn: int, seen: np.ndarray, s: ModelSettings, parts: int) -> np.ndarray:
    """The pass of a level: tables (gradients, weights) by class, node, feature and bin; then the loss and number of the bars that stay out."""
    classes, nodes, first = np.flatnonzero(seen), 2**level, 2**level - 1
    cells = len(classes) * nodes * wide * bins

    def run(batches):
        total = np.zeros(2 * cells + 2)
        for codes, y, weight, ids, held, margin in _blocks(batches, wide):
            p = trees.softmax(_add(codes, margin, grown), seen)
            if held.any():
                total[-2:] += -np.log(np.maximum(p[held, y[held]], 1e-15)).sum(), held.sum()
            rows = np.flatnonzero(~held & taken(ids, turn, s.boost_rows))
            codes, p, w = codes[rows], p[rows], weight[rows]
            place = codes + np.arange(wide) * bins
            for i, k in enumerate(classes):
                g, h = (p[:, k] - (y[rows] == k)) * w, np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16) * w
                node = np.zeros(len(rows), np.int64)
                for _ in range(level):
                    f = feature[i, node]
                    node = 2 * node + 1 + ((f >= 0) & (codes[np.arange(len(rows)), f] > cut[i, node]))
                at = (((i * nodes + node - first) * wide * bins)[:, None] + place).ravel()
                for part, v in ((slice(0, cells), g), (slice(cells, 2 * cells), h)):
                    total[part] += np.bincount(at, np.repeat(v, wide), cells)
        yield pa.RecordBatch.from_arrays([pa.array([packed(total)], pa.binary())], names=["sums"])

    def add(part: pa.Table) -> pa.Table:
        total = 0.0
        for x in part["sums"]:
            total = total + unpacked(x.as_py())
        return part.select(["part"]).slice(0, 1).append_column("sums", pa.array([packed(total)], pa.binary()))

    found = blocks.mapInArrow(run, "sums binary")
    while parts > FAN:
        parts = -(-parts // FAN)
        found = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(add, "part int, sums binary")
    return sum(unpacked(x.as_py()) for x in found.select("sums").toArrow()["sums"])


def fit_pooled(rows: DataFrame, features: list[str], s: ModelSettings = ModelSettings(), seed: int = 42, edges: list[np.ndarray] | None = None) -> trees.Trees:
    """A boosted model of all rows with a label. rows: symbol, ts, target_direction, features (missing ones are 0)."""
    rng, wide = np.random.default_rng(seed), len(features)
    rows = rows.where("target_direction IS NOT NULL")
    edges = edges if edges is not None else sketched(rows, features, s.boost_bins)
    bins = max(len(e) for e in edges) + 1
    late = F.unix_micros(F.col("ts").cast("timestamp"))
    cut_at = rows.agg(F.percentile_approx(late, F.lit(1 - s.early_share), F.lit(10_000)).alias("t")).first()["t"] if s.early_rounds > 0 else None
    weight = F.when(F.col("target_direction") == 0, s.neutral_weight).otherwise(s.directional_weight)
    table = rows.select(*features, (F.col("target_direction") + 1).cast("int").alias("class"), weight.alias("weight"), F.xxhash64("symbol", "ts").alias("id"), ((late > cut_at) if cut_at is not None else F.lit(False)).cast("int").alias("held"))
    blocks = saved(table.mapInArrow(_pack(features, edges), BLOCKS))
    there = {r["class"]: r["held"] for r in table.groupBy("class").agg(F.min("held").alias("held")).collect()}
    seen = np.array([k in there for k in range(3)])
    if not seen.any():
        raise ValueError("no labels")
    parts = blocks.rdd.getNumPartitions()
    grown, recent, gain, best, best_at = [], [], np.zeros(wide), np.inf, -1
    size = 2**s.boost_depth - 1
    for turn in range(s.boost_rounds + 1):
        feature, cut = np.full((seen.sum(), size), -1), np.zeros((seen.sum(), size), np.int64)
        chosen = np.zeros(wide, bool)
        chosen[rng.permutation(wide)[: max(1, round(wide * s.boost_columns))]] = True
        value = np.zeros((seen.sum(), size + 1))
        gained = np.zeros(wide)
        for level in range(s.boost_depth):
            sums = _sums(blocks, wide, bins, recent, feature, cut, level, turn, seen, s, parts)
            if level == 0 and turn and sums[-1]:  # the loss of the rounds so far
                loss = sums[-2] / sums[-1]
                if loss < best:
                    best, best_at = loss, turn
                elif turn - best_at >= s.early_rounds:
                    return trees.Trees(edges, grown[: best_at * int(seen.sum())], True, seen, gain)
            if turn == s.boost_rounds:
                break
            tables = sums[:-2].reshape(2, seen.sum(), 2**level, wide, bins)
            value = _split(tables, feature, cut, gained, 2**level - 1, chosen, s)
        if turn == s.boost_rounds:
            break
        for i, k in enumerate(np.flatnonzero(seen)):
            step = np.zeros((size + 1, 3))
            step[:, k] = s.boost_rate * value[i]
            recent.append((feature[i], cut[i], step))
            grown.append((feature[i], cut[i], step))
        gain += gained
        if (turn + 1) % KEEP == 0:
            blocks, recent = saved(_with_margins(blocks, wide, recent)), []
    stop = best_at if best_at > 0 and s.early_rounds > 0 else s.boost_rounds
    return trees.Trees(edges, grown[: stop * int(seen.sum())], True, seen, gain)


def _split(tables: np.ndarray, feature: np.ndarray, cut: np.ndarray, gained: np.ndarray, first: int, chosen: np.ndarray, s: ModelSettings) -> np.ndarray:
    """The best splits of a level, put into feature and cut, and what the two sides of each node would be worth as leaves."""
    many, nodes, wide, bins = tables.shape[1:]
    left, whole = tables.cumsum(-1), tables.sum(-1, keepdims=True)
    right = whole - left
    score = lambda t: t[0] ** 2 / np.maximum(t[1] + s.boost_ridge, 1e-12)
    gain = 0.5 * (score(left) + score(right) - score(whole))
    gain[(left[1] < s.boost_least) | (right[1] < s.boost_least)] = -np.inf
    gain[:, :, ~chosen] = -np.inf
    flat = gain.reshape(many, nodes, -1)
    best = flat.argmax(2)
    top = np.take_along_axis(flat, best[..., None], 2)[..., 0]
    split = top > s.boost_gain
    feature[:, first : first + nodes], cut[:, first : first + nodes] = np.where(split, best // bins, -1), best % bins
    np.add.at(gained, (best // bins)[split], top[split])
    pick = lambda t: np.take_along_axis(t.reshape(2, many, nodes, -1), best[None, ..., None], 3)[..., 0]
    every = whole[:, :, :, 0, 0]
    sides = np.stack([np.where(split, pick(left), every), np.where(split, pick(right), 0.0)], -1).reshape(2, many, -1)
    return -sides[0] / np.maximum(sides[1] + s.boost_ridge, 1e-12)


def _with_margins(blocks: DataFrame, wide: int, grown: list) -> DataFrame:
    def run(batches):
        for batch in batches:
            margins = [packed(_add(codes, margin, grown)) for codes, _, _, _, _, margin in _blocks([batch], wide)]
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margins, pa.binary()))

    return blocks.mapInArrow(run, BLOCKS)


def predict_pooled(model: trees.Trees, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with prob_down, prob_flat, prob_up."""

    def run(batches):
        for batch in batches:
            tab = pa.Table.from_batches([batch])
            x = np.column_stack([np.nan_to_num(tab[c].cast(pa.float64()).to_numpy()) for c in features])
            p = trees.predict(model, x) if len(x) else np.zeros((0, 3))
            for name, k in CLASSES:
                tab = tab.append_column(name, pa.array(p[:, k]))
            yield from tab.to_batches()

    return rows.mapInArrow(run, StructType([*rows.schema, *[StructField(name, DoubleType()) for name, _ in CLASSES]]))
