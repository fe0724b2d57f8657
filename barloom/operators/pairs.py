"""Correlations of many factors: tiles of columns, multiplied pair by pair of tiles, summed over spans of time.

A factor is a column of its key's matrix. Columns are dealt to tiles of TILE, bars to spans of time; a tile's bars of one
span are one packed row. Two tiles of a span meet in one task, whose matrix products give the sums of all their pairs at
once; these are added up over the spans. A task holds two tiles of one span, or the sums of one pair of tiles, however many
factors there are, and no row meets another in a join.

Where only correlations from a threshold on are wanted, sketches may rule pairs out first: each bar gets SIGNS random signs,
and the products of a factor's standardised values with them make a short vector whose inner products are the correlations
within a standard error of 1 / sqrt(SIGNS). Tiles whose pairs are all MARGIN such errors below the threshold are never
multiplied (a pair is missed with a chance of about 1e-7). The rule is for factors that have values
on COMPLETE of their key's bars; all others are multiplied exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import saved

TILE, SIGNS, MARGIN, COMPLETE = 128, 256, 5.0, 0.98
#: Of the sum of squares: less than this is rounding, not spread.
FLAT = 1e-12
SPAN = "quarter"


def packed(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(b: bytes, dtype=np.float64) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), dtype)


def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Six tables for the columns of x against those of y, over rows where both have a value: n, sums of x, y, xx, yy, xy."""
    a, b = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
    x, y = np.nan_to_num(x), np.nan_to_num(y)
    return np.stack([a.T @ b, x.T @ b, a.T @ y, (x * x).T @ b, a.T @ (y * y), x.T @ y])


def correlation(t: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """From the six tables; NaN where a side does not vary. of: larger sums that these are differences of, whose rounding they carry."""
    n, sx, sy, sxx, syy, sxy = t
    flat_x, flat_y = (sxx, syy) if of is None else (of[3], of[4])
    with np.errstate(all="ignore"):
        dx, dy = sxx - sx * sx / n, syy - sy * sy / n
        r = np.clip((sxy - sx * sy / n) / np.sqrt(dx * dy), -1.0, 1.0)
        return np.where((n >= 2) & (dx > FLAT * flat_x) & (dy > FLAT * flat_y), r, np.nan)


def columns_of(times: np.ndarray, col: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The times in order, and a matrix of a row for each of them; NaN where a column has no value."""
    at, row = np.unique(times, return_inverse=True)
    x = np.full((len(at), width), np.nan)
    x[row, col] = value
    return at, x


def types(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def numbered(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, factor, no): places of a key's factors by name, so that like names share tiles."""
    listed = values.select(*keys, "factor").distinct()
    return listed.withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy("factor")) - 1)


def tiles_of(values: DataFrame, listed: DataFrame, keys: list[str], value: str, bucket: Column, tile: int = TILE) -> DataFrame:
    """(keys, bucket, tile, n, times, cells): a tile's bars of one span, packed."""
    rows = values.where(F.col(value).isNotNull()).join(listed, [*keys, "factor"])
    rows = rows.select(*keys, bucket.alias("bucket"), F.expr(f"CAST(no DIV {tile} AS INT)").alias("tile"), (F.col("no") % tile).cast("int").alias("col"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col(value).cast("double").alias("v"))

    def pack(part: pa.Table) -> pa.Table:
        at, x = columns_of(part["at"].to_numpy(), part["col"].to_numpy(), part["v"].to_numpy(), tile)
        head = part.select([*keys, "bucket", "tile"]).slice(0, 1)
        return head.append_column("times", pa.array([packed(at)], pa.binary())).append_column("cells", pa.array([packed(x)], pa.binary()))

    return rows.groupBy(*keys, "bucket", "tile").applyInArrow(pack, f"{types(rows, [*keys, 'bucket'])}, tile int, times binary, cells binary")


def _matrix(tab: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    at = unpacked(tab["times"][0].as_py(), np.int64)
    return at, unpacked(tab["cells"][0].as_py()).reshape(len(at), -1)


def _row(head: pa.Table, name: str, data: np.ndarray) -> pa.Table:
    return head.append_column(name, pa.array([packed(data)], pa.binary()))


def summed(sums: DataFrame, by: list[str], name: str = "sums") -> DataFrame:
    """Packed tables of the same shape, added up."""

    def add(part: pa.Table) -> pa.Table:
        total = 0.0
        for x in part[name]:
            total = total + unpacked(x.as_py())
        return _row(part.select(by).slice(0, 1), name, total)

    return sums.groupBy(*by).applyInArrow(add, f"{types(sums, by)}, {name} binary")


def correlations(values: DataFrame, keys: list[str], value: str = "value", bucket: Column | None = None, at_least: float | None = None, screen: bool = False, tile: int = TILE, complete: float = COMPLETE) -> DataFrame:
    """(keys, factor_a, factor_b, corr): over the bars where both factors have a value, factor_a < factor_b.

    at_least: only pairs whose absolute correlation is at least this. screen: rule pairs out by sketches first.
    """
    if screen and at_least is None:
        raise ValueError("sketches need a threshold")
    bucket = bucket if bucket is not None else F.date_trunc(SPAN, F.col("ts").cast("timestamp"))
    listed = saved(numbered(values.where(F.col(value).isNotNull()), keys))
    tiles = tiles_of(values, listed, keys, value, bucket, tile)
    last = listed.groupBy(*keys).agg(F.expr(f"CAST(max(no) DIV {tile} AS INT)").alias("last"))
    if screen:
        tiles = saved(tiles)
        bars = values.where(F.col(value).isNotNull()).select(*keys, "ts").distinct().groupBy(*keys).agg(F.count("*").alias("bars"))
        likely = saved(_likely_tiles(tiles, last.join(bars, keys), keys, at_least, complete))
        left = tiles.withColumnRenamed("tile", "i").join(likely, [*keys, "i"])
        right = tiles.withColumnRenamed("tile", "j").join(likely, [*keys, "j"])
    else:
        tiles = tiles.join(last, keys)
        left = tiles.withColumn("j", F.explode(F.sequence("tile", "last"))).withColumnRenamed("tile", "i")
        right = tiles.withColumn("i", F.explode(F.sequence(F.lit(0), "tile"))).withColumnRenamed("tile", "j")
    pair = [*keys, "i", "j"]

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        head = a.select(pair).slice(0, 1)
        if not a.num_rows or not b.num_rows:  # one tile has no bars in this span
            return head.slice(0, 0).append_column("sums", pa.array([], pa.binary()))
        (at, x), (bt, y) = _matrix(a), _matrix(b)
        _, rows, others = np.intersect1d(at, bt, assume_unique=True, return_indices=True)
        return _row(head, "sums", moments(x[rows], y[others]))

    held = [*pair, "bucket", "times", "cells"]
    parts = left.select(held).groupBy(*pair, "bucket").cogroup(right.select(held).toDF(*held).groupBy(*pair, "bucket"))
    sums = summed(parts.applyInArrow(product, f"{types(tiles, keys)}, i int, j int, sums binary"), pair)

    def told(part: pa.Table) -> pa.Table:
        i, j = part["i"][0].as_py(), part["j"][0].as_py()
        t = unpacked(part["sums"][0].as_py()).reshape(6, tile, tile)
        r = correlation(t)
        a, b = np.nonzero(t[0] > 0) if at_least is None else np.nonzero(np.abs(r) >= at_least)
        keep = i * tile + a < j * tile + b
        a, b = a[keep], b[keep]
        out = {k: pa.array([part[k][0].as_py()] * len(a), part[k].type) for k in keys}
        return pa.table(out | {"a": pa.array(i * tile + a, pa.int32()), "b": pa.array(j * tile + b, pa.int32()), "corr": pa.array(r[a, b], from_pandas=True)})

    found = sums.groupBy(*pair).applyInArrow(told, f"{types(tiles, keys)}, a int, b int, corr double")
    named = lambda c: listed.select(*keys, F.col("no").alias(c), F.col("factor").alias(f"factor_{c}"))
    return found.join(named("a"), [*keys, "a"]).join(named("b"), [*keys, "b"]).select(*keys, "factor_a", "factor_b", "corr")


def signs(times: np.ndarray) -> np.ndarray:
    """Rows of SIGNS random signs, the same for the same time everywhere."""
    x = times.astype(np.uint64)[:, None] * np.uint64(SIGNS // 64) + np.arange(SIGNS // 64, dtype=np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1).astype(float) * 2 - 1


def _likely_tiles(tiles: DataFrame, facts: DataFrame, keys: list[str], at_least: float, complete: float = COMPLETE) -> DataFrame:
    """(keys, i, j): pairs of tiles with a pair of columns that the sketches do not rule out. facts: keys, last tile, bars."""
    head = [*keys, "tile"]

    def sketch(part: pa.Table) -> pa.Table:
        """Of each column: n, sum, sum of squares, products with the signs, sums of the signs over its bars."""
        at, x = _matrix(part)
        have, x, s = (~np.isnan(x)).astype(float), np.nan_to_num(x), signs(at)
        return _row(part.select(head).slice(0, 1), "sums", np.concatenate([np.stack([have.sum(0), x.sum(0), (x * x).sum(0)], 1), x.T @ s, have.T @ s], 1))

    by_span = tiles.groupBy(*head, "bucket").applyInArrow(sketch, f"{types(tiles, keys)}, tile int, sums binary")
    sums = saved(summed(by_span, head)).join(facts, keys)  # half a MB a tile
    left = sums.withColumn("j", F.explode(F.sequence("tile", "last"))).withColumnRenamed("tile", "i")
    right = sums.withColumn("i", F.explode(F.sequence(F.lit(0), "tile"))).withColumnRenamed("tile", "j")
    pair = [*keys, "i", "j"]

    def unit(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Bars of each column, and sketches whose inner products are correlations."""
        d = unpacked(part["sums"][0].as_py()).reshape(-1, 3 + 2 * SIGNS)
        n, sx, sxx = d[:, 0], d[:, 1], d[:, 2]
        v = d[:, 3 : 3 + SIGNS] - (sx / n)[:, None] * d[:, 3 + SIGNS :]
        return n, v / np.sqrt(np.maximum(sxx - sx * sx / n, 0.0) * SIGNS)[:, None]

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            (n, v), (m, w) = unit(a), unit(b)
            whole = np.minimum(n[:, None], m[None, :]) >= complete * a["bars"][0].as_py()
            out = whole & (np.abs(v @ w.T) < at_least - MARGIN / np.sqrt(SIGNS) - 2 * (1 - complete))
        likely = ~out & (n[:, None] > 1) & (m[None, :] > 1)
        if a["i"][0].as_py() == a["j"][0].as_py():
            likely = np.triu(likely, 1)
        return a.select(pair).slice(0, int(likely.any()))

    return left.select(*pair, "bars", "sums").groupBy(*pair).cogroup(right.select(*pair, "sums").toDF(*pair, "sums").groupBy(*pair)).applyInArrow(near, f"{types(tiles, keys)}, i int, j int")
