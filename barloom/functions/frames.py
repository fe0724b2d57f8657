"""Moving functions over ROWS frames, and how nested ones become few passes.

Spark takes no window function inside another. A Term therefore knows how many window passes lie below it: the argument
of a moving function is held as a column of its own, and apply() adds the columns pass by pass. Equal functions of equal
arguments are one column, and all functions of a pass share one partitioning and order, so each pass is one Window
operator and all of them need one exchange together. Over bars that are cut into blocks, the moving functions of a pass
are worked out on the blocks' arrays instead (kernels.py): a Window operator starts anew for every row's frame.

Missing values are NULL, never NaN. A moving function is NULL until `least` values that are not missing lie in its frame
(by default all of them). Every division gives NULL where the divisor is 0.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from . import kernels


class Term:
    """A value per row: SQL over the columns that exist after `depth` window passes."""

    __slots__ = ("sql", "depth")

    def __init__(self, sql: str, depth: int = 0):
        self.sql, self.depth = sql, depth

    def _with(self, form: str, other, swap: bool = False) -> Term:
        a, b = (term(other), self) if swap else (self, term(other))
        return Term(form.format(a.sql, b.sql), max(a.depth, b.depth))

    def __add__(self, other):
        return self._with("({} + {})", other)

    def __radd__(self, other):
        return self._with("({} + {})", other, True)

    def __sub__(self, other):
        return self._with("({} - {})", other)

    def __rsub__(self, other):
        return self._with("({} - {})", other, True)

    def __mul__(self, other):
        return self._with("({} * {})", other)

    def __rmul__(self, other):
        return self._with("({} * {})", other, True)

    def __truediv__(self, other):
        return self._with("({} / nullif({}, 0D))", other)

    def __rtruediv__(self, other):
        return self._with("({} / nullif({}, 0D))", other, True)

    def __neg__(self):
        return Term(f"(- {self.sql})", self.depth)

    def __gt__(self, other):
        return self._with("({} > {})", other)

    def __ge__(self, other):
        return self._with("({} >= {})", other)

    def __lt__(self, other):
        return self._with("({} < {})", other)

    def __le__(self, other):
        return self._with("({} <= {})", other)

    def __and__(self, other):
        return self._with("({} AND {})", other)

    def __or__(self, other):
        return self._with("({} OR {})", other)

    def is_(self, other):
        return self._with("({} = {})", other)


def term(x) -> Term:
    if isinstance(x, Term):
        return x
    return Term(f"{float(x)!r}D") if isinstance(x, int | float) else Term(x)


def call(function: str, *xs) -> Term:
    xs = [term(x) for x in xs]
    return Term(f"{function}({', '.join(x.sql for x in xs)})", max(x.depth for x in xs))


# row by row


def absolute(x):
    return call("abs", x)


def sign(x):
    return call("signum", x)


def sign0(x):
    return call("coalesce", sign(x), 0)


def fill0(x):
    return call("coalesce", x, 0)


def nz(x):
    """NULL for 0."""
    return call("nullif", x, 0)


def log(x):
    return call("ln", nz(x))


def greatest(*xs):
    return call("greatest", *xs)


def least_of(*xs):
    return call("least", *xs)


def pick(condition, yes, no) -> Term:
    """yes where the condition holds; no where it does not or is NULL."""
    c, a, b = term(condition), term(yes), term(no)
    return Term(f"(CASE WHEN {c.sql} THEN {a.sql} ELSE {b.sql} END)", max(c.depth, a.depth, b.depth))


def num(condition) -> Term:
    return pick(condition, 1, 0)


def positive(x):
    return pick(term(x) > 0, x, 0)


def negative(x):
    return pick(term(x) < 0, x, 0)


def clipped(x, low: float, high: float) -> Term:
    """Between low and high; NULL stays NULL (greatest and least would skip it)."""
    x = term(x)
    return Term(f"(CASE WHEN {x.sql} IS NOT NULL THEN greatest({low!r}D, least({high!r}D, {x.sql})) END)", x.depth)


class Frames:
    """Terms over bars that are partitioned by keys and ordered by time."""

    def __init__(self, keys: tuple[str, ...] = ("symbol",), order: str = "ts"):
        self.keys, self.order = keys, order
        self.scalars: dict[int, dict[str, str]] = defaultdict(dict)
        self.windows: dict[int, dict[str, str]] = defaultdict(dict)
        self.decays: dict[int, dict[tuple[str, int, int], str]] = defaultdict(dict)
        self.totals: dict[int, dict[str, str]] = defaultdict(dict)
        self.frames: dict[int, dict[tuple[str, int, tuple[str, ...]], str]] = defaultdict(dict)
        self.carries: dict[int, dict[str, str]] = defaultdict(dict)
        self.blocks = "block" in keys

    @staticmethod
    def _named(table: dict, what, prefix: str) -> str:
        return table.setdefault(what, f"{prefix}_{len(table)}")

    def held(self, x: Term) -> str:
        """The column that holds the term's value."""
        return x.sql if re.fullmatch(r"\w+", x.sql) else self._named(self.scalars[x.depth], x.sql, f"_s{x.depth}")

    def over(self, template: str, rows: str, *xs: Term) -> Term:
        depth = max(x.depth for x in xs) + 1
        by = f"PARTITION BY {', '.join(self.keys)} ORDER BY {self.order}"
        sql = f"{template.format(*map(self.held, xs))} OVER ({by}{rows and f' ROWS BETWEEN {rows}'})"
        return Term(self._named(self.windows[depth], sql, f"_w{depth}"), depth)

    def moving(self, template: str, w: int, least: int | None, *xs: Term) -> Term:
        """The aggregate over w rows, where the first argument has enough values."""
        n, value = self.framed("count({0})", w, xs[0]), self.framed(template, w, *xs)
        return Term(f"(CASE WHEN {n.sql} >= {w if least is None else least} THEN {value.sql} END)", value.depth)

    def framed(self, template: str, w: int, *xs: Term) -> Term:
        """The aggregate over w rows: by kernels over blocks, else by a Window."""
        if not self.blocks or not kernels.known(template):
            return self.over(template, f"{w - 1} PRECEDING AND CURRENT ROW", *xs)
        depth = max(x.depth for x in xs) + 1
        return Term(self._named(self.frames[depth], (template, w, tuple(map(self.held, xs))), f"_k{depth}"), depth)

    # moving functions

    def count(self, x, w: int) -> Term:
        return self.framed("count({0})", w, term(x))

    def mean(self, x, w: int, least: int | None = None) -> Term:
        return self.moving("avg({})", w, least, term(x))

    def total(self, x, w: int, least: int | None = None) -> Term:
        return self.moving("sum({})", w, least, term(x))

    def std(self, x, w: int, least: int | None = None) -> Term:
        return self.moving("stddev_samp({})", w, least, term(x))

    def var(self, x, w: int, least: int | None = None) -> Term:
        return self.moving("var_samp({})", w, least, term(x))

    def peak(self, x, w: int, least: int | None = None) -> Term:
        return self.moving("max({})", w, least, term(x))

    def trough(self, x, w: int, least: int | None = None) -> Term:
        return self.moving("min({})", w, least, term(x))

    def quantile(self, x, w: int, q: float, least: int | None = None) -> Term:
        """Linear between the two nearest values."""
        return self.moving(f"percentile({{}}, {q!r}D)", w, least, term(x))

    def quantiles(self, x, w: int, shares: list[float], least: int | None = None) -> Term:
        """Several of them as an array: the frame is sorted once."""
        return self.moving(f"percentile({{}}, array({', '.join(f'{q!r}D' for q in shares)}))", w, least, term(x))

    def median(self, x, w: int, least: int | None = None) -> Term:
        return self.quantile(x, w, 0.5, least)

    def rank(self, x, w: int, least: int | None = None) -> Term:
        """The current value's average rank among the frame's values, as a share."""
        x = term(x)
        if self.blocks:
            return self.moving("pct_rank({})", w, least, x)
        a, now = self.over("collect_list({})", f"{w - 1} PRECEDING AND CURRENT ROW", x), self.held(x)
        below, same = f"size(filter({a.sql}, e -> e < {now}))", f"size(filter({a.sql}, e -> e = {now}))"
        guard = f"size({a.sql}) >= {w if least is None else least} AND {now} IS NOT NULL"
        return Term(f"(CASE WHEN {guard} THEN ({below} + ({same} + 1) / 2D) / size({a.sql}) END)", a.depth)

    def _moment(self, function: str, x, w: int, least: int | None, few: int, form: str, flat: float) -> Term:
        x = term(x)
        value, n, low, high = self.moving(f"{function}({{}})", w, least, x), self.count(x, w), self.trough(x, w, least), self.peak(x, w, least)
        return Term(f"(CASE WHEN {n.sql} < {few} THEN NULL WHEN {low.sql} = {high.sql} THEN {flat!r}D ELSE {form.format(m=value.sql, n=n.sql)} END)", value.depth)

    def skew(self, x, w: int, least: int | None = None) -> Term:
        """Bias-corrected; 0 for a constant frame."""
        return self._moment("skewness", x, w, least, 3, "{m} * sqrt({n} * ({n} - 1D)) / ({n} - 2D)", 0.0)

    def kurt(self, x, w: int, least: int | None = None) -> Term:
        """Bias-corrected excess; -3 for a constant frame."""
        return self._moment("kurtosis", x, w, least, 4, "(({n} + 1D) * {m} + 6D) * ({n} - 1D) / (({n} - 2D) * ({n} - 3D))", -3.0)

    @staticmethod
    def _both(x, y) -> tuple[Term, Term]:
        x, y = term(x), term(y)
        depth = max(x.depth, y.depth)
        return Term(f"(CASE WHEN {y.sql} IS NOT NULL THEN {x.sql} END)", depth), Term(f"(CASE WHEN {x.sql} IS NOT NULL THEN {y.sql} END)", depth)

    def cov(self, x, y, w: int, least: int | None = None) -> Term:
        return self.moving("covar_samp({}, {})", w, least, *self._both(x, y))

    def corr(self, x, y, w: int, least: int | None = None) -> Term:
        """Over rows where both are present; NULL if one of them is constant."""
        x, y = self._both(x, y)
        return self.moving("covar_samp({}, {})", w, least, x, y) / (self.std(x, w, least) * self.std(y, w, least))

    def ewm(self, x, span: int, least: int) -> Term:
        """Exponentially weighted mean, weight 2 / (span + 1) on the newest value; gaps let older weights decay."""
        x = term(x)
        depth = x.depth + 1
        return Term(self._named(self.decays[depth], (self.held(x), span, least), f"_e{depth}"), depth)

    # functions of earlier rows

    def lag(self, x, n: int = 1) -> Term:
        return self.over(f"lag({{}}, {n})", "", term(x))

    def lead(self, x, n: int = 1) -> Term:
        return self.over(f"lead({{}}, {n})", "", term(x))

    def diff(self, x, n: int = 1) -> Term:
        x = term(x)
        return x - self.lag(x, n)

    def last(self, x, n: int = 0) -> Term:
        """The last value that is not missing, n rows ago or earlier."""
        x = term(x)
        value = self.over("last({}, true)", f"UNBOUNDED PRECEDING AND {f'{n} PRECEDING' if n else 'CURRENT ROW'}", x)
        if not self.blocks:
            return value
        return Term(f"coalesce({value.sql}, {self._named(self.carries[value.depth], self.held(x), f'_l{value.depth}')})", value.depth)

    def pct(self, x, n: int = 1) -> Term:
        """Relative change against n rows ago; gaps are filled with the last value first."""
        return self.last(x) / self.last(x, n) - 1

    def cumsum(self, x) -> Term:
        x = term(x)
        depth = x.depth + 1
        return Term(self._named(self.totals[depth], self.held(x), f"_c{depth}"), depth)

    def z(self, x, w: int = 120, limit: float = 3.0) -> Term:
        """Moving z-score, at least a third of the frame (20 rows at least), clipped."""
        x, least = term(x), max(20, w // 3)
        return clipped((x - self.mean(x, w, least)) / self.std(x, w, least), -limit, limit)

    # passes

    def apply(self, df: DataFrame, outputs: dict[str, Term], keep: list[str]) -> DataFrame:
        """The kept columns of df and the outputs."""
        top = max((t.depth for t in outputs.values()), default=0) + 1
        for depth in range(top):
            new = [F.expr(sql).alias(name) for sql, name in self.windows[depth].items()]
            df = df.select("*", *new) if new else df
            if self.frames[depth]:
                later = [x for table in (self.frames, self.decays, self.totals, self.carries) for d in range(depth, top) for x in table[d]]
                later += [x for table in (self.windows, self.scalars) for d in range(depth, top) for x in table[d]]
                used = set(re.findall(r"\w+", " ".join([*map(str, later), *(t.sql for t in outputs.values()), *keep, *self.keys, self.order, "own tail"])))
                df = self._by_arrays(df.select(*[c for c in df.columns if c in used]), self.frames[depth])
            df = self._carried(df, self.carries[depth]) if self.carries[depth] else df
            df = self._running(df, self.totals[depth]) if self.totals[depth] else df
            df = self._decayed(df, self.decays[depth]) if self.decays[depth] else df
            new = [F.expr(sql).alias(name) for sql, name in self.scalars[depth].items()]
            df = df.select("*", *new) if new else df
        return df.select(*keep, *[F.expr(t.sql).alias(name) for name, t in outputs.items()])

    def _by_arrays(self, df: DataFrame, wanted: dict[tuple[str, int, tuple[str, ...]], str]) -> DataFrame:
        """df with the moving functions; a group is a block and the rows before it, whatever the series' length."""
        order = self.order
        whole = {name for (template, _, _), name in wanted.items() if template.startswith("count(")}
        schema = StructType([*df.schema, *[StructField(name, LongType() if name in whole else DoubleType()) for name in wanted.values()]])

        def run(part: pa.Table) -> pa.Table:
            at = part[order].to_numpy()
            if not (at[1:] >= at[:-1]).all():
                part = part.take(pa.array(np.argsort(at, kind="stable")))
            column = lambda c: part[c].cast(pa.float64()).to_numpy()
            for name, values in kernels.evaluate(column, wanted).items():
                part = part.append_column(name, pa.array(values) if name in whole else pa.array(values, from_pandas=True))
            return part.select([f.name for f in schema])

        return df.groupBy(*self.keys).applyInArrow(run, schema)

    def _carried(self, df: DataFrame, carries: dict[str, str]) -> DataFrame:
        """The last value that is not missing before each block's first row (which the block before repeats in its tail)."""
        series = [k for k in self.keys if k != "block"]
        newest = lambda x, rows: F.max_by(F.when(rows, F.col(x)), F.when(rows & F.col(x).isNotNull(), F.col(self.order)))
        own, head = F.col("own"), F.col("own") & ~F.col("tail")
        blocks = df.groupBy(*self.keys).agg(*[newest(x, rows).alias(f"{name}_{kind}") for x, name in carries.items() for kind, rows in (("own", own), ("head", head))])
        before = Window.partitionBy(*series).orderBy("block")  # a row for each block
        earlier = before.rowsBetween(Window.unboundedPreceding, -2)
        cells = [F.coalesce(F.lag(f"{name}_head").over(before), F.last(f"{name}_own", ignorenulls=True).over(earlier)).alias(name) for name in carries.values()]
        return df.join(blocks.select(*self.keys, *cells), list(self.keys))

    def _running(self, df: DataFrame, totals: dict[str, str]) -> DataFrame:
        """Running sums. Where bars are cut into blocks, a block starts from the sum of all blocks before it."""
        by = f"OVER (PARTITION BY {', '.join(self.keys)} ORDER BY {self.order} ROWS UNBOUNDED PRECEDING)"
        out = df.select("*", *[F.expr(f"sum({x}) {by}").alias(name) for x, name in totals.items()])
        if not self.blocks:
            return out
        series = [k for k in self.keys if k != "block"]
        sums = [F.coalesce(F.sum(F.when(F.col("own") == own, F.col(x))), F.lit(0.0)).alias(f"{name}_{own}") for x, name in totals.items() for own in (True, False)]
        blocks = df.groupBy(*self.keys).agg(*sums)  # a row for each block
        before = f"OVER (PARTITION BY {', '.join(series)} ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        starts = blocks.select(*self.keys, *[F.expr(f"coalesce(sum({name}_True) {before}, 0D) - {name}_False").alias(f"{name}_start") for name in totals.values()])
        out = out.join(starts, list(self.keys))
        return out.select(*df.columns, *[(F.col(name) + F.col(f"{name}_start")).alias(name) for name in totals.values()])

    def _decayed(self, df: DataFrame, decays: dict[tuple[str, int, int], str]) -> DataFrame:
        """Exponentially weighted means. A block goes on from the state after all blocks before it, composed from what each of them does to a state."""
        order, todo = self.order, list(decays.items())
        schema = StructType([*df.schema, *[StructField(name, DoubleType()) for _, name in todo]])

        def in_order(part: pa.Table) -> pa.Table:
            at = part[order].to_numpy()
            return part if (at[1:] >= at[:-1]).all() else part.take(pa.array(np.argsort(at, kind="stable")))

        def values(part: pa.Table, x: str) -> np.ndarray:
            return part[x].cast(pa.float64()).to_numpy()

        def added(part: pa.Table, new: list[np.ndarray]) -> pa.Table:
            for (_, name), y in zip(todo, new, strict=True):
                part = part.append_column(name, pa.array(y, from_pandas=True))
            return part.select([f.name for f in schema])

        def whole(part: pa.Table) -> pa.Table:
            part = in_order(part)
            return added(part, [kernels.decayed(values(part, x), span, least) for (x, span, least), _ in todo])

        if not self.blocks:
            return df.groupBy(*self.keys).applyInArrow(whole, schema)
        series = [k for k in self.keys if k != "block"]
        kinds = dict(df.dtypes)
        head = ", ".join(f"`{k}` {kinds[k]}" for k in self.keys)

        def summed(part: pa.Table) -> pa.Table:
            """Of a block's own rows: what those that the next block does not repeat do, and those that it does."""
            part = in_order(part)
            own, tail = part["own"].to_numpy(), part["tail"].to_numpy()
            rows = [[kernels.summary(values(part, x)[mask], span) for (x, span, _), _ in todo] for mask in (own & ~tail, own & tail)]
            return part.select(self.keys).slice(0, 1).append_column("does", pa.array([[[list(r) for r in half] for half in rows]], pa.list_(pa.list_(pa.list_(pa.float64())))))

        def folded(part: pa.Table) -> pa.Table:
            """A series' blocks in order: the states before a block's repeated rows and before its own. A row for each block."""
            part = part.sort_by("block")
            last, now, out = [kernels.NOTHING] * len(todo), [kernels.NOTHING] * len(todo), []
            for early, late in part["does"].to_pylist():
                out.append([[list(x) for x in last], [list(x) for x in now]])
                last = [kernels.advanced(x, r, span) for x, r, ((_, span, _), _) in zip(now, early, todo, strict=True)]
                now = [kernels.advanced(x, r, span) for x, r, ((_, span, _), _) in zip(last, late, todo, strict=True)]
            return part.select(self.keys).append_column("before", pa.array(out, pa.list_(pa.list_(pa.list_(pa.float64())))))

        def run(part: pa.Table, state: pa.Table) -> pa.Table:
            part = in_order(part)
            own = part["own"].to_numpy()
            before = state["before"][0].as_py()
            new = []
            for i, ((x, span, least), _) in enumerate(todo):
                v, y = values(part, x), np.empty(len(part))
                for mask, at in zip((~own, own), before, strict=True):
                    y[mask] = kernels.decayed(v[mask], span, least, tuple(at[i]))
                new.append(y)
            return added(part, new)

        cells = "array<array<array<double>>>"
        does = df.select(*self.keys, order, "own", "tail", *dict.fromkeys(x for (x, _, _), _ in todo)).groupBy(*self.keys).applyInArrow(summed, f"{head}, does {cells}")
        before = does.groupBy(*series).applyInArrow(folded, f"{head}, before {cells}")
        return df.groupBy(*self.keys).cogroup(before.groupBy(*self.keys)).applyInArrow(run, schema)


def in_blocks(bars: DataFrame, rows: int = 65536, halo: int = 4608, keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """bars cut into blocks of consecutive rows of a symbol, with `block`, `own` and `tail`.

    A symbol may hold a third of all rows; blocks spread it over many tasks. Each block also gets the `halo` rows before
    it (own is false there; they are the tail of the block before), which covers every frame in use; exponentially weighted
    means, running sums and last values go on from the block before. A row's place is the count of rows in earlier months plus its place in its month.
    """
    if halo > rows:
        raise ValueError("a halo comes from one block")
    by = ", ".join(keys)
    months = bars.withColumn("_month", F.trunc(F.col(order).cast("date"), "month"))
    counts = months.groupBy(*keys, "_month").agg(F.count("*").alias("_n"))  # a row for each symbol and month
    starts = counts.select(*keys, "_month", F.expr(f"coalesce(sum(_n) OVER (PARTITION BY {by} ORDER BY _month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("_start"))
    placed = months.withColumn("_row", F.expr(f"row_number() OVER (PARTITION BY {by}, _month ORDER BY {order}) - 1")).join(starts, [*keys, "_month"])
    placed = placed.withColumn("_place", F.col("_start") + F.col("_row"))
    block = F.floor(F.col("_place") / rows).cast("long")
    tail = F.col("_place") % rows >= rows - halo
    again = F.when(tail, F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block + 1).alias("block"), F.lit(False).alias("own"))))
    cut = placed.withColumn("tail", tail).withColumn("_b", F.explode(F.coalesce(again, F.array(F.struct(block.alias("block"), F.lit(True).alias("own"))))))
    return cut.select(*bars.columns, "_b.block", "_b.own", "tail")
