"""Factor values out of the catalogue's formulas."""

from __future__ import annotations

import math
from functools import cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frames as T
from ..functions.frames import Frames, Term, in_blocks, term
from ..sources.bars import symbol_key, with_returns
from . import catalog as C

FUNCTIONS = {
    "abs": T.absolute, "sign": T.sign, "sign0": T.sign0, "fill0": T.fill0, "nz": T.nz, "log": T.log, "greatest": T.greatest, "least": T.least_of, "pick": T.pick,
    "num": T.num, "positive": T.positive, "negative": T.negative, "sin": lambda x: T.call("sin", x), "cos": lambda x: T.call("cos", x),
    "mod": lambda x, n: T.call("mod", x, n), "pi": math.pi,
}


@cache
def _code(formula: str):
    return compile(formula, "<formula>", "eval")


class Names(dict):
    """What a formula's names stand for: values given, moving functions, series of the family, columns of the bars."""

    def __init__(self, frames: Frames, series: dict[str, str], **given):
        super().__init__(FUNCTIONS | given)
        self.frames, self.series = frames, series

    def __missing__(self, name: str):
        if name in self.series:
            value = self.value(self.series[name])
        elif hasattr(self.frames, name) and callable(getattr(self.frames, name)):
            value = getattr(self.frames, name)
        else:
            value = Term(name)
        self[name] = value
        return value

    def value(self, formula: str) -> Term:
        return term(eval(_code(formula), {"__builtins__": {}}, self))  # noqa: S307  formulas are the catalogue's own


class Formulas:
    """Terms of catalogue factors over one set of frames."""

    def __init__(self, frames: Frames):
        self.frames = frames
        self.names: dict[tuple, Names] = {}
        day = C.CALENDAR_TIME["day_"]
        self.calendar = {k: Term(v) for k, v in C.CALENDAR_TIME.items()} | {k: Term(v.format(day)) for k, v in C.CALENDAR_DATE.items()}

    def _names(self, source: str, x: str | None, w: int | None) -> Names:
        key = (source, x, w)
        if key not in self.names:
            windows = {} if w is None else {"w": w, "h": max(2, w // 2), "d": min(240, max(w + 1, 2 * w)), "p": max(2, w // 3)}
            if source in C.GRIDS:
                inputs, _, series = C.GRIDS[source]
                outer = Names(self.frames, series, **windows)
                self.names[key] = Names(self.frames, series | C.SHARED, **windows, x=outer.value(inputs[x]))
            elif source.startswith("calendar"):
                states = C.CALENDAR_STATES if source == "calendar_x" else C.MARKET_STATES
                outer = Names(self.frames, C.CALENDAR_SERIES, **self.calendar)
                self.names[key] = Names(self.frames, C.CALENDAR_SERIES, **self.calendar, **windows, **({"x": outer.value(states[x])} if x else {}))
            else:
                series = {"parametric": C.PARAMETRIC_SERIES, "additional": C.PARAMETRIC_SERIES, "cross": C.CROSS_SERIES, "macro": C.MACRO_SERIES, "basic": {}}[source]
                self.names[key] = Names(self.frames, series, **windows)
        return self.names[key]

    def raw(self, f: C.Factor) -> Term:
        """The factor before its z-score."""
        names = self._names(f.source, f.input, f.window)
        if f.source in C.GRIDS:
            return names.value(C.GRIDS[f.source][1][f.template])
        if f.source == "calendar_x":
            return names.value(C.CALENDAR[f.template]) * names["x"]
        if f.source == "calendar_ext":
            multiplier, form = f.template.split()
            return names.value(C.MULTIPLIERS[multiplier]) * (names["x"] if form == "level" else names.value(C.STATE_FORMS[form]))
        table = {"basic": C.BASIC, "parametric": C.PARAMETRIC, "additional": C.ADDITIONAL, "cross": C.CROSS, "calendar": C.CALENDAR, "macro": C.MACRO_STATIC | C.MACRO}
        return names.value(table[f.source][f.template])


KEYS = {"own": ("symbol",), "pair": ("symbol", "related"), "macro": ("symbol", "macro")}


def wide(bars: DataFrame, factors: list[C.Factor], kind: str = "own", zscore: int = 120, block_rows: int | None = None) -> DataFrame:
    """A column for each factor. bars: with cc and oc; of pairs, with r_ columns; with m_close.

    block_rows: cut each series into blocks of so many rows (with the rows before it that frames reach back to), so that
    a symbol with a third of all rows is spread over many tasks.
    """
    keys = KEYS[kind]
    frames = Frames((*keys, "block") if block_rows else keys)
    formulas = Formulas(frames)
    outputs = {f.name: frames.z(formulas.raw(f), zscore) for f in factors}
    df = in_blocks(bars, block_rows, min(4608, block_rows), keys) if block_rows else bars
    out = frames.apply(df, outputs, [*keys, "ts", *(["own"] if block_rows else [])])
    return out.where("own").drop("own") if block_rows else out


def long(bars: DataFrame, factors: list[C.Factor], kind: str = "own", zscore: int = 120, block_rows: int | None = 32768, batch: int = 150) -> DataFrame:
    """(symbol, ts, factor, value), in batches of so many factors a plan; the last key's name goes into the factor's."""
    keys = KEYS[kind]
    parts = []
    for i in range(0, len(factors), batch):
        some = factors[i : i + batch]
        out = wide(bars, some, kind, zscore, block_rows).unpivot([*keys, "ts"], [f"`{f.name}`" for f in some], "factor", "value")
        if kind != "own":
            out = out.withColumn("factor", F.replace(F.col("factor"), F.lit("{s}"), symbol_key(F.col(keys[1]))))
        parts.append(out.select("symbol", "ts", "factor", "value"))
    return reduce(DataFrame.unionByName, parts)


def build_factors(bars: DataFrame, names: set[str] | None = None, pairs: DataFrame | None = None, macro: DataFrame | None = None,
                  related: tuple[str, ...] = (), macro_symbols: tuple[str, ...] = (), pruned: set[str] = frozenset(), zscore: int = 120, block_rows: int | None = 32768, batch: int = 150) -> DataFrame:
    """(symbol, ts, factor, value) of the named factors (None: all of the catalogue), without pruned ones.

    bars: normalised bars. pairs: bars joined with those of related symbols. macro: bars joined with daily series. Only
    formulas of the named factors are computed; no names, no rows.
    """
    wanted = [(name, f) for _, name, f, _ in C.catalog(related, macro_symbols) if (names is None or name in names) and name not in pruned]
    have = {n for n, _ in wanted}
    if names is not None and (unknown := names - {n for _, n, _, _ in C.catalog(related, macro_symbols)}):
        raise ValueError(f"unknown factors: {sorted(unknown)[:5]}")
    sources = {"own": with_returns(bars), "pair": pairs, "macro": macro}
    parts = []
    for kind, source in sources.items():
        some = list(dict.fromkeys(f for _, f in wanted if f.kind == kind))
        if some:
            if source is None:
                raise ValueError(f"factors of kind {kind} need their bars")
            out = long(source, some, kind, zscore, block_rows, batch)
            if kind != "own":  # a name may be wanted for one related symbol and not for another
                listed = bars.sparkSession.createDataFrame([(n,) for n in sorted(have)], "factor string")
                out = out.join(listed, "factor", "left_semi").select("symbol", "ts", "factor", "value")
            parts.append(out)
    if not parts:
        return bars.sparkSession.createDataFrame([], "symbol string, ts timestamp_ntz, factor string, value double")
    return reduce(DataFrame.unionByName, parts)


def catalog_frame(spark, related: tuple[str, ...] = (), macro_symbols: tuple[str, ...] = (), names: set[str] | None = None) -> DataFrame:
    """(factor_id, factor, label, source, template, input, window, related): the catalogue as a table, or the named rows of it."""
    rows = [(n, name, f"{n}_{name}", f.source, f.template, f.input, f.window, s or None) for n, name, f, s in C.catalog(related, macro_symbols) if names is None or name in names]
    return spark.createDataFrame(rows, "factor_id long, factor string, label string, source string, template string, input string, window int, related string")


def names_in_scope(related: tuple[str, ...], macro_symbols: tuple[str, ...], scope: str, new_from: int = 1, selected: tuple[str, ...] = ()) -> set[str]:
    """scoped(), of the catalogue itself: names, without a table."""
    every = {name: n for n, name, _, _ in C.catalog(related, macro_symbols)}
    if scope == "selected" and (unknown := set(selected) - every.keys()):
        raise ValueError(f"unknown factors: {sorted(unknown)}")
    if scope not in ("all", "new", "selected"):
        raise ValueError("scope is all, new or selected")
    return set(selected) if scope == "selected" else {name for name, n in every.items() if scope == "all" or n >= new_from}


def scoped(catalog: DataFrame, scope: str, new_from: int = 1, selected: tuple[str, ...] = ()) -> DataFrame:
    """The catalogue's rows in scope: all, new (from a number on) or selected (an unknown name is an error)."""
    if scope == "all":
        return catalog
    if scope == "new":
        return catalog.where(F.col("factor_id") >= new_from)
    if scope != "selected":
        raise ValueError("scope is all, new or selected")
    out = catalog.where(F.col("factor").isin(list(selected)))
    if unknown := set(selected) - {r["factor"] for r in out.select("factor").collect()}:  # at most as many as were selected
        raise ValueError(f"unknown factors: {sorted(unknown)}")
    return out
