"""Moving functions over one block of rows as arrays: what Spark would work out anew for every row's frame.

Missing values are NaN. No function costs more for a longer frame. Rows are cut into pieces of the frame's length, so a frame
is the end of one piece and the beginning of the next: sums and extremes are running ones towards the cut from both sides,
added up, and nothing is ever subtracted. Sums are of differences from a value next to the cut that lies in the frame, so
constant frames have no spread at all and little is lost to cancellation. Order statistics (quantiles, ranks) are read from
a wavelet matrix of the column's ranks: a level for each bit of a rank, whatever the frame.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

#: Moving functions by their SQL form; quantiles are "percentile({}, 0.5D)".
SINGLE = ("count({})", "count({0})", "avg({})", "sum({})", "stddev_samp({})", "var_samp({})", "max({})", "min({})", "skewness({})", "kurtosis({})", "pct_rank({})")
PAIR = "covar_samp({}, {})"


def share(template: str) -> float | None:
    """A quantile's share, None for other functions (several quantiles at once too)."""
    head, _, tail = template.partition("percentile({}, ")
    return float(tail.rstrip("D)")) if not head and tail and "array" not in tail else None


def known(template: str) -> bool:
    return template in SINGLE or template == PAIR or share(template) is not None


def counts(x: np.ndarray, w: int) -> np.ndarray:
    seen = np.concatenate([np.zeros(w, np.int64), np.cumsum(~np.isnan(x))])
    return seen[w:] - seen[:-w]


class Pieces:
    """Where a frame of w rows lies in columns cut into pieces of w: the end of piece j from place o on, and o rows of the next."""

    def __init__(self, n: int, w: int):
        self.n, self.w = n, w
        self.count = -(-(n + w - 1) // w) + 1
        self.j, self.o = np.divmod(np.arange(n), w)

    def cut(self, x: np.ndarray, fill: float = np.nan) -> np.ndarray:
        out = np.full(self.count * self.w, fill)
        out[self.w - 1 : self.w - 1 + self.n] = x
        return out.reshape(self.count, self.w)

    def joined(self, ends: np.ndarray, begins: np.ndarray, none: float, add) -> np.ndarray:
        """A frame's result from running ones: of a piece from its end, and of the next piece from its beginning."""
        return add(ends[self.j, self.o], np.where(self.o > 0, begins[self.j, np.maximum(self.o - 1, 0)], none))

    def extreme(self, x: np.ndarray, none: float, f: np.ufunc) -> np.ndarray:
        cells = self.cut(np.where(np.isnan(x), none, x), none)
        return self.joined(f.accumulate(cells[:, ::-1], axis=1)[:, ::-1], f.accumulate(cells, axis=1)[1:], none, f)

    def sums(self, columns: list[np.ndarray], terms: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Sums over frames of terms of the columns' differences from one of the frame's own values, and these values.

        The columns are missing in the same rows. The value is the last one before the cut, or where the frame has none
        there, the first one after it.
        """
        cells = [self.cut(x) for x in columns]
        there = ~np.isnan(cells[0])
        line = np.arange(self.count)
        last, first = self.w - 1 - there[:, ::-1].argmax(1), there.argmax(1)
        before, after = [c[line, last] for c in cells], [c[line, first] for c in cells]
        near = there.any(1)[self.j] & (self.o <= last[self.j])

        def running(rows: slice, refs: list[np.ndarray], way: int) -> list[np.ndarray]:
            d = [c[rows] - ref[:, None] for c, ref in zip(cells, refs, strict=True)]
            return [np.cumsum(np.where(there[rows], t(*d), 0.0)[:, ::way], axis=1)[:, ::way] for t in terms]

        every, later = slice(None), slice(1, None)
        out = [self.joined(e, b, 0.0, np.add) for e, b in zip(running(every, before, -1), running(later, [r[:-1] for r in before], 1), strict=True)]
        refs = [r[self.j] for r in before]
        if not near.all():
            behind = np.maximum(self.o - 1, 0)
            out = [np.where(near, x, np.where(self.o > 0, b[self.j, behind], 0.0)) for x, b in zip(out, running(later, [r[1:] for r in after], 1), strict=True)]
            refs = [np.where(near, r, a[self.j + 1]) for r, a in zip(refs, after, strict=True)]
        return out, refs


class Ordered:
    """The order of a column's values, for any range of rows: a wavelet matrix of their ranks."""

    def __init__(self, x: np.ndarray):
        there = ~np.isnan(x)
        self.before = np.concatenate([[0], np.cumsum(there)])  # places among the values that are there
        self.values, code = np.unique(x[there], return_inverse=True)
        self.code = np.zeros(len(x), np.int64)
        self.code[there] = code
        self.levels = []  # from the highest bit: (bit, zeros before each place, number of zeros)
        for bit in range(max(1, int(max(len(self.values) - 1, 0)).bit_length()) - 1, -1, -1):
            one = (code >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - one)])
            self.levels.append((bit, zeros, zeros[-1]))
            code = np.concatenate([code[one == 0], code[one == 1]])

    def ranges(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.before) - 1
        return self.before[np.maximum(np.arange(n) - w + 1, 0)], self.before[1:]

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each range; NaN for empty ranges."""
        some = high > low
        low, high, k = low[some], high[some], k[some]
        code = np.zeros(len(k), np.int64)
        for bit, zeros, n in self.levels:
            a, b = zeros[low], zeros[high]
            up = k >= b - a
            k = np.where(up, k - (b - a), k)
            low, high = np.where(up, n + low - a, a), np.where(up, n + high - b, b)
            code |= up.astype(np.int64) << bit
        out = np.full(len(some), np.nan)
        out[some] = self.values[code]
        return out

    def place(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values of each row's range are below the row's own, and how many equal it."""
        below = np.zeros(len(low), np.int64)
        for bit, zeros, n in self.levels:
            a, b = zeros[low], zeros[high]
            up = (self.code >> bit) & 1 == 1
            below += np.where(up, b - a, 0)
            low, high = np.where(up, n + low - a, a), np.where(up, n + high - b, b)
        return below, high - low


def single(x: np.ndarray, w: int, wanted: set[str], ordered: Ordered | None = None) -> dict[str, np.ndarray]:
    """The wanted functions of one column over frames of w rows; NaN where there is none."""
    n, cut = counts(x, w), Pieces(len(x), w)
    out: dict[str, np.ndarray] = {"count({})": n, "count({0})": n}
    some = np.where(n > 0, n, np.nan)
    top = 4 if wanted & {"skewness({})", "kurtosis({})"} else 2 if wanted & {"stddev_samp({})", "var_samp({})"} else 1 if wanted & {"avg({})", "sum({})"} else 0
    if top:
        s, (ref,) = cut.sums([x], [lambda d: d, lambda d: d * d, lambda d: d * d * d, lambda d: (d * d) ** 2][:top])
        mean = s[0] / some
        out["avg({})"], out["sum({})"] = ref + mean, some * ref + s[0]
    if top > 1:
        m2 = np.maximum(s[1] - s[0] * mean, 0.0)
        out["var_samp({})"] = m2 / np.where(n > 1, n - 1, np.nan)
        out["stddev_samp({})"] = np.sqrt(out["var_samp({})"])
    if top > 2:
        spread = np.where(m2 > 0, m2, np.nan)
        m3 = s[2] - 3 * mean * s[1] + 2 * mean * mean * s[0]
        m4 = s[3] - 4 * mean * s[2] + 6 * mean**2 * s[1] - 3 * mean**3 * s[0]
        out["skewness({})"], out["kurtosis({})"] = np.sqrt(some) * m3 / spread**1.5, some * m4 / spread**2 - 3
    for name, none, f in (("max({})", -np.inf, np.maximum), ("min({})", np.inf, np.minimum)):
        if name in wanted:
            out[name] = np.where(n > 0, cut.extreme(x, none, f), np.nan)
    shares = {t: q for t in wanted if (q := share(t)) is not None}
    if shares or "pct_rank({})" in wanted:
        ordered = ordered or Ordered(x)
        low, high = ordered.ranges(w)
        for t, q in shares.items():
            place = np.maximum(n - 1, 0) * q
            under, over = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
            a, b = ordered.smallest(low, high, under), ordered.smallest(low, high, over)
            out[t] = np.where(under == over, a, (over - place) * a + (place - under) * b)
        if "pct_rank({})" in wanted:
            below, same = ordered.place(low, high)
            out["pct_rank({})"] = np.where(np.isnan(x), np.nan, (below + (same + 1) / 2) / some)
    return {t: out[t] for t in wanted}


def covariance(x: np.ndarray, y: np.ndarray, w: int) -> np.ndarray:
    """Sample covariance over the frame's rows where both are present."""
    gone = np.isnan(x) | np.isnan(y)
    x, y = np.where(gone, np.nan, x), np.where(gone, np.nan, y)
    n = counts(x, w)
    (dx, dy, dxy), _ = Pieces(len(x), w).sums([x, y], [lambda a, b: a, lambda a, b: b, lambda a, b: a * b])
    have = np.where(n > 1, n, np.nan)
    return (dxy - dx * dy / have) / (have - 1)


def evaluate(column, wanted: dict[tuple[str, int, tuple[str, ...]], str]) -> dict[str, np.ndarray]:
    """Results by name. column: the values of a name; wanted: name by function, frame and columns."""
    groups: dict[tuple[str, int], dict[str, str]] = defaultdict(dict)
    out: dict[str, np.ndarray] = {}
    with np.errstate(all="ignore"):
        for (template, w, columns), name in wanted.items():
            if template == PAIR:
                out[name] = covariance(column(columns[0]), column(columns[1]), w)
            else:
                groups[columns[0], w][template] = name
        orders: dict[str, Ordered] = {}
        for (x, w), names in groups.items():
            if x not in orders and any(t == "pct_rank({})" or share(t) is not None for t in names):
                orders[x] = Ordered(column(x))
            found = single(column(x), w, set(names), orders.get(x))
            out |= {name: found[template] for template, name in names.items()}
    return out


def scanned(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """y[i] = a[i] y[i - 1] + c[i] from y[-1] = 0: affine maps composed over distances that double."""
    a, c, step = a.copy(), c.copy(), 1
    while step < len(c) and a.max() > 1e-25:
        c[step:], a[step:] = c[step:] + a[step:] * c[:-step], a[step:] * a[:-step]
        step *= 2
    return c


def shrunk(x: np.ndarray, span: int, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where values are, and the map that each one makes of the mean before it: a mean, b of the value. gap: rows without value before the first."""
    alpha, at = 2.0 / (span + 1), np.flatnonzero(~np.isnan(x))
    old = (1 - alpha) ** np.diff(at, prepend=-1 - gap)
    return at, old / (old + alpha), alpha / (old + alpha)


#: Of an exponentially weighted mean before a row: the mean, rows since its last value, values so far.
NOTHING = (np.nan, 0.0, 0.0)


def decayed(x: np.ndarray, span: int, least: int, before: tuple[float, float, float] = NOTHING) -> np.ndarray:
    """Exponentially weighted means that go on from a state; NaN with too few values."""
    mean, gap, n = before
    at, a, b = shrunk(x, span, gap)
    y = np.full(len(x), mean)
    if len(at):
        c = b * x[at]
        c[0] = x[at[0]] if np.isnan(mean) else c[0] + a[0] * mean
        a[0] = 0.0
        place = np.cumsum(~np.isnan(x)) - 1
        y = np.where(place >= 0, scanned(a, c)[np.maximum(place, 0)], mean)
    return np.where(n + np.cumsum(~np.isnan(x)) >= max(least, 1), y, np.nan)


def summary(x: np.ndarray, span: int) -> tuple[float, ...]:
    """What rows do to a state: their number, values, place and size of the first one, the map from the mean at it to the last mean, rows since the last value."""
    at, a, b = shrunk(x, span, 0.0)
    if not len(at):
        return float(len(x)), 0.0, np.nan, np.nan, np.nan, np.nan, np.nan
    c = b * x[at]
    a[0], c[0] = 0.0, 0.0
    return float(len(x)), float(len(at)), float(at[0]), float(x[at[0]]), float(np.prod(a[1:])), float(scanned(a, c)[-1]), float(len(x) - 1 - at[-1])


def advanced(before: tuple[float, float, float], rows: tuple[float, ...], span: int) -> tuple[float, float, float]:
    """The state after rows of which only the summary is known."""
    mean, gap, n = before
    size, values, place, first, a, c, behind = rows
    if not values:
        return mean, gap + size, n
    alpha = 2.0 / (span + 1)
    old = (1 - alpha) ** (gap + place + 1)
    at_first = first if np.isnan(mean) else (old * mean + alpha * first) / (old + alpha)
    return a * at_first + c, behind, n + values
