"""Checks of the catalogue itself: no formula looks ahead; formulas that prune lists remove."""

from __future__ import annotations

import re

from ..functions.frames import Frames
from . import catalog as C
from .factors import Formulas

AHEAD = re.compile(r"\blead\(|FOLLOWING", re.I)


def looks_ahead(factors: list[C.Factor] | None = None) -> list[str]:
    """Names of factors whose windows take in later rows."""
    if factors is None:  # one window stands for all
        factors = [f for f in dict.fromkeys(f for _, _, f, _ in C.catalog(("R.X",), ("M.X",))) if f.window in (None, 21, 20)]
    bad = []
    for f in factors:
        frames = Frames()
        Formulas(frames).raw(f)
        if any(AHEAD.search(sql) for level in frames.windows.values() for sql in level):
            bad.append(f.name)
    return bad


def removable(pruned: set[str], related: tuple[str, ...] = (), macro: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(source, template) of formulas all of whose factors are pruned."""
    left: dict[tuple[str, str], bool] = {}
    for _, name, f, _ in C.catalog(related, macro):
        left[f.source, f.template] = left.get((f.source, f.template), False) or name not in pruned
    return [k for k, keep in left.items() if not keep]
