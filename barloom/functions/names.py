"""What a factor's name says: family, window, complexity. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of the families; all others are parametric.
BASIC = ("momentum", "reversal", "breakout", "volume_confirm")
FAMILIES = (
    ("calendar", ("calendar_",)),
    ("macro_state", ("macro_",)),
    ("cross_asset", ("cross_", "crossmega_", "crossultra_", "crosshyper_", "crossomega_")),
    ("non_cross_complex", ("ultra_", "hyper_", "omega_")),
)
HIGH = ("omega_", "crossomega_", "hyper_", "crosshyper_")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def family(name: Column) -> Column:
    out = F.when(name.isin(*BASIC), "basic")
    for label, prefixes in FAMILIES:
        out = out.when(_any([name.startswith(p) for p in prefixes]), label)
    return out.otherwise("parametric")


def window(name: Column) -> Column:
    """The number at the name's end."""
    return F.nullif(F.regexp_extract(name, r"_(\d+)$", 1), F.lit("")).cast("int")


def token_count(name: Column) -> Column:
    return F.size(F.split(name, "_"))


def complexity(name: Column) -> Column:
    kind, tokens = family(name), token_count(name)
    return (
        F.when(kind == "basic", "low").when(kind.isin("calendar", "macro_state") & (tokens <= 5), "medium").when(_any([name.contains(p) for p in HIGH]), "high")
        .when(tokens >= 7, "high").when(tokens >= 5, "medium").otherwise("low")
    )
