"""Whitelists of features and comparators that rules may name. Nothing is ever evaluated from text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comparators by the symbol that parameter files use. A comparison with NaN is false.
COMPARATORS: dict[str, Callable[[Column, object], Column]] = {
    ">": lambda x, t: x > t,
    "<": lambda x, t: x < t,
    ">=": lambda x, t: x >= t,
    "<=": lambda x, t: x <= t,
    "==": lambda x, t: x == t,
    "!=": lambda x, t: x != t,
}


def compare(x: Column, symbol: str, threshold: object) -> Column:
    """``x <symbol> threshold``; false for NaN, which Spark would order above every number."""
    return F.when(F.isnan(x.cast("double")), F.lit(False)).otherwise(COMPARATORS[symbol](x, F.lit(threshold)))


def norm(i: str = "dv_i", j: str = "dv_j") -> Column:
    """Length of a vector of two columns."""
    return F.sqrt(F.col(i) * F.col(i) + F.col(j) * F.col(j))


#: Features of one correspondence by name.
FEATURES: dict[str, Callable[[], Column]] = {
    **{c: (lambda c=c: F.col(c)) for c in ("dyn_range", "kurt_src", "kurt_dst", "r_max", "delta_5", "sigma_095", "sigma_075", "sigma_05")},
    "norm": norm,
}


def feature(name: str) -> Column:
    if name not in FEATURES:
        raise KeyError(f"unknown feature {name!r}; known: {', '.join(sorted(FEATURES))}")
    return FEATURES[name]()
