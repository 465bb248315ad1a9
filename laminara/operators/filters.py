"""Rejection rules on correspondences, and predicates on points and boxes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminara.functions.registry import compare, feature


@dataclass(frozen=True, order=True)
class Rule:
    """Reject where ``feature compare threshold``; rules run in order of priority."""

    priority: int
    feature: str
    compare: str
    threshold: float

    @property
    def column(self) -> str:
        """A rule's column is named by the whole rule, so that another threshold is another column."""
        side = {">": "gt", "<": "lt", ">=": "ge", "<=": "le", "==": "eq", "!=": "ne"}[self.compare]
        return f"f_{self.feature}_{side}_{self.threshold:g}".replace(".", "p").replace("-", "m")


#: The default chain.
DEFAULT_RULES = (
    Rule(1, "sigma_095", ">", 6.5), Rule(2, "sigma_075", ">", 20.0), Rule(3, "sigma_05", ">", 150.0), Rule(4, "dyn_range", "<", 0.5),
    Rule(5, "r_max", "<", 0.0275), Rule(6, "kurt_src", ">", 25.0), Rule(7, "kurt_dst", ">", 50.0), Rule(8, "kurt_src", "<", -1.6), Rule(9, "delta_5", "<", 0.07),
)
MANUAL = "manual"


def rule_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("f_")]


def apply_rules(df: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """One boolean column for each rule, true where it rejects; a rule that ran before is overwritten."""
    return df.withColumns({r.column: compare(feature(r.feature), r.compare, r.threshold) for r in sorted(rules)})


def any_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def rejected(df: DataFrame, manual_only: bool = False) -> Column:
    """Whether any rule, or the manual mark, rejects; the mark alone with ``manual_only``."""
    manual = F.coalesce(F.col(MANUAL), F.lit(False)) if MANUAL in df.columns else F.lit(False)
    return manual if manual_only else any_of([manual, *(F.coalesce(F.col(c), F.lit(False)) for c in rule_columns(df))])


def with_rejected(df: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    df = apply_rules(df, rules)
    return df.withColumn("rejected", rejected(df))


def clear_rules(df: DataFrame) -> DataFrame:
    return df.drop(*rule_columns(df), "rejected")


def undo_rule(df: DataFrame) -> DataFrame:
    """Drop the rule that ran last."""
    return df.drop(*rule_columns(df)[-1:])


def refilter(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    return with_rejected(clear_rules(df), rules)


def rule_totals(df: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """(rule, n): how many rows each rule rejects, over all matches in one pass."""
    rules = sorted(rules)
    counts = apply_rules(df, rules).agg(*(F.count_if(F.col(r.column)).alias(r.column) for r in rules))
    return counts.unpivot([], [r.column for r in rules], "rule", "n")


def points(df: DataFrame, accepted_only: bool = False, use_post: bool = False, offset: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(corr_id, src_i, src_j, dst_i, dst_j), shifted by a layer's offset if asked."""
    if accepted_only:
        df = df.where(~F.col("rejected"))
    move = lambda c, k: F.col(c) + F.lit(float(offset[k]))
    src = (F.col("post_i"), F.col("post_j")) if use_post else (move("pre_i", 0), move("pre_j", 1))
    return df.select("corr_id", src[0].alias("src_i"), src[1].alias("src_j"), (move("pre_i", 0) + F.col("dv_i")).alias("dst_i"), (move("pre_j", 1) + F.col("dv_j")).alias("dst_j"))


def export_points(df: DataFrame, scale: float = 1.0, mip: int = 0) -> DataFrame:
    """Accepted rows with end points stretched by ``scale`` and brought to mip 0, as whole numbers."""
    k = float(2**mip)
    at = lambda c, d: ((F.col(c) + scale * F.col(d)) * k).cast("int")
    return df.where(~F.col("rejected")).select("corr_id", (F.col("pre_i") * k).cast("int").alias("x0"), (F.col("pre_j") * k).cast("int").alias("y0"), at("pre_i", "dv_i").alias("x1"), at("pre_j", "dv_j").alias("y1"))


def piecewise_reject(delta: Column, length: Column, least_delta: float = 0.07, most: float = 120.0) -> Column:
    return (delta <= least_delta) | (length >= most)


def snap(x: Column, start: int, chunk: int, up: bool = False) -> Column:
    """``x`` moved to a chunk's edge, below it or above."""
    k = (x - start) / F.lit(float(chunk))
    return ((F.ceil(k) if up else F.floor(k)) * chunk + start).cast("int")


def clamp(x: Column, offset: float, most: float) -> Column:
    return F.least(F.greatest(x - offset, F.lit(1.0)), F.lit(float(most)))


def in_box(i: Column, j: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point lies in (i, j, height, width), edges included."""
    a, b, h, w = box
    return i.between(a, a + h) & j.between(b, b + w)


def find_key(tree: object, key: str) -> object:
    """Depth-first look-up of a key in nested dictionaries; None if there is none. For parameters, at plan time."""
    if isinstance(tree, dict):
        if key in tree:
            return tree[key]
        for value in tree.values():
            found = find_key(value, key)
            if found is not None:
                return found
    return None
