"""Names and numbers of sections: fractional indices, scales of mip levels, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sub-sections of a section count in thousandths of its index.
SPLIT = 1000


def z_of(index: Column) -> Column:
    """Section of a fractional index, towards zero."""
    return (F.signum(index) * F.floor(F.abs(index))).cast("int")


def sub_of(index: Column) -> Column:
    """Sub-section of a fractional index."""
    return F.rint((index - F.signum(index) * F.floor(F.abs(index))) * SPLIT).cast("int")


def index_of(z: Column, sub: Column) -> Column:
    return (z + sub / F.lit(float(SPLIT))).cast("decimal(12,3)")


def scale_of(mip: Column) -> Column:
    """Size of a pixel of mip 0 in pixels of ``mip``."""
    return F.pow(F.lit(2.0), -mip)


def match_name(src: Column, dst: Column) -> Column:
    return F.concat(F.lit("("), src.cast("string"), F.lit(", "), dst.cast("string"), F.lit(")"))


def parse_pairs(text: Column) -> Column:
    """array<struct<src_z,dst_z>> of every "(a, b)" or "a,b" in a text."""
    found = F.regexp_extract_all(text, F.lit(r"(-?\d+)\s*,\s*(-?\d+)"), F.lit(0))
    part = lambda s, k: F.regexp_extract(s, r"(-?\d+)\s*,\s*(-?\d+)", k).cast("int")
    return F.transform(found, lambda s: F.struct(part(s, 1).alias("src_z"), part(s, 2).alias("dst_z")))
