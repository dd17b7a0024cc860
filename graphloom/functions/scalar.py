"""Scalar building blocks as column expressions.

Everything stays inside generated code or higher-order functions; the
random numbers come from a hash, so a draw depends on its key alone and is
the same on any partitioning and in any SQL engine with MD5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u01(*key: Column | str | int) -> Column:
    """A uniform draw in [0, 1), in steps of 2**-52, from the MD5 of the key
    parts joined by |.

    Give every use its own first part, else draws of two uses agree.
    """
    parts = [F.lit(str(k)) if isinstance(k, int | str) else k.cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rounded(x: Column, digits: int = 6) -> Column:
    """Round for display and comparison; minus zero becomes zero."""
    return F.round(x, digits) + F.lit(0.0)


def cantor(a: Column, b: Column, unordered: bool = False) -> Column:
    """The Cantor number of a pair of non-negative integers."""
    if unordered:
        a, b = F.least(a, b), F.greatest(a, b)
    s = a + b
    return F.shiftright(s * (s + 1), 1) + b


def cantor_inverse(z: Column) -> tuple[Column, Column]:
    """The pair of a Cantor number, exact while 8z + 1 is below 2**53."""
    w = F.floor((F.sqrt(8 * z + 1) - 1) / 2).cast("long")
    b = z - F.shiftright(w * (w + 1), 1)
    return w - b, b


def pair_id(a: Column, b: Column, n: int | Column) -> Column:
    """min + max * n: the number of an undirected pair."""
    return F.least(a, b) + F.greatest(a, b) * n


def pair_of(z: Column, n: int) -> tuple[Column, Column]:
    return z % n, F.floor(z / n).cast("long")


def safe_log(x: Column, floor: float = 1e-12) -> Column:
    return F.log(F.greatest(x, F.lit(floor)))


def safe_inverse(x: Column, floor: float = 1e-12) -> Column:
    return 1.0 / F.greatest(x, F.lit(floor))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order; missing components count as null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, floor: float = 1e-12) -> Column:
    """The vector divided by its length, or by the floor if that is larger."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(floor)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def log_sigmoid(x: Column) -> Column:
    return -F.log1p(F.exp(-x))


def soft_threshold(x: Column, lam: float | Column, positive: bool = False) -> Column:
    """sign(x) * max(|x| - lam, 0); ``positive`` also drops negative values."""
    out = F.signum(x) * F.greatest(F.abs(x) - lam, F.lit(0.0))
    return F.greatest(out, F.lit(0.0)) if positive else out


def kl_term(p: Column, q: Column) -> Column:
    """p ln(p / q), 0 where p is 0."""
    return F.when(p > 0, p * F.log(p / q)).otherwise(F.lit(0.0))


def token(node: Column) -> Column:
    return node.cast("string")
