"""Vector scalars as column expressions: dot products, norms, rotation, sub-vectors, packing, membership.

With a known dimension, products are written out term by term: the sum stays in whole-stage code and adds in index order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    """Null if a component is null. dim: the number of components, if known."""
    if dim:
        return reduce(add, (F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(dim)))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column, dim: int | None = None, eps: float = EPS) -> Column:
    """Length of a vector, not below eps."""
    return F.greatest(F.sqrt(dot(v, v, dim)), F.lit(eps))


def bound(of: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row: in a lambda it is a variable, not an expression that is computed again at each place."""
    return F.get(F.transform(F.array(of), use), F.lit(0))


def direction(v: Column, dim: int | None = None, eps: float = EPS) -> Column:
    """v at unit length; vectors shorter than eps are divided by eps."""
    return bound(norm(v, dim, eps), lambda n: F.transform(v, lambda x: x / n))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def times(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


def piece(v: Column, m: int | Column, size: int) -> Column:
    """The m-th of equal sub-vectors, from 0."""
    start = (m if isinstance(m, Column) else F.lit(m)) * size + 1
    return F.slice(v, start.cast("int"), F.lit(size))


def matrix(rows: np.ndarray) -> Column:
    return F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in rows))


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    """An orthogonal matrix: QR of a seeded Gaussian, with the signs that make the factor unique."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def rotate(v: Column, by: np.ndarray) -> Column:
    """v times the matrix; its inverse is rotate(., by.T)."""
    return bound(v, lambda u: F.transform(matrix(by.T), lambda col: dot(u, col, by.shape[0])))


def linear(v: Column, weights: np.ndarray, bias: np.ndarray | None = None) -> Column:
    """weights @ v + bias, for projections [out, in]."""
    out = bound(v, lambda u: F.transform(matrix(weights), lambda row: dot(u, row, weights.shape[1])))
    return out if bias is None else plus(out, F.array(*(F.lit(float(x)) for x in bias)))


def pack4(codes: Column, count: int) -> Column:
    """Two 4-bit codes a number from 0 to 255: the even one low, the odd one high; an odd count leaves the last high half 0. Codes out of range fail."""
    ok = lambda c: F.when(c.between(0, 15), c).otherwise(F.raise_error(F.lit("codes must be from 0 to 15")).cast("int"))
    half = lambda i: ok(F.get(codes, F.lit(i)).cast("int")) if i < count else F.lit(0)
    return F.array(*((half(i) + F.shiftleft(half(i + 1), 4)).cast("smallint") for i in range(0, count, 2)))


def unpack4(packed: Column, count: int) -> Column:
    byte = lambda i: F.get(packed, F.lit(i // 2)).cast("int")
    return F.array(*(F.shiftright(byte(i), 4) if i % 2 else byte(i).bitwiseAND(F.lit(15)) for i in range(count)))


def difference(a: Column, b: Column) -> Column:
    """a without what b holds; repeats in a stay (array_except would drop them)."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def positions(haystack: Column, needles: Column) -> Column:
    """For each needle its place in haystack, from 0; -1 if it isn't there."""
    return F.transform(needles, lambda x: F.array_position(haystack, x) - 1)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def mean_by_dim(v: Column, dim: int) -> Column:
    """An aggregate: the mean vector, one average a component, partial in each task."""
    return F.array(*(F.avg(F.get(v, F.lit(i))) for i in range(dim)))


def sum_by_dim(v: Column, dim: int) -> Column:
    return F.array(*(F.sum(F.get(v, F.lit(i))) for i in range(dim)))
