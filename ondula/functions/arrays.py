"""Array primitives as column expressions: padding, slicing, complex arithmetic, periodisation, Fourier sums.

Complex arrays are arrays of struct<re, im>.  Everything here stays in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, not once for each element of a lambda that uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def pad_reflect(x: Column, left: int, right: int) -> Column:
    """Mirror an array at its ends, without repeating the edge."""
    return F.concat(F.reverse(F.slice(x, 2, left)), x, F.slice(F.reverse(x), 2, right))


def unpad(y: Column, start: int, end: int) -> Column:
    return F.slice(y, start + 1, end - start)


def border_levels(start: int, end: int, levels: int) -> list[tuple[int, int]]:
    from ondula.plans.time_plan import borders

    return borders(start, end, levels)


def ordered_sum(x: Column) -> Column:
    """Sum from left to right; SQL's sum over rows has no order."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def complex_(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def conj(z: Column) -> Column:
    return complex_(z.re, -z.im)


def scale(z: Column, k: Column | float) -> Column:
    return complex_(z.re * k, z.im * k)


def unscale(z: Column, k: Column | float) -> Column:
    return complex_(z.re / k, z.im / k)


def add(a: Column, b: Column) -> Column:
    return complex_(a.re + b.re, a.im + b.im)


def subtract(a: Column, b: Column) -> Column:
    return complex_(a.re - b.re, a.im - b.im)


def multiply(a: Column, b: Column) -> Column:
    return complex_(a.re * b.re - a.im * b.im, a.re * b.im + a.im * b.re)


def norm(z: Column) -> Column:
    return F.sqrt(z.re * z.re + z.im * z.im)


def modulus(zs: Column) -> Column:
    return F.transform(zs, norm)


def pointwise(zs: Column, h: Column) -> Column:
    """Complex array times real array."""
    return F.zip_with(zs, h, lambda z, f: complex_(z.re * f, z.im * f))


def periodize(x: Column, k: int, mean: bool = False) -> Column:
    """Sum (or mean) of the k blocks of an array."""

    def blocks(x: Column) -> Column:
        m = F.floor(F.size(x) / k).cast("int")
        block = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda a, b: a + F.get(x, b * m + i))
        return F.transform(F.sequence(F.lit(0), m - 1), lambda i: block(i) / k if mean else block(i))

    return let(x, blocks)


def filter_periodize(zs: Column, h: Column, k: int) -> Column:
    """``mean over k blocks of (z h)``: decimation by k in time."""
    product = pointwise(zs, h)
    re = periodize(F.transform(product, lambda z: z.re), k, mean=True)
    im = periodize(F.transform(product, lambda z: z.im), k, mean=True)
    return F.zip_with(re, im, complex_)


def fftfreq(n: int) -> Column:
    """Frequencies of a transform of length n: non-negative ones first."""
    half = (n - 1) // 2
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i <= half, i / n).otherwise((i - n) / n))


def unit_root(num: Column, den: int) -> Column:
    """exp(-2 pi i num / den), with the angle reduced as a whole number first."""
    angle = (num % den) * F.lit(-2 * math.pi / den)
    return complex_(F.cos(angle), F.sin(angle))


def dft(x: Column, n: int, inverse: bool = False) -> Column:
    """Discrete Fourier transform of a complex array by its definition, for short arrays and as a check of faster ones."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    zero = complex_(F.lit(0.0), F.lit(0.0))

    def term(x: Column, a: Column, k: Column, i: Column) -> Column:
        root = unit_root(k * i, n)
        return add(a, multiply(F.get(x, i), conj(root) if inverse else root))

    out = let(x, lambda x: F.transform(steps, lambda k: F.aggregate(steps, zero, lambda a, i: term(x, a, k, i))))
    return F.transform(out, lambda z: unscale(z, float(n))) if inverse else out


def as_complex(x: Column) -> Column:
    return F.transform(x, lambda v: complex_(v, F.lit(0.0)))


def row(coef: Column, cols: Column, r: Column | int) -> Column:
    """A row of a row-major matrix, from zero."""
    return F.slice(coef, F.lit(r) * cols + 1 if isinstance(r, int) else r * cols + 1, cols)
