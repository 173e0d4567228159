"""Vectors, boxes and angles as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Column, b: Column) -> Column:
    return F.array(*[a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))])


def inverse(matrix: Column) -> Column:
    """The inverse of a rigid row-major 4x4 matrix: its rotation transposed, its translation turned back."""
    turned = [[matrix[4 * r + c] for r in range(3)] for c in range(3)]
    back = [-sum((turned[r][c] * matrix[4 * c + 3] for c in range(3)), F.lit(0.0)) for r in range(3)]
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*[v for r in range(3) for v in (*turned[r], back[r])], zero, zero, zero, one)


def applied(matrix: Column, point: Column) -> Column:
    """A point (x, y, z) moved by a row-major 4x4 matrix."""
    return F.array(*[sum((matrix[4 * r + c] * point[c] for c in range(3)), matrix[4 * r + 3]) for r in range(3)])


def corners(matrix: Column, w: Column, d: Column, h: Column) -> Column:
    """The eight corners of a box of these sizes around the matrix's origin."""
    signs = [(a, b, c) for a in (-0.5, 0.5) for b in (-0.5, 0.5) for c in (-0.5, 0.5)]
    return F.array(*[applied(matrix, F.array(w * a, d * b, h * c)) for a, b, c in signs])


def turned(a: Column, b: Column) -> Column:
    """Degrees between two headings, 0 to 180."""
    way = F.pmod(a - b, F.lit(360.0))
    return F.least(way, 360.0 - way)


def angle(a: Column, b: Column) -> Column:
    """Degrees between two vectors; rounding never leaves the cosine's range. Null for a vector of no length."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norm(a) * norm(b))))))


def decayed(value: Column, half: float) -> Column:
    """1 at 0, halved with each `half`."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), value) / half)
