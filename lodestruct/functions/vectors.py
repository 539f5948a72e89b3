"""Column expressions on 3-vectors and 3x3 matrices (arrays of nine, row by row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(names: Sequence[str], of: str = "") -> list[Column]:
    return [F.col(f"{of}{n}") for n in names]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def outer(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x * y for x in a for y in b]


def elements(matrix: Column) -> list[Column]:
    return [matrix[k] for k in range(9)]


def cofactors(m: Sequence[Column]) -> list[Column]:
    """Of each element, row by row."""
    out = []
    for r in range(3):
        for c in range(3):
            (r1, r2), (c1, c2) = ((r + 1) % 3, (r + 2) % 3), ((c + 1) % 3, (c + 2) % 3)
            out.append(m[3 * r1 + c1] * m[3 * r2 + c2] - m[3 * r1 + c2] * m[3 * r2 + c1])
    return out


def det(m: Sequence[Column]) -> Column:
    return dot(m[:3], cofactors(m)[:3])


def inverse(m: Sequence[Column]) -> list[Column]:
    """Nine elements of the inverse: transposed cofactors over the determinant."""
    c, d = cofactors(m), det(m)
    return [c[3 * k + r] / d for r in range(3) for k in range(3)]


def row_times(v: Sequence[Column], m: Sequence[Column]) -> list[Column]:
    """v M, for a row vector: fractional to Cartesian with the cell, back with its inverse."""
    return [v[0] * m[c] + v[1] * m[3 + c] + v[2] * m[6 + c] for c in range(3)]


def times_column(m: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    return [dot(m[3 * r : 3 * r + 3], v) for r in range(3)]


def column_norms(m: Sequence[Column]) -> list[Column]:
    return [norm([m[c], m[3 + c], m[6 + c]]) for c in range(3)]


def to_fractional(position: Sequence[Column], inverse_cell: Sequence[Column]) -> list[Column]:
    return row_times(position, inverse_cell)


def to_cartesian(fraction: Sequence[Column], cell: Sequence[Column]) -> list[Column]:
    return row_times(fraction, cell)


def cell_volume(cell: Column) -> Column:
    return F.abs(det(elements(cell)))


def cell_inverse(cell: Column) -> Column:
    return F.array(*inverse(elements(cell)))


def minimum_image(d: Sequence[Column], cell: Sequence[Column], inverse_cell: Sequence[Column], pbc: Column) -> list[Column]:
    """Displacement to the nearest image, by rounding fractional components along periodic axes."""
    f = to_fractional(d, inverse_cell)
    return to_cartesian([F.when(pbc[k], f[k] - F.rint(f[k])).otherwise(f[k]) for k in range(3)], cell)


def guarded_divide(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == index).cast("int"))


def voigt_to_matrix(v: Column) -> Column:
    """Nine elements from six (xx, yy, zz, yz, xz, xy) or from nine; null for any other length."""
    return F.when(F.size(v) == 6, F.array(*[v[k] for k in (0, 5, 4, 5, 1, 3, 4, 3, 2)])).when(F.size(v) == 9, v)
