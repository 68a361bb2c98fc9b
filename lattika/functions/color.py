"""Colour and component transforms as column expressions. Integer forms widen to BIGINT, so nothing overflows under ANSI rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The irreversible colour matrix and its inverse.
ICT = ((0.299, 0.587, 0.114), (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312))
ICT_INVERSE = ((1.0, 0.0, 1.402), (1.0, -0.344136, -0.714136), (1.0, 1.772, 0.0))


def rct_forward(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Reversible transform: Y = (R + 2G + B) >> 2, Cb = B - G, Cr = R - G."""
    r, g, b = (c.cast("bigint") for c in (r, g, b))
    return F.shiftright(r + 2 * g + b, 2), b - g, r - g


def rct_inverse(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    y, cb, cr = (c.cast("bigint") for c in (y, cb, cr))
    g = y - F.shiftright(cb + cr, 2)
    return cr + g, g, cb + g


def matrix_transform(columns: list[Column], matrix: tuple[tuple[float, ...], ...]) -> list[Column]:
    """out_i = sum over j of M_ij x_j, the sum from left to right."""
    out = []
    for row in matrix:
        total = None
        for m, c in zip(row, columns, strict=True):
            term = F.lit(float(m)) * c.cast("double")
            total = term if total is None else total + term
        out.append(total)
    return out


def matrix_transform_integer(columns: list[Column], matrix: tuple[tuple[float, ...], ...]) -> list[Column]:
    """The same, rounded half away from zero."""
    return [F.round(c).cast("bigint") for c in matrix_transform(columns, matrix)]


def invert(matrix: tuple[tuple[float, ...], ...]) -> tuple[tuple[float, ...], ...]:
    """The inverse of a square matrix; raises if it is singular."""
    import numpy as np

    m = np.array(matrix, float)
    if abs(np.linalg.det(m)) < 1e-12:
        raise ValueError("the matrix is singular")
    return tuple(map(tuple, np.linalg.inv(m).tolist()))


def transpose(matrix: tuple[tuple[float, ...], ...]) -> tuple[tuple[float, ...], ...]:
    return tuple(zip(*matrix, strict=True))


def reconstructs(matrix: tuple[tuple[float, ...], ...], tolerance: float = 1e-6) -> bool:
    """Whether the matrix times its inverse is the unit matrix within the tolerance."""
    import numpy as np

    return bool(np.abs(np.array(matrix) @ np.array(invert(matrix)) - np.eye(len(matrix))).max() <= tolerance)


def dependency_transform(columns: list[Column], chain: list[tuple[int, dict[int, float]]]) -> list[Column]:
    """In order, out[i] = in[i] - sum of w * out[j]; j may have been transformed before."""
    out = list(columns)
    for i, weights in chain:
        for j, w in weights.items():
            out[i] = out[i] - F.lit(float(w)) * out[j]
    return out


def dependency_inverse(columns: list[Column], chain: list[tuple[int, dict[int, float]]]) -> list[Column]:
    """Undoes dependency_transform, last step first."""
    return dependency_transform(columns, [(i, {j: -w for j, w in reversed(weights.items())}) for i, weights in reversed(chain)])


def staged_transform(columns: list[Column], stages: list[list[tuple[int, dict[int, float]]]], inverse: bool = False) -> list[Column]:
    """Dependency chains one after the other over the same components, or their inverses from the last to the first."""
    for chain in reversed(stages) if inverse else stages:
        columns = (dependency_inverse if inverse else dependency_transform)(columns, chain)
    return columns


def ict_forward(r: Column, g: Column, b: Column) -> list[Column]:
    return matrix_transform([r, g, b], ICT)


def ict_inverse(y: Column, cb: Column, cr: Column) -> list[Column]:
    return matrix_transform([y, cb, cr], ICT_INVERSE)


def grayscale(r: Column, g: Column, b: Column) -> Column:
    """Integer luminance: (306 R + 601 G + 117 B + 512) >> 10."""
    return F.shiftright(306 * r.cast("bigint") + 601 * g.cast("bigint") + 117 * b.cast("bigint") + 512, 10)


def grey_to_colours(grey: Column) -> tuple[Column, Column, Column]:
    """The same value in each channel."""
    return grey, grey, grey


def color_space(n_components: Column) -> Column:
    """By component count alone."""
    return F.when(n_components == 1, "grayscale").when(n_components.isin(3, 4), "sRGB").otherwise("unknown")
