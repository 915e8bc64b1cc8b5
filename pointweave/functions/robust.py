"""Column functions: robust weights and losses of residuals, rigid motions held as arrays (r of 9, t of 3)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def huber(r: Column, delta: float) -> tuple[Column, Column]:
    """Weight and loss."""
    a = F.abs(r)
    return F.when(a <= delta, 1.0).otherwise(delta / a), F.when(a <= delta, 0.5 * a * a).otherwise(delta * (a - 0.5 * delta))


def cauchy(r: Column, c: float) -> tuple[Column, Column]:
    q = 1.0 + r * r / c**2
    return 1.0 / q, 0.5 * c**2 * F.log(q)


def tukey(r: Column, c: float) -> tuple[Column, Column]:
    t = 1.0 - r * r / c**2
    return F.when(F.abs(r) >= c, 0.0).otherwise(t * t), F.when(F.abs(r) >= c, c**2 / 6).otherwise(c**2 / 6 * (1.0 - t * t * t))


def turned(r: Column, t: Column) -> list[Column]:
    """The three components of r applied to t."""
    return [r[3 * i] * t[0] + r[3 * i + 1] * t[1] + r[3 * i + 2] * t[2] for i in range(3)]


def compose(r2: Column, t2: Column, r1: Column, t1: Column) -> tuple[Column, Column]:
    """First (r1, t1), then (r2, t2)."""
    r = [r2[3 * i] * r1[j] + r2[3 * i + 1] * r1[3 + j] + r2[3 * i + 2] * r1[6 + j] for i in range(3) for j in range(3)]
    return F.array(*r), F.array(*(c + t2[i] for i, c in enumerate(turned(r2, t1))))


def inverse(r: Column, t: Column) -> tuple[Column, Column]:
    back = F.array(*(r[3 * j + i] for i in range(3) for j in range(3)))
    return back, F.array(*(-c for c in turned(back, t)))


def plane_distance(x: Column, y: Column, z: Column, plane: tuple[float, float, float, float]) -> Column:
    return x * plane[0] + y * plane[1] + z * plane[2] + plane[3]
