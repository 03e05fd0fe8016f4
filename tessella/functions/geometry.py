"""Column expressions of the equi-angular cube-sphere (faces 0 to 5 are +X, -X, +Y, -Y, +Z, -Z)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_PI = math.pi / 2
#: Right, up and normal of each face.
BASES = (
    ((0, 0, -1), (0, -1, 0), (1, 0, 0)),
    ((0, 0, 1), (0, -1, 0), (-1, 0, 0)),
    ((1, 0, 0), (0, 0, 1), (0, 1, 0)),
    ((1, 0, 0), (0, 0, -1), (0, -1, 0)),
    ((1, 0, 0), (0, -1, 0), (0, 0, 1)),
    ((-1, 0, 0), (0, -1, 0), (0, 0, -1)),
)


def axis(face: Column, which: int) -> list[Column]:
    """The three components of a face's right (0), up (1) or normal (2)."""
    return [
        F.element_at(F.array(*[F.lit(float(b[which][c])) for b in BASES]), face.cast("int") + 1) for c in range(3)
    ]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def to_sphere(face: Column, u: Column, v: Column) -> list[Column]:
    """Unit vector of a face's (u, v)."""
    s, t = F.tan((u - 0.5) * HALF_PI), F.tan((v - 0.5) * HALF_PI)
    r, up, n = (axis(face, k) for k in range(3))
    q = [n[c] + s * r[c] + t * up[c] for c in range(3)]
    length = F.sqrt(dot(q, q))
    return [c / length for c in q]


def face_of(p: list[Column]) -> Column:
    """Face of the largest component; ties go to X, then Y."""
    x, y, z = (F.abs(c) for c in p)
    side = lambda c, k: F.when(c >= 0, k).otherwise(k + 1)
    return F.when((x >= y) & (x >= z), side(p[0], 0)).when(y >= z, side(p[1], 2)).otherwise(side(p[2], 4))


def project_to_face(face: Column, p: list[Column]) -> tuple[Column, Column]:
    """(u, v) on a given face; may leave [0, 1]."""
    d = dot(p, axis(face, 2))
    return tuple(F.atan(dot(p, axis(face, k)) / d) * (2 / math.pi) + 0.5 for k in (0, 1))


def jacobian(face: Column, u: Column, v: Column) -> tuple[list[Column], list[Column]]:
    """Tangent vectors d p / d u and d p / d v."""
    s, t = F.tan((u - 0.5) * HALF_PI), F.tan((v - 0.5) * HALF_PI)
    r, up, n = (axis(face, k) for k in range(3))
    q = [n[c] + s * r[c] + t * up[c] for c in range(3)]
    length = F.sqrt(dot(q, q))
    p = [c / length for c in q]

    def tangent(direction, slope):
        d = [c * slope for c in direction]
        along = dot(p, d)
        return [(d[c] - p[c] * along) / length for c in range(3)]

    return tangent(r, HALF_PI * (1 + s * s)), tangent(up, HALF_PI * (1 + t * t))


def metric(face: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """(g11, g12, g22) on the unit sphere."""
    a, b = jacobian(face, u, v)
    return dot(a, a), dot(a, b), dot(b, b)


def solve_tangent(w: list[Column], face: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """Components of a 3-vector in a face's tangent basis (least squares)."""
    a, b = jacobian(face, u, v)
    guu, guv, gvv, ru, rv = dot(a, a), dot(a, b), dot(b, b), dot(a, w), dot(b, w)
    det = guu * gvv - guv * guv
    return (gvv * ru - guv * rv) / det, (guu * rv - guv * ru) / det


def transfer_vector(face, u, v, a, b, face2, u2, v2) -> tuple[Column, Column]:
    """A tangent vector's components on another face, at the same point."""
    ju, jv = jacobian(face, u, v)
    return solve_tangent([a * ju[c] + b * jv[c] for c in range(3)], face2, u2, v2)


def arc(p: list[Column], q: list[Column]) -> Column:
    """Great-circle distance on the unit sphere."""
    return F.acos(F.least(F.greatest(dot(p, q), F.lit(-1.0)), F.lit(1.0)))


def rotate(p: list[Column], omega: list[Column], dt: float) -> list[Column]:
    """p turned about the pole omega by |omega| dt, normalised."""
    w = F.sqrt(dot(omega, omega))
    k = [c / w for c in omega]
    c, s, kp, kd = F.cos(w * dt), F.sin(w * dt), cross(k, p), dot(k, p)
    q = [F.when(w > 0, p[i] * c + kp[i] * s + k[i] * kd * (1 - c)).otherwise(p[i]) for i in range(3)]
    length = F.sqrt(dot(q, q))
    return [x / length for x in q]


def cell_of(u: Column, n: int) -> Column:
    """Index of the cell that holds a parameter in [0, 1]."""
    return F.least(F.floor(u * n), F.lit(n - 1)).cast("long")


def planet_radius(n: int, cell_m: float) -> float:
    """A face edge, a quarter of a great circle, is n cells long."""
    return n * cell_m * 4 / (2 * math.pi)


def area(face: Column, u: Column, v: Column, n: int, cell_m: float) -> Column:
    """Area of a cell of n per edge, in square metres."""
    guu, guv, gvv = metric(face, u, v)
    return F.sqrt(guu * gvv - guv * guv) * (planet_radius(n, cell_m) ** 2 / (n * n))
