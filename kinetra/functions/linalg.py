"""Small fixed-size linear algebra, unrolled into Column expressions.

A vector is a list of three Columns; a rigid transform is a list of sixteen, row by row; T_a_b takes points of a into b.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]
Mat = Sequence[Column]
#: Below this angle (radians) the series stands for the closed form.
SMALL = 1e-6


def vec(array: Column, at: int = 0) -> list[Column]:
    """Three elements of an array from position ``at`` (from 0)."""
    return [F.get(array, F.lit(at + i)).cast("double") for i in range(3)]


def add(a: Vec, b: Vec) -> list[Column]:
    return [x + y for x, y in zip(a, b)]


def sub(a: Vec, b: Vec) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def scale(a: Vec, k: Column) -> list[Column]:
    return [x * k for x in a]


def dot(a: Vec, b: Vec) -> Column:
    return reduce(lambda s, t: s + t, [x * y for x, y in zip(a, b)])


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec, eps: float = 0.0) -> list[Column]:
    """a / |a|; null where |a| is not above eps."""
    n = norm(a)
    return [F.when(n > eps, x / n) for x in a]


def matrix(array: Column) -> list[Column]:
    """Sixteen elements of an array, row by row."""
    return [F.get(array, F.lit(i)) for i in range(16)]


def from_quaternion(q: Sequence[Column], t: Vec) -> list[Column]:
    """The transform of a scalar-first quaternion, normalised first, and a translation."""
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    w, x, y, z = (F.when(n > 0, c / n) for c in q)
    one, zero = F.lit(1.0), F.lit(0.0)
    return [
        one - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), t[0],
        2 * (x * y + w * z), one - 2 * (x * x + z * z), 2 * (y * z - w * x), t[1],
        2 * (x * z - w * y), 2 * (y * z + w * x), one - 2 * (x * x + y * y), t[2],
        zero, zero, zero, one,
    ]


def compose(a: Mat, b: Mat) -> list[Column]:
    """a * b of two rigid transforms."""
    out = []
    for r in range(3):
        row = a[4 * r : 4 * r + 4]
        out += [row[0] * b[c] + row[1] * b[4 + c] + row[2] * b[8 + c] + (row[3] if c == 3 else F.lit(0.0)) for c in range(4)]
    return [*out, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]


def inverse(a: Mat) -> list[Column]:
    """The inverse of a rigid transform: its rotation turned over, its translation taken back."""
    out = []
    for r in range(3):
        column = [a[r], a[4 + r], a[8 + r]]
        out += [*column, -dot(column, [a[3], a[7], a[11]])]
    return [*out, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]


def apply(a: Mat, p: Vec) -> list[Column]:
    """The point p, transformed."""
    return [dot(a[4 * r : 4 * r + 3], p) + a[4 * r + 3] for r in range(3)]


def _cosine(x: Column) -> Column:
    """x between -1 and 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)))


def translation_error(a: Mat, b: Mat) -> Column:
    return norm([a[i] - b[i] for i in (3, 7, 11)])


def rotation_error_deg(a: Mat, b: Mat) -> Column:
    """The angle between two rotations in degrees."""
    trace = sum((a[4 * i + j] * b[4 * i + j] for i in range(3) for j in range(3)), F.lit(0.0))
    return F.degrees(F.acos(_cosine((trace - 1) / 2)))


def exp_map(state: Sequence[Column]) -> list[Column]:
    """The transform of a twist (v, w): rotation by |w| about w, and the translation V v that goes with it."""
    v, w = state[:3], state[3:]
    a2 = dot(w, w)
    a = F.sqrt(a2)
    small = a < SMALL
    s = F.when(small, 1 - a2 / 6).otherwise(F.sin(a) / a)
    c = F.when(small, 0.5 - a2 / 24).otherwise((1 - F.cos(a)) / a2)
    d = F.when(small, 1 / F.lit(6.0) - a2 / 120).otherwise((a - F.sin(a)) / (a2 * a))
    k = [[F.lit(0.0), -w[2], w[1]], [w[2], F.lit(0.0), -w[0]], [-w[1], w[0], F.lit(0.0)]]
    out = []
    for i in range(3):
        k2 = [w[i] * w[j] - (a2 if i == j else F.lit(0.0)) for j in range(3)]
        eye = [F.lit(1.0 if i == j else 0.0) for j in range(3)]
        out += [eye[j] + s * k[i][j] + c * k2[j] for j in range(3)]
        out.append(dot([eye[j] + c * k[i][j] + d * k2[j] for j in range(3)], v))
    return [*out, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]


def log_map(t: Mat) -> list[Column]:
    """The twist (v, w) of a transform; near a half turn the axis comes from the diagonal, its largest part positive."""
    return log_twist(t, log_turn(t))


def log_turn(t: Mat) -> list[Column]:
    """The turn w of a transform's twist and its angle."""
    cos = _cosine((t[0] + t[5] + t[10] - 1) / 2)
    skew = [(t[9] - t[6]) / 2, (t[2] - t[8]) / 2, (t[4] - t[1]) / 2]
    sin = norm(skew)
    a = F.atan2(sin, cos)
    half = (cos < 0) & (sin < 1e-4)
    # near a half turn: (R + I) / 2 = axis axis^T; take the column of its largest diagonal element
    diag = [(t[0] + 1) / 2, (t[5] + 1) / 2, (t[10] + 1) / 2]
    off = {(0, 1): (t[1] + t[4]) / 4, (0, 2): (t[2] + t[8]) / 4, (1, 2): (t[6] + t[9]) / 4}
    cols = [[diag[0], off[0, 1], off[0, 2]], [off[0, 1], diag[1], off[1, 2]], [off[0, 2], off[1, 2], diag[2]]]
    most = F.greatest(*diag)
    axis = [F.when(diag[0] == most, cols[0][i] / F.sqrt(most)).when(diag[1] == most, cols[1][i] / F.sqrt(most)).otherwise(cols[2][i] / F.sqrt(most)) for i in range(3)]
    sign = F.when(dot(axis, skew) < 0, -1.0).otherwise(1.0)
    factor = F.when(a < SMALL, 1 + a * a / 6).otherwise(a / F.when(sin > 0, sin))
    w = [F.when(half, axis[i] * sign * a).otherwise(skew[i] * factor) for i in range(3)]
    return [*w, a]


def log_twist(t: Mat, turn: Sequence[Column]) -> list[Column]:
    """The twist (v, w) of a transform whose log_turn is known."""
    w, a = list(turn[:3]), turn[3]
    # v = (I - K / 2 + e K^2) t
    a2 = a * a
    e = F.when(a < 1e-3, F.lit(1 / 12) + a2 / 720).otherwise(1 / a2 - F.sin(a) / (2 * a * (1 - F.cos(a))))
    tr = [t[3], t[7], t[11]]
    wt = cross(w, tr)
    wwt = cross(w, wt)
    return [tr[i] - wt[i] / 2 + e * wwt[i] for i in range(3)] + w


def is_rigid(t: Mat, tolerance: float = 1e-6) -> Column:
    """Whether a transform is one: rows of length 1 at right angles, determinant 1, last row 0 0 0 1."""
    rows = [t[0:3], t[4:7], t[8:11]]
    ok = F.abs(dot(rows[0], cross(rows[1], rows[2])) - 1) <= 3 * tolerance
    for i in range(3):
        for j in range(i, 3):
            ok &= F.abs(dot(rows[i], rows[j]) - (1.0 if i == j else 0.0)) <= tolerance
    for i, x in enumerate((0.0, 0.0, 0.0, 1.0)):
        ok &= F.abs(t[12 + i] - x) <= 1e-8
    return F.coalesce(ok, F.lit(False))


def joint_angles(femur: Mat, tibia: Mat, right: bool) -> list[Column]:
    """Flexion, abduction and rotation in degrees, from R, the tibia's axes in those of the femur.

    Flexion is atan2(R23, R33). On the right side abduction is acos(R13) - 90 and rotation -atan2(R12, R11); on the left side both have the other sign.
    """
    r = lambda i, j: sum((femur[4 * k + i - 1] * tibia[4 * k + j - 1] for k in range(3)), F.lit(0.0))
    side = 1.0 if right else -1.0
    lean = F.degrees(F.acos(_cosine(r(1, 3)))) - 90
    return [F.degrees(F.atan2(r(2, 3), r(3, 3))), side * lean, -side * F.degrees(F.atan2(r(1, 2), r(1, 1)))]


def frame_of_markers(a: Vec, b: Vec, c: Vec, eps: float = 1e-9) -> tuple[list[Column], Column]:
    """A rigid body's transform from three markers, and whether it is degenerate (then the transform is null).

    Origin at the first marker, y towards the third, x towards the second at a right angle to y, z = x cross y.
    """
    y = unit(sub(c, a), eps)
    side = sub(b, a)
    flat = sub(side, scale(y, dot(side, y)))
    x = unit(flat, eps)
    z = cross(x, y)
    rows = []
    for i in range(3):
        rows += [x[i], y[i], z[i], a[i]]
    return [*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)], F.coalesce(norm(flat) <= eps, F.lit(True))
