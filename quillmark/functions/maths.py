"""Reward shaping, preference models, geometry and rotations as Column expressions."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGMOIDS = ("gaussian", "hyperbolic", "long_tail", "reciprocal", "cosine", "linear", "quadratic", "tanh_squared")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def sigmoid(x: Column, at_one: float, kind: str) -> Column:
    """MF1: 1 at 0 and ``at_one`` at 1. The curves that reach zero accept at_one 0."""
    if kind not in SIGMOIDS:
        raise ValueError(f"no such curve: {kind}")
    lowest_ok = 0 <= at_one < 1 if kind in ("cosine", "linear", "quadratic") else 0 < at_one < 1
    if not lowest_ok:
        raise ValueError(f"{kind} can't be {at_one} at 1")
    if kind == "gaussian":
        return F.exp(x * x * math.log(at_one))
    if kind == "hyperbolic":
        return 1 / F.cosh(x * math.acosh(1 / at_one))
    if kind == "long_tail":
        return 1 / (x * x * (1 / at_one - 1) + 1)
    if kind == "reciprocal":
        return 1 / (F.abs(x) * (1 / at_one - 1) + 1)
    if kind == "tanh_squared":
        t = F.tanh(x * math.atanh(math.sqrt(1 - at_one)))
        return 1 - t * t
    y = x * {"cosine": math.acos(2 * at_one - 1) / math.pi, "linear": 1 - at_one, "quadratic": math.sqrt(1 - at_one)}[kind]
    inside = {"cosine": (1 + F.cos(y * math.pi)) / 2, "linear": 1 - y, "quadratic": 1 - y * y}[kind]
    return F.when(F.abs(y) < 1, inside).otherwise(0.0)


def tolerance(x: Column, bounds: tuple = (0.0, 0.0), margin: float = 0.0, kind: str = "gaussian", at_margin: float = 0.1) -> Column:
    """MF2: 1 inside the bounds, falling to ``at_margin`` at ``margin`` beyond them."""
    low, high = bounds
    if low > high or margin < 0:
        raise ValueError("bounds must be ordered and the margin not negative")
    inside = x.between(F.lit(float(low)), F.lit(float(high)))
    if margin == 0:
        return F.when(inside, 1.0).otherwise(0.0)
    beyond = F.when(x < low, low - x).otherwise(x - high) / margin
    return F.when(inside, 1.0).otherwise(sigmoid(beyond, at_margin, kind))


def inverse_tolerance(x: Column, bounds: tuple = (0.0, 0.0), margin: float = 0.0, kind: str = "reciprocal") -> Column:
    """MF3: 0 inside the bounds. With a margin, curves that never reach zero are refused, the default among them."""
    return 1 - tolerance(x, bounds, margin, kind, 0.0)


def rect_prism_tolerance(point: list[Column], zero: list[float], one: list[float]) -> Column:
    """MF4: product of the three rises from ``zero`` to ``one``; 1 outside the prism."""
    inside, out = F.lit(True), F.lit(1.0)
    for p, a, b in zip(point, zero, one, strict=True):
        inside = inside & p.between(min(a, b), max(a, b))
        out = out * (p - a) / (b - a)
    return F.when(inside, out).otherwise(1.0)


def hamacher(a: Column, b: Column) -> Column:
    """MF5: ab / (a + b - ab), 0 where that divides by 0."""
    d = a + b - a * b
    return F.when(d > 0, a * b / d).otherwise(0.0)


def multi_factor_distance(l2: Column, d_reward: Column, d_time: Column, alpha: float = 1.0, beta: float = 0.0, gamma: float = 0.0) -> Column:
    """MF8."""
    return F.sqrt(alpha * l2 * l2 + beta * d_reward * d_reward + gamma * d_time * d_time)


def preference(sum1: Column, sum2: Column) -> Column:
    """MF9: chance that the first is preferred, stable for any difference."""
    return 1 / (1 + F.exp(sum2 - sum1))


def entropy(p: Column) -> Column:
    """MF9: of a two-way choice."""
    part = lambda q: F.when(q > 0, -q * F.log(q)).otherwise(0.0)
    return part(p) + part(1 - p)


def uniform(*keys: Column) -> Column:
    """A draw in [0, 1) by hash of the keys: the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys])), 1, 12), 16, 10).cast("double") / float(1 << 48)


def teacher_label(plain1: Column, plain2: Column, weighted1: Column, weighted2: Column, draw: Column, flip_draw: Column, beta: float = -1.0, eps: float = 0.0, equal: float = 0.0) -> Column:
    """MF10: 1 if the second is better; beta > 0 draws from the softmax; then mistakes; then near-equal sums give -1.

    Equality looks at undiscounted sums and is strict; a draw of exactly 0 is a mistake even at eps 0.
    """
    clear = F.when(weighted1 < weighted2, 1).otherwise(0)
    if beta > 0:
        clear = F.when(draw < 1 / (1 + F.exp(beta * (weighted1 - weighted2))), 1).otherwise(0)
    noisy = F.when(flip_draw <= eps, 1 - clear).otherwise(clear)
    return F.when(F.abs(plain1 - plain2) < equal, -1).otherwise(noisy)


def soft_target(label: Column, margin: float) -> Column:
    """MF11: two weights; -1 gives halves."""
    hit, miss = 1 - margin, margin
    return F.when(label == -1, F.array(F.lit(0.5), F.lit(0.5))).when(label == 0, F.array(F.lit(hit), F.lit(miss))).otherwise(F.array(F.lit(miss), F.lit(hit)))


def soft_cross_entropy(z1: Column, z2: Column, target: Column) -> Column:
    """MF12: over two logits, by log-sum-exp."""
    top = F.greatest(z1, z2)
    norm = top + F.log(F.exp(z1 - top) + F.exp(z2 - top))
    return -(target[0] * (z1 - norm) + target[1] * (z2 - norm))


def cross_entropy(z1: Column, z2: Column, label: Column) -> Column:
    """MF12: of label 0 or 1, finite however far the logits are apart."""
    d = F.when(label == 0, z2 - z1).otherwise(z1 - z2)
    return F.greatest(d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))


def cart_pole_step(x: Column, v: Column, a: Column, w: Column, force: Column) -> list[Column]:
    """MF13: (x, v, angle, rate) after one Euler step of 0.02 s; gravity 9.8, cart 1, pole 0.1, half length 0.5."""
    total, moment = 1.1, 0.05
    push = (force + moment * w * w * F.sin(a)) / total
    turn = (9.8 * F.sin(a) - F.cos(a) * push) / (0.5 * (4.0 / 3.0 - 0.1 * F.cos(a) * F.cos(a) / total))
    accel = push - moment * turn * F.cos(a) / total
    return [x + 0.02 * v, v + 0.02 * accel, a + 0.02 * w, w + 0.02 * turn]


def cart_pole_reward(angle: Column) -> Column:
    """MF13: minus the degrees from upright."""
    return -F.abs(F.degrees(angle))


def scaled_action(action: Column, low: Column, high: Column) -> Column:
    """MF15: from -1..1 to the bounds, clipped."""
    return F.least(F.greatest(low + (action + 1) * 0.5 * (high - low), low), high)


def controller(at: list[Column], to: list[Column], p: float) -> list[Column]:
    """MF16."""
    return [(b - a) * p for a, b in zip(at, to, strict=True)]


def label_budget(kind: int, per_round: int, step: Column, steps: int) -> Column:
    """MF17: labels asked in a round: 0 constant, 1 by the share of steps left (a hundredth at the end), 2 by its inverse."""
    if kind == 0:
        return F.lit(per_round)
    left = steps - step
    share = F.when(left == 0, 0.01).otherwise(left / steps) if kind == 1 else F.lit(float(steps)) / (left + 1)
    return F.floor(per_round * share).cast("int")


def labels_left(budget: Column, given: Column, most: int) -> Column:
    """MF17: a round's labels within what is left of ``most`` in all."""
    return F.greatest(F.lit(0), F.least(budget, F.lit(most) - given))


def teacher_margin(mean_return: Column, segment: int, episode_steps: int, share: float = 1.0) -> Column:
    """MF17: the margin under which a teacher skips a pair or calls it equal: a share of the mean return of a segment's length."""
    return mean_return * (segment / episode_steps) * share


def area(shape: Column, a: Column, b: Column, c: Column) -> Column:
    """MF18: the weight of a shape's surface; a, b, c are half sizes or radius and half length, and enter as if they were whole.

    So a box weighs a quarter of its true surface, and the sides of cylinders and capsules half; spheres are true, and
    ellipsoids follow Thomsen's formula with p 1.6. Points are allocated by these weights."""
    p = 1.6
    ellipsoid = 4 * math.pi * F.pow((F.pow(a * b, F.lit(p)) + F.pow(a * c, F.lit(p)) + F.pow(b * c, F.lit(p))) / 3, F.lit(1 / p))
    return (
        F.when(shape == "box", 2 * (a * b + b * c + a * c))
        .when(shape == "sphere", 4 * math.pi * a * a)
        .when(shape == "cylinder", 2 * math.pi * a * (a + b))
        .when(shape == "capsule", 4 * math.pi * a * a + 2 * math.pi * a * b)
        .when(shape == "ellipsoid", ellipsoid)
        .otherwise(0.0)
    )


def triangle_area(p: list[Column], q: list[Column], r: list[Column]) -> Column:
    """MF18: one face of a mesh."""
    u, v = [b - a for a, b in zip(p, q, strict=True)], [b - a for a, b in zip(p, r, strict=True)]
    x, y, z = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
    return F.sqrt(x * x + y * y + z * z) / 2


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def camera_distance(radius: Column, fov_degrees: float, slack: float = 1.2, least: float = 1e-3, most: float | None = None) -> Column:
    """MF20: far enough that a ball of ``radius`` fills the view; a ball of next to nothing counts as one of ``least``, and none is farther than ``most``."""
    away = F.when(radius < 1e-9, least).otherwise(radius) * slack / math.tan(math.radians(fov_degrees) / 2)
    return away if most is None else F.least(away, F.lit(float(most)))


# Rotations: quaternions are (w, x, y, z)


def quat_of_euler(x: Column, y: Column, z: Column) -> list[Column]:
    """MF14: rotation about x, then y, then z."""
    cx, sx, cy, sy, cz, sz = F.cos(x / 2), F.sin(x / 2), F.cos(y / 2), F.sin(y / 2), F.cos(z / 2), F.sin(z / 2)
    return [cx * cy * cz + sx * sy * sz, sx * cy * cz - cx * sy * sz, cx * sy * cz + sx * cy * sz, cx * cy * sz - sx * sy * cz]


def quat_product(p: list[Column], q: list[Column]) -> list[Column]:
    """MF14."""
    a, b, c, d = p
    w, x, y, z = q
    return [a * w - b * x - c * y - d * z, a * x + b * w + c * z - d * y, a * y - b * z + c * w + d * x, a * z + b * y - c * x + d * w]


def quat_conjugate(q: list[Column]) -> list[Column]:
    """MF14."""
    return [q[0], -q[1], -q[2], -q[3]]


def quat_matrix(q: list[Column]) -> list[list[Column]]:
    """MF14: the rotation matrix of a quaternion of any length but 0."""
    w, x, y, z = q
    s = 2 / (w * w + x * x + y * y + z * z)
    return [
        [1 - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y)],
        [s * (x * y + w * z), 1 - s * (x * x + z * z), s * (y * z - w * x)],
        [s * (x * z - w * y), s * (y * z + w * x), 1 - s * (x * x + y * y)],
    ]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def jacobi(m: Column, n: int, sweeps: int = 6) -> Column:
    """struct(k, v): eigenvalues on the diagonal of k and eigenvectors in the columns of v, of a symmetric n x n matrix in rows as one array.

    Turns of each pair of axes in turn, as an aggregate over the list of turns, so that the expression stays as short as one turn.
    """
    pairs = [(p, q) for p in range(n) for q in range(p + 1, n)]
    turns = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(sweeps)), lambda _: F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in pairs])))
    entry = lambda a, i, j: F.get(a, i * n + j)
    cells = F.sequence(F.lit(0), F.lit(n * n - 1))
    row, column = lambda i: F.floor(i / n).cast("int"), lambda i: i % n

    def mixed(a: Column, at: Callable, place: Callable[[Column], Column], t: Column, c: Column, s: Column) -> Column:
        """Rows or columns p and q of ``a`` turned into each other; ``place`` says in which of them a cell is."""
        return F.transform(cells, lambda i: F.when(place(i) == t.p, c * at(a, i, t.p) - s * at(a, i, t.q)).when(place(i) == t.q, s * at(a, i, t.p) + c * at(a, i, t.q)).otherwise(F.get(a, i)))

    in_column, in_row = lambda a, i, j: entry(a, row(i), j), lambda a, i, j: entry(a, j, column(i))

    def turned(state: Column, t: Column) -> Column:
        off, low, high = entry(state.k, t.p, t.q), entry(state.k, t.p, t.p), entry(state.k, t.q, t.q)
        angle = F.when(off == 0, 0.0).otherwise(0.5 * F.atan2(2 * off, high - low))

        def step(cs: Column) -> Column:
            k = _let(mixed(state.k, in_column, column, t, cs.c, cs.s), lambda half: mixed(half, in_row, row, t, cs.c, cs.s))
            return F.struct(k.alias("k"), mixed(state.v, in_column, column, t, cs.c, cs.s).alias("v"))

        return _let(_let(angle, lambda a: F.struct(F.cos(a).alias("c"), F.sin(a).alias("s"))), step)

    start = F.struct(m.cast("array<double>").alias("k"), F.array(*[F.lit(float(i == j)) for i in range(n) for j in range(n)]).alias("v"))
    return F.aggregate(turns, start, turned)


def quat_of_matrix(m: list[list[Column]]) -> Column:
    """MF14: array (w, x, y, z) of a rotation matrix, w not below 0: the leading eigenvector of a symmetric 4 x 4 matrix.

    A matrix that is only nearly a rotation gives that of the nearest one. At half turns (w 0) the sign is free.
    A matrix with a null or a number that is not finite gives null.
    """
    return _leading(*[c.cast("double") for row in m for c in row])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _leading(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series, g: pd.Series, h: pd.Series, i: pd.Series) -> pd.Series:
    """``quat_of_matrix`` of matrices in rows, a batch of 4 x 4 matrices at once."""
    m = np.stack([x.to_numpy(float) for x in (a, b, c, d, e, f, g, h, i)], axis=1).reshape(-1, 3, 3)
    whole = np.isfinite(m).all((1, 2))
    m, k = m[whole], np.empty((int(whole.sum()), 4, 4))
    both = m + m.transpose(0, 2, 1)
    k[:, :3, :3] = both
    diagonal = np.einsum("nii->ni", m)
    trace = diagonal.sum(1)
    for j in range(3):
        k[:, j, j] = 2 * diagonal[:, j] - trace
        at = (j + 2) % 3, (j + 1) % 3
        k[:, j, 3] = k[:, 3, j] = m[:, at[0], at[1]] - m[:, at[1], at[0]]
    k[:, 3, 3] = trace
    v = np.linalg.eigh(k / 3.0)[1][:, :, 3][:, [3, 0, 1, 2]]
    v = np.where(v[:, :1] < 0, -v, v)
    out = np.full(len(whole), None, object)
    out[np.flatnonzero(whole)] = pd.Series(list(v), dtype=object).to_numpy()
    return pd.Series(out)


def rotated(q: list[Column], v: list[Column]) -> list[Column]:
    """MF14."""
    return [row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in quat_matrix(q)]


def euler_of_matrix(m: list[list[Column]]) -> list[Column]:
    """MF14: the angles of ``quat_of_euler``."""
    flat = F.sqrt(m[0][0] * m[0][0] + m[1][0] * m[1][0])
    return [F.atan2(m[2][1], m[2][2]), F.atan2(-m[2][0], flat), F.atan2(m[1][0], m[0][0])]


def wrapped_angle(a: Column) -> Column:
    """MF14: in [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def placed(rotation: list[list[Column]], v: list[Column], at: list[Column]) -> list[Column]:
    """VP13: from a body's frame to the world's."""
    return [r[0] * v[0] + r[1] * v[1] + r[2] * v[2] + t for r, t in zip(rotation, at, strict=True)]


def long_tail(x: Column, high: Column | float, margin: Column, low: Column | float = 0.0) -> Column:
    """MF2 with a margin that differs by row: 1 from ``low`` to ``high``, then the long-tail curve to 0.1 at the margin."""
    beyond = F.when(x < low, low - x).otherwise(x - high)
    return F.when((x >= low) & (x <= high), 1.0).when(margin == 0, 0.0).otherwise(1 / (9 * F.pow(beyond / margin, F.lit(2.0)) + 1))


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def caging(
    effort: Column, obj: list[Column], start: list[Column], pads: tuple[Column, Column], tcp: list[Column], tcp_start: list[Column],
    radius: float, near: float, xz_near: float, reach: float = 0.0, effort_wanted: float = 1.0, density: str = "",
) -> Column:
    """MF6: how far a gripper holds an object: pads left and right of it (their y), the centre over it in x and z, and the effort.

    density: "high" averages with the caging alone, "medium" with the reach of the centre to the object.
    """
    if density not in ("", "high", "medium"):
        raise ValueError(f"no such density: {density}")
    sides = [long_tail(F.abs(p - obj[1]), near, F.abs(F.abs(p - start[1]) - near), radius) for p in pads]
    over = long_tail(distance([tcp[0], tcp[2]], [obj[0], obj[2]]), xz_near, distance([start[0], start[2]], [tcp_start[0], tcp_start[2]]) - xz_near)
    caged = hamacher(hamacher(*sides), over)
    closed = F.least(F.greatest(effort, F.lit(0.0)), F.lit(effort_wanted)) / effort_wanted
    held = hamacher(caged, F.when(caged > 0.97, closed).otherwise(0.0))
    if density == "high":
        return (held + caged) / 2
    if density == "medium":
        return (held + long_tail(distance(obj, tcp), reach, F.abs(distance(start, tcp_start) - reach))) / 2
    return held


def ball_reward(obj: list[Column], start: list[Column], target: list[Column], grasped: Column, radius: float = 0.07) -> list[Column]:
    """MF7, the exemplar task: (reward, distance to the target, in place, success) of a ball pushed into a goal."""
    scaled = lambda a, b: distance([a[0] * 3.0, a[1], a[2]], [b[0] * 3.0, b[1], b[2]])
    away, line = scaled(obj, target), target[1] - 0.1
    placed_ = long_tail(away, radius, scaled(obj, start))
    beside = (obj[1] > line) & (F.abs(obj[0] - target[0]) > 0.10)
    placed_ = F.when(beside, F.least(F.greatest(placed_ - 2 * (obj[1] - line) / (1 - line), F.lit(0.0)), F.lit(1.0))).otherwise(placed_)
    reward = F.when(away < radius, 10.0).otherwise(3 * grasped + 6.5 * placed_)
    return [reward, distance(obj, target), placed_, (distance(obj, target) <= 0.07).cast("double")]


def ball_grip(obj: list[Column], start: list[Column], tcp: list[Column], touching: Column, opened: Column) -> list[Column]:
    """MF7: (near the object, grasped): the gripper's centre within 0.03 of it; touched by an open gripper and lifted by over 0.02."""
    lifted = touching & (opened > 0) & (obj[2] - 0.02 > start[2])
    return [(distance(tcp, obj) <= 0.03).cast("double"), F.coalesce(lifted, F.lit(False)).cast("double")]


def parallel_rotations() -> list[list[list[int]]]:
    """MF14: the 24 rotations that turn axes into axes: signed permutations of determinant 1."""
    out = []
    for p in itertools.permutations(range(3)):
        odd = sum(p[i] > p[j] for i in range(3) for j in range(i + 1, 3)) % 2
        for signs in itertools.product((1, -1), repeat=3):
            if math.prod(signs) == (-1 if odd else 1):
                out.append([[signs[i] * (p[i] == j) for j in range(3)] for i in range(3)])
    return out
