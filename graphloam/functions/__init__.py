"""Column functions: density, conductance, overlap, belonging coefficients, heat-kernel scalars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The density of an empty set: the smallest positive normal double.
EMPTY = 2.2250738585072014e-308


def density(n: Column, w_in: Column, w_out: Column, lam: float = 0.0) -> Column:
    """(1-lam) w_in/(w_in+w_out) + lam * 2 w_in/(n(n-1)); an isolated vertex has the first term 0."""
    share = F.when(w_in + w_out == 0, F.lit(0.0)).otherwise(w_in / (w_in + w_out))
    inner = F.when(n == 1, F.lit(float(lam))).otherwise(F.lit(2.0 * lam) * w_in / (n * (n - 1)))
    return F.when(n < 1, F.lit(EMPTY)).otherwise(F.lit(1.0 - lam) * share + inner)


def conductance(cut: Column, volume: Column, total: Column) -> Column:
    """cut / min(volume, total - volume), 1 if either side is empty."""
    return F.when((volume <= 0) | (volume >= total), F.lit(1.0)).otherwise(cut / F.least(volume, total - volume))


def overlap(both: Column, a: Column, b: Column) -> Column:
    """Share of the smaller set that the two sets have in common."""
    return both / F.least(a, b)


COEFFICIENTS = {
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "mul": lambda a, b: a * b,
    "exp": lambda a, b: 1.0 / ((1.0 + F.exp(2.0 - a)) * (1.0 + F.exp(2.0 - b))),
}


def taylor_degree(t: float, eps: float) -> int:
    """Terms after which the rest of the series of e**t is at most eps * e**t, one at least."""
    rest, term, k = math.exp(t) - 1, 1.0, 0
    while True:
        k += 1
        term *= t / k
        rest -= term
        if rest <= eps * math.exp(t):
            return k


def psi(n: int, t: float) -> list[float]:
    """psi[n] = 1, psi[k] = 1 + psi[k+1] * t/(k+1)."""
    out = [1.0] * (n + 1)
    for k in reversed(range(n)):
        out[k] = 1 + out[k + 1] * t / (k + 1)
    return out


def push_thresholds(n: int, t: float, eps: float, kdd: bool = False) -> list[float]:
    """Residual per degree from which level j is pushed; ``kdd``: with psi[1] * eps in place of e**t * eps."""
    p = psi(n, t)
    scale = p[1] * eps if kdd else math.exp(t) * eps
    return [scale / (n * p[j]) for j in range(n)]


def push_budget(n_vertices: int) -> int:
    """The usual limit of pushes from one seed: n ** 1.5, rounded up."""
    return math.ceil(n_vertices**1.5)


def heat_time(alpha: float) -> float:
    """The larger t with e**t / t = 1 / (1 - alpha), by bisection."""
    want, lo, hi = 1 / (1 - alpha), 1.0, 700.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.exp(mid) / mid < want else (lo, mid)
    return (lo + hi) / 2


def jacobi(matrix: DataFrame, right: DataFrame, rounds: int = 100, tolerance: float = 1e-9, every: int = 5) -> DataFrame:
    """(i, x) with matrix (i, j, a) x = right (i, b), by Jacobi rounds: a join and a sum each, every vertex at once.

    It ends when no x changes by more than ``tolerance``, or after ``rounds``.  The diagonal must not hold zeros."""
    from ..operators.components import cut

    own = matrix.where("i = j").select("i", F.col("a").alias("d"))
    off = cut(matrix.where("i <> j"))
    base = cut(right.join(own, "i").select("i", "b", "d"))
    x = base.select("i", F.lit(0.0).alias("x"))
    for k in range(rounds):
        moved = off.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("a") * F.col("x")).alias("s"))
        new = base.join(moved, "i", "left").select("i", ((F.col("b") - F.coalesce("s", F.lit(0.0))) / F.col("d")).alias("x"))
        if k % every == every - 1:
            new = cut(new)
            if k >= every and new.join(mark, "i").where(F.abs(F.col("x") - F.col("m")) > tolerance).isEmpty():
                return new
            mark = new.withColumnRenamed("x", "m")
        x = new
    return x


def gauss_seidel(matrix: list[list[float]], right: list[float], rounds: int = 100, tolerance: float = 1e-12) -> list[float]:
    """The solution of a small dense system by Gauss-Seidel rounds, which use each new value at once."""
    x = [0.0] * len(right)
    for _ in range(rounds):
        most = 0.0
        for i, row in enumerate(matrix):
            new = (right[i] - sum(a * v for j, (a, v) in enumerate(zip(row, x, strict=True)) if j != i)) / row[i]
            most, x[i] = max(most, abs(new - x[i])), new
        if most <= tolerance:
            break
    return x
