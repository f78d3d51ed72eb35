"""Array functions: similarity, blending, signal statistics, mixing curves."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def given(value: Column, f) -> Column:
    """f(value) with value computed once: a lambda variable is not expanded again."""
    return F.transform(F.array(value), f)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-9)


def lerp(a: Column, b: Column, alpha: float) -> Column:
    """alpha is the weight of a."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") * alpha + y * (1 - alpha))


def slerp_weights(cos: Column, alpha: float, eps: float = 1e-6) -> tuple[Column, Column]:
    theta = F.acos(F.greatest(F.least(cos, F.lit(1 - eps)), F.lit(-1 + eps)))
    s = F.greatest(F.sin(theta), F.lit(eps))
    near = theta < 1e-4
    return F.when(near, alpha).otherwise(F.sin(theta * alpha) / s), F.when(near, 1 - alpha).otherwise(F.sin(theta * (1 - alpha)) / s)


def slerp(a: Column, b: Column, alpha: float, eps: float = 1e-6) -> Column:
    """Direction on the sphere, length linear."""

    def blended(s: Column) -> Column:
        wa, wb = slerp_weights(s["cos"], alpha, eps)
        weights = F.struct((wa / s["na"]).alias("a"), (wb / s["nb"]).alias("b"), (s["na"] * alpha + s["nb"] * (1 - alpha)).alias("length"))
        return given(weights, lambda w: given(F.zip_with(a, b, lambda x, y: x.cast("double") * w["a"] + y * w["b"]), lambda v: given(w["length"] / F.greatest(norm(v), F.lit(eps)), lambda k: F.transform(v, lambda x: x * k))))

    lengths = F.struct(F.greatest(norm(a), F.lit(eps)).alias("na"), F.greatest(norm(b), F.lit(eps)).alias("nb"), dot(a, b).alias("ab"))
    return given(lengths, lambda s: given(F.struct(s["na"].alias("na"), s["nb"].alias("nb"), (s["ab"] / (s["na"] * s["nb"])).alias("cos")), blended))


def log_blend(a: Column, b: Column, alpha: float, eps: float = 1e-8) -> Column:
    """Magnitudes blended in log space; equal signs stay, else the sign of the heavier side."""
    size = lambda x: F.log(F.greatest(F.abs(x.cast("double")), F.lit(eps)))
    sign = lambda x, y: F.when(F.signum(x) == F.signum(y), F.signum(x)).otherwise(F.signum(x) if alpha > 0.5 else F.signum(y)).cast("double")
    return F.zip_with(a, b, lambda x, y: sign(x, y) * F.exp(size(x) * alpha + size(y) * (1 - alpha)))


def curve(x: Column, shape: str) -> Column:
    """0..1 to 0..1: linear, cosine or sigmoid(12 (x - 0.5))."""
    if shape == "linear":
        return x
    if shape == "cosine":
        return (1 - F.cos(x * math.pi)) / 2
    if shape == "sigmoid":
        return 1 / (1 + F.exp((x - 0.5) * -12))
    raise ValueError(shape)


def weight(x: Column, shape: str, start: float, end: float, extrapolate: bool = False) -> Column:
    w = F.lit(start) + curve(x, shape) * (end - start)
    return w if extrapolate else F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))


def combine(t: Column, n: Column, mode: str, extrapolate: bool = False) -> Column:
    """Weights over steps and frames: t_only, n_only, multiply, add, max, min."""
    w = {"t_only": t, "n_only": n, "multiply": t * n, "add": (t + n) / 2, "max": F.greatest(t, n), "min": F.least(t, n)}[mode]
    return w if extrapolate or mode in ("t_only", "n_only") else F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))


def grid_faults(grid: Column) -> Column:
    """Of an array of rows: empty, ragged (rows of unequal length) or not_finite, each if it applies."""
    sizes = F.transform(grid, lambda r: F.size(r))
    empty = (F.size(grid) == 0) | (F.array_min(sizes) < 1)
    odd = F.exists(F.flatten(grid), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.array_compact(F.array(F.when(F.coalesce(empty, F.lit(True)), F.lit("empty")), F.when(F.array_min(sizes) != F.array_max(sizes), F.lit("ragged")), F.when(odd, F.lit("not_finite"))))


def grid_weight(grid: list[list[float]], t: Column, frame: Column, n_frames: Column) -> Column:
    """Row by step int(t * (rows - 1)), linear resampling of the row to n_frames (ends aligned)."""
    cells, last = F.array(*[F.array(*map(F.lit, r)) for r in grid]), len(grid[0]) - 1
    row = F.get(cells, F.greatest(F.lit(0), F.least(F.lit(len(grid) - 1), F.floor(t * (len(grid) - 1)))).cast("int"))
    at = F.when(n_frames > 1, frame * last / (n_frames - 1)).otherwise(F.lit(0.0))
    lo = F.least(F.floor(at), F.lit(max(0, last - 1))).cast("int")
    return F.get(row, lo) * (1 - (at - lo)) + F.coalesce(F.get(row, lo + 1), F.get(row, lo)) * (at - lo)


def mono(channels: Column) -> Column:
    """Mean over channels of array<array<..>> (channel, sample)."""
    n = F.size(channels)
    return F.transform(F.sequence(F.lit(0), F.size(channels[0]) - 1), lambda i: F.aggregate(channels, F.lit(0.0), lambda s, c: s + c[i]) / n)


def rms(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v) / F.size(x))


def rms_floor(x: Column, target: float) -> Column:
    """Scaled up to the target where the RMS is lower."""
    r = rms(x)
    return F.when((r > 0) & (r < target), F.transform(x, lambda v: v.cast("double") * target / r)).otherwise(F.transform(x, lambda v: v.cast("double")))


def share(x: Column, test) -> Column:
    return F.size(F.filter(x, test)) / F.size(x)
