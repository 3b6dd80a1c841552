"""Power transforms as columns, and maximum-likelihood powers by grid passes over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.base import scalars


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def box_cox(x: Column, lam: float) -> Column:
    return F.when(x > 0, F.ln(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam)


def box_cox_inverse(y: Column, lam: float) -> Column:
    return F.exp(y) if abs(lam) < 1e-12 else F.pow(y * lam + 1, F.lit(1 / lam))


def best_power(df: DataFrame, columns: dict[str, Column], kind: str = "yeo_johnson", low: float = -5.0, high: float = 5.0, points: int = 21, passes: int = 3) -> dict[str, float]:
    """Each column's power of most likelihood: a grid for all columns in one aggregate, refined around the best, a few times."""
    power = yeo_johnson if kind == "yeo_johnson" else box_cox
    span = {c: (low, high) for c in columns}
    best = {c: 1.0 for c in columns}
    for _ in range(passes):
        grid = {c: [lo + (hi - lo) * i / (points - 1) for i in range(points)] for c, (lo, hi) in span.items()}
        exprs: dict = {}
        for c, x in columns.items():
            weight = F.signum(x) * F.log1p(F.abs(x)) if kind == "yeo_johnson" else F.ln(x)
            exprs[c, "n"], exprs[c, "w"] = F.count(x), F.sum(weight)
            for lam in grid[c]:
                exprs[c, lam] = F.var_pop(power(x, lam))
        v = scalars(df, exprs)
        import math

        for c in columns:
            n, w = v[c, "n"] or 0, v[c, "w"] or 0.0
            fits = {lam: -n / 2 * math.log(v[c, lam]) + (lam - 1) * w for lam in grid[c] if v[c, lam] and v[c, lam] > 0 and math.isfinite(v[c, lam])}
            if fits:
                best[c] = max(fits, key=fits.__getitem__)
                step = (span[c][1] - span[c][0]) / (points - 1)
                span[c] = (best[c] - step, best[c] + step)
    return best
