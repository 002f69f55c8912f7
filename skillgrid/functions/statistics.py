"""Verification statistics as additive sums and a finishing expression.

A statistic names the sums it needs over a pair's forecast ``m`` and observation ``o``; sums of
all registered statistics are put into one aggregation, equal ones once. Sums add over months,
leads and updates, so every rollup starts from them and never from the pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10


@dataclass(frozen=True)
class Statistic:
    name: str
    sums: dict[str, Column]
    finalize: Callable[[dict[str, Column]], Column]


def pair_sums() -> dict[str, Column]:
    m, o = F.col("m"), F.col("o")
    d = m - o
    return {"n": F.lit(1).cast("long"), "sum_error": d, "sum_abs_error": F.abs(d), "sum_squared_error": d * d, "sum_model": m, "sum_obs": o, "sum_model_sq": m * m, "sum_obs_sq": o * o, "sum_cross": m * o}


def _mean(c: dict[str, Column], name: str) -> Column:
    return F.try_divide(c[name], c["n"].cast("double"))


def _correlation(c: dict[str, Column]) -> Column:
    n = c["n"].cast("double")
    cov = n * c["sum_cross"] - c["sum_model"] * c["sum_obs"]
    left = F.greatest(n * c["sum_model_sq"] - c["sum_model"] * c["sum_model"], F.lit(0.0))
    right = F.greatest(n * c["sum_obs_sq"] - c["sum_obs"] * c["sum_obs"], F.lit(0.0))
    scale = F.sqrt(left * right)
    ok = (c["n"] > 1) & (scale > EPSILON)
    return F.when(ok, F.least(F.greatest(F.try_divide(cov, scale) * 100.0, F.lit(-100.0)), F.lit(100.0)))


def statistics() -> list[Statistic]:
    s = pair_sums()
    pick = lambda *names: {k: s[k] for k in ("n", *names)}
    return [
        Statistic("bias", pick("sum_error"), lambda c: _mean(c, "sum_error")),
        Statistic("sacc", pick("sum_model", "sum_obs", "sum_model_sq", "sum_obs_sq", "sum_cross"), _correlation),
        Statistic("nrmse", pick("sum_squared_error", "sum_obs"), lambda c: F.sqrt(_mean(c, "sum_squared_error")) / (_mean(c, "sum_obs") + EPSILON) * 100.0),
        Statistic("nmad", pick("sum_abs_error", "sum_obs"), lambda c: _mean(c, "sum_abs_error") / (_mean(c, "sum_obs") + EPSILON) * 100.0),
    ]


def all_sums(registered: list[Statistic] | None = None) -> dict[str, Column]:
    """Sums of all statistics, equal ones once, and the count ``n``; two different sums under one name are an error."""
    out: dict[str, Column] = {"n": pair_sums()["n"]}
    for s in registered if registered is not None else statistics():
        for name, expr in s.sums.items():
            if str(out.setdefault(name, expr)) != str(expr):
                raise ValueError(f"two statistics have different sums called {name}")
    return out


def sum_names(registered: list[Statistic] | None = None) -> list[str]:
    return list(all_sums(registered))
