"""Aggregates over posterior draws, as expressions over arrays of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what results say about the proxy.
ESS_CAVEAT = "heuristic only: assumes on-disk draw order == chain order and stops the autocorrelation sum at the first rho < 0.05, which biases ESS upward; not an MCMC convergence diagnostic (use Tracer/coda/arviz)"


def hdi(samples: Column, level: float = 0.95) -> Column:
    """struct(low, high): the narrowest interval of ceil(level * n) sorted samples, the first of
    several; nulls without samples. samples: an array without nulls."""
    if not 0 < level <= 1:
        raise ValueError("the level must lie in (0, 1]")
    x = F.array_sort(samples)
    n = F.size(samples)
    m = F.greatest(F.lit(1), F.ceil(F.lit(level) * n)).cast("int")
    spans = F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.struct((F.element_at(x, i + m - 1) - F.element_at(x, i)).alias("w"), i.alias("i")))
    first = F.array_min(spans)["i"]
    return F.when(n > 0, F.struct(F.element_at(x, first).alias("low"), F.element_at(x, first + m - 1).alias("high")))


def ess_proxy(samples: Column) -> Column:
    """n / (1 + 2 * sum of autocorrelations at lags 1 to 10, up to the first under 0.05); n for fewer
    than 10 samples or without variance. samples: an array in draw order."""
    n = F.size(samples)
    zero = F.lit(0.0)
    mean = F.aggregate(samples, zero, lambda s, v: s + v) / n
    x = F.transform(samples, lambda v: v - mean)
    power = F.aggregate(x, zero, lambda s, v: s + v * v)

    def rho(lag: Column) -> Column:
        return F.aggregate(F.zip_with(F.slice(x, F.lit(1), n - lag), F.slice(x, lag + 1, n - lag), lambda p, q: p * q), zero, lambda s, v: s + v) / power

    start = F.struct(zero.alias("sum"), F.lit(True).alias("on"))

    def add(s: Column, lag: Column) -> Column:
        on = s["on"] & (lag < n) & (rho(lag) >= 0.05)
        return F.struct((s["sum"] + F.when(on, rho(lag)).otherwise(0.0)).alias("sum"), on.alias("on"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, add)["sum"]
    return F.when((n < 10) | (power <= 0), n.cast("double")).otherwise(n / (1 + 2 * total))
