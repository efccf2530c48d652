"""Functions of short numeric series (arrays), as higher-order Column expressions.

Inside a lambda every outer expression is evaluated again for each element; what a lambda
uses of the whole series is therefore bound once with let().
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def gaps(times: Column) -> Column:
    """Positive differences of neighbouring times (microseconds, sorted) in seconds."""
    pairs = F.zip_with(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), times, lambda b, a: (b - a) / 1e6)
    return F.filter(pairs, lambda g: g > 0)


def _power(x: Column, mean: Column, k: int) -> Column:
    """Mean of (v - mean) ** k."""

    def one(v: Column) -> Column:
        d = v - mean
        return d * d if k == 2 else d * d * d

    return F.aggregate(x, F.lit(0.0), lambda a, v: a + one(v)) / F.size(x)


def moments(x: Column, least: int = 2) -> dict[str, Column]:
    """min, max, mean, std (population), cv; all 0 for fewer than `least` values."""
    mean = total(x) / F.size(x)
    std = F.sqrt(let(mean, lambda m: _power(x, m, 2)))
    zero = lambda c: F.when(F.size(x) >= least, c).otherwise(0.0)
    return {
        "iat_min": zero(F.array_min(x)), "iat_max": zero(F.array_max(x)), "iat_mean": zero(mean), "iat_std": zero(std),
        "iat_cv": zero(F.when(mean > 1e-5, std / mean).otherwise(0.0))
    }


def skewness(x: Column) -> Column:
    """Population skewness; 0 for fewer than 3 values or hardly any spread."""
    both = let(total(x) / F.size(x), lambda m: F.struct(_power(x, m, 2).alias("var"), _power(x, m, 3).alias("third")))
    ratio = let(both, lambda b: F.when(b["var"] > 1e-12, b["third"] / F.pow(b["var"], F.lit(1.5))).otherwise(0.0))
    return F.when(F.size(x) >= 3, ratio).otherwise(0.0)


def spectral_peak(x: Column, least: int = 6) -> Column:
    """Largest share of one frequency (not the constant) in the amplitude spectrum; 0 for fewer than `least` values.

    A fast Fourier transform per series in Arrow batches: written as expressions it would be quadratic.
    """

    @pandas_udf("double")
    def peak(series: pd.Series) -> pd.Series:
        def one(v) -> float:
            if v is None or len(v) < least:
                return 0.0
            a = np.asarray(v, float)
            spectrum = np.abs(np.fft.rfft(a - a.mean()))[1:]
            whole = spectrum.sum()
            return float(spectrum.max() / whole) if whole > 1e-9 else 0.0

        return series.map(one)

    return peak(x)


def timing(times: Column) -> Column:
    """Struct of iat_min, iat_max, iat_mean, iat_std, iat_cv and periodicity_score of sorted times (microseconds).

    Of the positive gaps; all 0 for fewer than 3 times or 2 gaps, the periodicity for fewer than 6. In Arrow batches, as spectral_peak.
    """
    names = ["iat_min", "iat_max", "iat_mean", "iat_std", "iat_cv", "periodicity_score"]

    @pandas_udf(", ".join(f"{n} double" for n in names))
    def stats(series: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(series), len(names)))
        for k, v in enumerate(series):
            if v is None or len(v) < 3:
                continue
            gaps = np.diff(np.asarray(v, np.int64)) / 1e6
            gaps = gaps[gaps > 0]
            if len(gaps) < 2:
                continue
            mean, std = gaps.mean(), gaps.std()
            out[k, :5] = gaps.min(), gaps.max(), mean, std, std / max(1e-5, mean)
            if len(gaps) >= 6:
                spectrum = np.abs(np.fft.rfft(gaps - mean))[1:]
                whole = spectrum.sum()
                out[k, 5] = spectrum.max() / whole if whole > 1e-6 else 0.0
        return pd.DataFrame(out, columns=names)

    return stats(times)


def autocorrelation_peak(x: Column, least: int = 6, lags: int = 9) -> Column:
    """Largest autocorrelation at lags 1 to `lags`; 0 for fewer than `least` values or hardly any spread."""
    n = F.size(x)

    def of(c: Column) -> Column:
        at = lambda lag: total(F.zip_with(F.slice(c, F.lit(1), n - lag), F.slice(c, lag + 1, n - lag), lambda a, b: a * b))
        power = total(F.transform(c, lambda v: v * v))
        peak = F.array_max(F.transform(F.sequence(F.lit(1), F.least(F.lit(lags), n - 1)), at))
        return F.when(power / n > 1e-12, peak / power).otherwise(0.0)

    centred = let(total(x) / n, lambda m: F.transform(x, lambda v: v - m))
    return F.when(n >= least, let(centred, of)).otherwise(0.0)


def value_entropy(x: Column) -> Column:
    """Entropy in bits of the values of an array: one walk over the sorted values."""
    weigh = lambda run: run * F.log2(F.greatest(run, F.lit(1.0)))

    def walk(s: Column) -> Column:
        start = F.struct(F.get(s, F.lit(0)).alias("at"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
        step = lambda a, v: F.when(
            v == a["at"], F.struct(a["at"].alias("at"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))
        ).otherwise(F.struct(v.alias("at"), F.lit(1.0).alias("run"), (a["sum"] + weigh(a["run"])).alias("sum")))
        return F.aggregate(s, start, step, lambda a: F.log2(F.size(s)) - (a["sum"] + weigh(a["run"])) / F.size(s))

    return F.when(F.size(x) == 0, 0.0).otherwise(let(F.array_sort(x), walk))
