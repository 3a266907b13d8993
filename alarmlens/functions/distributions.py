"""Tail probabilities that Spark has no functions for: vectorised over columns, and as SQL series for oracles.

A null argument gives null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Terms of the continued fraction; it converges in fewer for all degrees of freedom below about 10 ** 6.
TERMS = 300
#: Pairs of sample sizes up to this product have their exact rank distribution enumerated, if the smaller is at most 8.
EXACT_SIDE, EXACT_PRODUCT = 8, 20_000
#: Pairs up to which the signed-rank distribution is exact.
EXACT_PAIRS = 50

_lgamma = np.vectorize(lambda x: math.lgamma(x) if x > 0 else math.nan, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_tail(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        tail = np.zeros_like(y)
        for m in range(TERMS, 0, -1):  # from the innermost term outwards
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            tail = even / (1 + odd / (1 + tail))
        first = -(p + q) * y / (p + 1)
        part = np.where(y > 0, front / (1 + first / (1 + tail)), 0.0)
    return np.where(turn, 1 - part, part)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def chi2_tail(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tail: the power series of the lower incomplete gamma function, or the continued fraction of the upper one."""
    z, a = (np.asarray(v, float) / 2 for v in np.broadcast_arrays(x, df))
    a = np.where(a > 0, a, np.nan)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(-z + a * np.log(z) - _lgamma(a))
        term = total = 1 / a
        for n in range(1, 2 * TERMS):
            term = term * z / (a + n)
            total = total + term
        tail = np.zeros_like(z)
        for n in range(TERMS, 0, -1):
            tail = n * (n - a) / (z + 2 * n + 1 - a - tail)
        upper = front / (z + 1 - a - tail)
    return np.where(np.isnan(a), np.nan, np.where(z <= 0, 1.0, np.where(z < a + 1, 1 - front * total, upper)))


def rank_sum_tail(u: float, n1: int, n0: int) -> float:
    """P(U >= u) without ties: how many of all choices of ranks for the smaller group have such a sum."""
    m, n = min(n1, n0), n1 + n0
    least = u if n1 <= n0 else n1 * n0 - u  # the smaller group's U, whose distribution is symmetric
    counts = np.zeros((m + 1, m * n + 1))
    counts[0, 0] = 1
    for rank in range(1, n + 1):
        for k in range(m, 0, -1):
            counts[k, rank:] += counts[k - 1, : counts.shape[1] - rank]
    sums = counts[m]
    at = np.arange(len(sums)) - m * (m + 1) / 2
    keep = at >= least if n1 <= n0 else at <= least
    return float(sums[keep].sum() / sums.sum())


def signed_rank_two_sided(w: float, n: int) -> float:
    """2 P(W <= w) without ties or zeros, at most 1."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1
    for rank in range(1, n + 1):
        counts[rank:] = counts[rank:] + counts[: len(counts) - rank]
    return min(1.0, 2 * float(counts[: int(w) + 1].sum() / counts.sum()))


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_tail(z.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_sf2(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_tail(x.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def exact_rank_sum(u: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
    return pd.Series([rank_sum_tail(a, int(b), int(c)) if a == a else None for a, b, c in zip(u, n1, n0)], dtype=float)


@F.pandas_udf(DoubleType())
def exact_signed_rank(w: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_two_sided(a, int(b)) if a == a else None for a, b in zip(w, n)], dtype=float)


def chi2_sf_even(x: Column, df: int) -> Column:
    """Even degrees of freedom have a closed form."""
    total = term = F.lit(1.0)
    for k in range(1, df // 2):
        term = term * x / (2 * k)
        total = total + term
    return F.exp(-x / 2) * total


# The same for oracles: positive series, with logarithms of the gamma function.


def chi2_sf_sql(x: str, df: str) -> str:
    series = f"list_sum(list_transform(range(0, 500), lambda n: exp(-({x}) / 2 + (({df}) / 2.0::DOUBLE + n) * ln(({x}) / 2) - lgamma(({df}) / 2.0::DOUBLE + n + 1))))"
    return f"(CASE WHEN {x} <= 0 THEN 1 WHEN {x} > 300 THEN 0 ELSE greatest(0, 1 - {series}) END)"


def normal_sf_sql(z: str) -> str:
    half = f"0.5::DOUBLE * {chi2_sf_sql(f'(({z}) * ({z}))', '1')}"
    return f"(CASE WHEN {z} >= 0 THEN {half} ELSE 1 - {half} END)"


def t_sf2_sql(t: str, df: str) -> str:
    a, y = f"(({df}) / 2)", f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))"
    far = f"list_sum(list_transform(range(0, 2500), lambda n: exp(({a} + n) * ln(1 - {y}) + 0.5::DOUBLE * ln({y}) + lgamma({a} + 0.5::DOUBLE + n) - lgamma({a} + 1 + n) - lgamma(0.5::DOUBLE))))"
    near = f"list_sum(list_transform(range(0, 2500), lambda n: exp((0.5::DOUBLE + n) * ln({y}) + {a} * ln(1 - {y}) + lgamma({a} + 0.5::DOUBLE + n) - lgamma(1.5::DOUBLE + n) - lgamma({a}))))"
    return f"(CASE WHEN {t} = 0 THEN 1 WHEN {y} >= 0.5 THEN {far} ELSE greatest(0, 1 - {near}) END)"
