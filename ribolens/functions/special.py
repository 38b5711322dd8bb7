"""Special functions and substitution models as vectorised column functions."""

from __future__ import annotations

from math import erfc, lgamma

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def log_gamma(x: pd.Series) -> pd.Series:
    """ln Gamma(x) for x > 0."""
    return x.map(lgamma, na_action="ignore").astype(float)


@pandas_udf(DoubleType())
def complementary_error(x: pd.Series) -> pd.Series:
    return x.map(erfc, na_action="ignore").astype(float)


def gamma_tails(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The regularised incomplete gamma functions P(a, x) and Q(a, x) = 1 - P: P by its power series below a + 1, above Q by
    its continued fraction (Lentz)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - np.vectorize(lgamma, otypes=[float])(a)) if len(a) else np.zeros(0)
    term = 1 / a
    series = term.copy()
    for n in range(1, 2000):
        term = term * x / (a + n)
        series += np.where(x < a + 1, term, 0)
        if (np.abs(term) < 1e-17 * np.abs(series))[x < a + 1].all():
            break
    b = np.where(x >= a + 1, x + 1 - a, 1.0)
    c, d = np.full_like(b, 1e300), 1 / b
    fraction = d.copy()
    for n in range(1, 2000):
        an = -n * (n - a)
        b = b + 2
        d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
        c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
        fraction = fraction * d * c
        if (np.abs(d * c - 1) < 1e-16)[x >= a + 1].all():
            break
    lower = np.where(x <= 0, 0.0, np.where(x < a + 1, front * series, 1 - front * fraction))
    return lower, np.where(x < a + 1, 1 - lower, front * fraction)


def _gamma(a: pd.Series, x: pd.Series, side: int) -> pd.Series:
    known = (a.notna() & x.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = gamma_tails(a.to_numpy(float)[known], x.to_numpy(float)[known])[side]
    return pd.Series(out, index=a.index).where(known, None)


@pandas_udf(DoubleType())
def incomplete_gamma(a: pd.Series, x: pd.Series) -> pd.Series:
    """P(a, x) for a > 0; null where either is."""
    return _gamma(a, x, 0)


@pandas_udf(DoubleType())
def upper_gamma(a: pd.Series, x: pd.Series) -> pd.Series:
    """Q(a, x) for a > 0, exact for small values too; null where either is. The tail of chi-square with k degrees of freedom
    from c on is Q(k / 2, c / 2)."""
    return _gamma(a, x, 1)


def substitution_probabilities(rates: list[list[float]], times: np.ndarray) -> np.ndarray:
    """e to the rate matrix times each time, [times, n, n], by its eigenvalues. Rows of rates sum to 0; the matrix is scaled to
    one substitution a unit of time under its stationary distribution."""
    q = np.array(rates, float)
    if np.abs(q.sum(axis=1)).max() > 1e-9 or (q - np.diag(np.diag(q)) < 0).any():
        raise ValueError("rows of rates sum to 0, and only the diagonal is negative")
    stationary = np.linalg.lstsq(np.vstack([q.T, np.ones(len(q))]), np.append(np.zeros(len(q)), 1), rcond=None)[0]
    q = q / -(stationary * np.diag(q)).sum()
    values, vectors = np.linalg.eig(q)
    return np.real(np.einsum("ij,tj,jk->tik", vectors, np.exp(np.outer(times, values)), np.linalg.inv(vectors)))
