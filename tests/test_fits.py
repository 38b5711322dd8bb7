"""Fits recover the parameters of drawn samples, and no other parameters near them are likelier."""

import numpy as np
import pytest

from ribolens.operators.fits import gumbel_fit, weibull_fit

RNG = np.random.default_rng(11)


def gumbel(mu, lam, n):
    return mu - np.log(-np.log(RNG.random(n))) / lam


def gumbel_likelihood(x, mu, lam, phi=None, z=0):
    y = lam * (x - mu)
    hidden = -z * np.exp(-lam * (phi - mu)) if z else 0.0
    return (np.log(lam) - y - np.exp(-y)).sum() + hidden


def frame(spark, samples):
    return spark.createDataFrame([(k, float(v)) for k, x in samples.items() for v in x] + [("same", 3.0), ("same", 3.0), ("a", None)], "key string, x double")


def test_gumbel(spark):
    samples = {"a": gumbel(20, 0.7, 3000), "b": gumbel(-1e4, 0.01, 3000), "c": gumbel(0, 50, 5)}
    got = {r.key: r for r in gumbel_fit(frame(spark, samples)).collect()}
    assert (got["a"].mu, got["a"]["lambda"]) == (pytest.approx(20, abs=0.15), pytest.approx(0.7, rel=0.05)) and got["same"]["lambda"] is None
    for k, x in samples.items():
        r = got[k]
        best = gumbel_likelihood(x, r.mu, r["lambda"])
        assert r.n == len(x) and all(gumbel_likelihood(x, r.mu + dm / r["lambda"], r["lambda"] * dl) < best for dm, dl in ((0.01, 1), (-0.01, 1), (0, 1.01), (0, 0.99)))


def test_censored_gumbel(spark):
    whole = gumbel(20, 0.7, 6000)
    phi = 20.5
    seen, z = whole[whole > phi], int((whole <= phi).sum())
    hidden = spark.createDataFrame([("a", phi, z)], "key string, phi double, z long")
    r = {r.key: r for r in gumbel_fit(frame(spark, {"a": seen}), hidden).collect()}["a"]
    assert (r.mu, r["lambda"]) == (pytest.approx(20, abs=0.15), pytest.approx(0.7, rel=0.05))
    best = gumbel_likelihood(seen, r.mu, r["lambda"], phi, z)
    assert all(gumbel_likelihood(seen, r.mu + dm, r["lambda"] * dl, phi, z) < best for dm, dl in ((0.02, 1), (-0.02, 1), (0, 1.01), (0, 0.99)))


def test_weibull(spark):
    samples = {"a": RNG.weibull(1.7, 4000) / 0.3, "b": RNG.weibull(0.6, 4000) * 1e5, "bad": np.array([1.0, -1.0, 2.0])}
    got = {r.key: r for r in weibull_fit(frame(spark, samples)).collect()}
    assert (got["a"]["lambda"], got["a"].tau) == (pytest.approx(0.3, rel=0.05), pytest.approx(1.7, rel=0.05)) and got["b"].tau == pytest.approx(0.6, rel=0.05)
    assert got["bad"].tau is None and got["same"].tau is None and got["bad"].n == 3
    x = samples["a"]
    like = lambda lam, tau: (np.log(lam * tau) + (tau - 1) * np.log(lam * x) - (lam * x) ** tau).sum()
    best = like(got["a"]["lambda"], got["a"].tau)
    assert all(like(got["a"]["lambda"] * a, got["a"].tau * b) < best for a, b in ((1.01, 1), (0.99, 1), (1, 1.01), (1, 0.99)))
