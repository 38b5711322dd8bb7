"""Maximum likelihood fits by Newton steps: each step is one sum over all values, by key."""

from __future__ import annotations

from collections.abc import Callable
from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribolens.session import written

#: Newton steps; doubles settle in far fewer from these starts.
STEPS = 30


def _stepped(rows: DataFrame, start: DataFrame, terms: Callable[[Column], dict[str, Column]], score: Callable[[], Column], slope: Callable[[], Column], steps: int) -> DataFrame:
    """start(key, p, ...) with p after Newton steps on the score, whose sums over rows(key, x) are ``terms`` of p. A step that would
    leave the positive numbers halves p instead. A key's steps end when p settles to 12 digits; only the others go on."""
    live, done = written(start.withColumn("settled", F.col("p").isNull()), "fit"), None
    for _ in range(steps):
        ended, live = live.where("settled"), live.where("NOT settled")
        done = ended if done is None else done.unionByName(ended)
        if live.isEmpty():
            break
        sums = rows.join(live.select("key", "p"), "key").groupBy("key").agg(*[F.sum(x).alias(n) for n, x in terms(F.col("p")).items()])
        moved = live.join(sums, "key").withColumn("new", F.col("p") - score() / slope())
        new = F.when(F.col("new") > 0, F.col("new")).otherwise(F.col("p") / 2)
        live = written(moved.withColumns({"settled": F.abs(new - F.col("p")) <= 1e-12 * F.abs("p"), "p": new}).select(start.columns + ["settled"]), "fit")
    return done.unionByName(live).drop("settled")


def gumbel_fit(rows: DataFrame, censored: DataFrame | None = None, steps: int = STEPS) -> DataFrame:
    """(key, mu, lambda, n) of rows(key, x): the Gumbel distribution of the values of each key; also with censored(key, phi, z),
    z values known to lie at or under phi alone (phi under all x of the key).

    Exponents are taken against each key's least value, so they don't overflow. Null where all values are equal.
    """
    x = F.col("x")
    known = rows.where(x.isNotNull())
    start = known.groupBy("key").agg(F.min(x).alias("least"), F.avg(x).alias("mean"), F.count(F.lit(1)).cast("double").alias("n"), F.var_samp(x).alias("v"))
    start = start.withColumn("p", F.when(F.col("v") > 0, pi / F.sqrt(6 * F.col("v")))).drop("v")
    none = F.lit(0.0)
    if censored is None:
        start = start.withColumns({"phi": F.col("least"), "z": none})
    else:
        start = start.join(censored.select("key", F.col("phi").cast("double"), F.col("z").cast("double")), "key", "left")
        start = start.withColumns({"phi": F.coalesce("phi", "least"), "z": F.coalesce("z", none)})
    shifted = known.join(start.select("key", "least"), "key").select("key", (x - F.col("least")).alias("x"))
    terms = lambda p: {f"s{k}": F.pow("x", F.lit(float(k))) * F.exp(-p * F.col("x")) for k in range(3)}
    low = F.col("phi") - F.col("least")
    whole = lambda k: F.col(f"s{k}") + F.col("z") * F.pow(low, F.lit(float(k))) * F.exp(-F.col("p") * low)
    score = lambda: 1 / F.col("p") - (F.col("mean") - F.col("least")) + whole(1) / whole(0)
    slope = lambda: -1 / (F.col("p") * F.col("p")) + whole(1) * whole(1) / (whole(0) * whole(0)) - whole(2) / whole(0)
    fitted = written(_stepped(shifted, start, terms, score, slope, steps), "fitted")
    sums = shifted.join(fitted.select("key", "p"), "key").groupBy("key").agg(F.sum(F.exp(-F.col("p") * F.col("x"))).alias("s0"))
    mu = F.col("least") - F.log((F.col("s0") + F.col("z") * F.exp(-F.col("p") * low)) / (F.col("n"))) / F.col("p")
    return fitted.join(sums, "key").select("key", mu.alias("mu"), F.col("p").alias("lambda"), F.col("n").cast("long").alias("n"))


def weibull_fit(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """(key, lambda, tau, n) of rows(key, x): the Weibull distribution from 0 on of each key's values: 1 - exp(-(lambda x)^tau). Null
    where a value isn't positive or all are equal. Powers are taken against each key's largest value."""
    known = rows.where(F.col("x").isNotNull())
    logs = F.when(F.col("x") > 0, F.log("x"))
    start = known.groupBy("key").agg(F.max("x").alias("most"), F.min("x").alias("least"), F.avg(logs).alias("mean"), F.var_samp(logs).alias("v"), F.count(F.lit(1)).alias("n"))
    start = start.withColumn("p", F.when((F.col("least") > 0) & (F.col("v") > 0), pi / (sqrt(6) * F.sqrt("v")))).drop("v", "least")
    scaled = known.join(start.where("p IS NOT NULL").select("key", "most"), "key").select("key", F.log(F.col("x") / F.col("most")).alias("x"))
    terms = lambda p: {f"s{k}": F.pow("x", F.lit(float(k))) * F.exp(p * F.col("x")) for k in range(3)}
    score = lambda: 1 / F.col("p") + (F.col("mean") - F.log("most")) - F.col("s1") / F.col("s0")
    slope = lambda: -1 / (F.col("p") * F.col("p")) - F.col("s2") / F.col("s0") + F.col("s1") * F.col("s1") / (F.col("s0") * F.col("s0"))
    fitted = written(_stepped(scaled, start, terms, score, slope, steps), "fitted")
    sums = scaled.join(fitted.select("key", "p"), "key").groupBy("key").agg(F.sum(F.exp(F.col("p") * F.col("x"))).alias("s0"))
    met = fitted.join(sums, "key", "left")
    return met.select("key", (F.pow(F.col("n") / F.col("s0"), 1 / F.col("p")) / F.col("most")).alias("lambda"), F.col("p").alias("tau"), F.col("n").cast("long").alias("n"))
