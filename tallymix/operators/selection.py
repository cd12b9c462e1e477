"""Feature selection rules as SQL expressions over feature rows or cells.

Feature rows carry ``ea ARRAY, eb`` (expected logs), ``rx ARRAY`` (membership-weighted
sums) and ``colsum``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.special import EPS, array_sum, clip, digamma, num, sigmoid_clip


def xi_update(f: str, xi_1: str, xi_2: str, n: str = "1D") -> tuple[str, str]:
    """Beta parameters after seeing selection f on ``n`` samples."""
    return (
        f"greatest({xi_1} + {n} * {f}, {num(EPS)})",
        f"greatest({xi_2} + {n} * (1D - {f}), {num(EPS)})",
    )


def prior_odds(f: str, xi_1: str, xi_2: str, n: str = "1D", started: str = "started > 0") -> str:
    """Expected prior log-odds of selection (the common total cancels); the plain prior before the first update."""
    a, b = xi_update(f, xi_1, xi_2, n)
    return (
        f"(case when {started} then {digamma(a)} - {digamma(b)} else {digamma(xi_1)} - {digamma(xi_2)} end)"
    )


def signal_shared(rx: str = "rx", colsum: str = "colsum") -> str:
    """Gain of the group profiles over the background for one feature."""
    return f"({array_sum(f'zip_with({rx}, ea, (s, e) -> s * e)')} - {colsum} * eb)"


def select_shared(odds: str, rx: str = "rx", colsum: str = "colsum") -> str:
    return sigmoid_clip(f"{odds} + {signal_shared(rx, colsum)}")


def select_per_cluster(odds: str = "odds", rx: str = "rx") -> str:
    """Array of selection values; ``odds`` is an array too."""
    gain = f"zip_with({rx}, ea, (s, e) -> s * (e - eb))"
    return f"zip_with({odds}, {gain}, (o, g) -> {sigmoid_clip('o + g')})"


def cell_prior(df: DataFrame) -> DataFrame:
    """Add the Beta parameters ``xa, xb`` of each cell; the plain prior before the first update."""
    return df.selectExpr("*", "xi_1 + started * f as xa", "xi_2 + started * (1D - f) as xb")


CELL_ODDS = f"{digamma('xa')} - {digamma('xb')}"


def select_per_sample(width: int, odds: str = CELL_ODDS) -> str:
    """One cell: columns ``r0.., ea0.., eb, x, xa, xb``."""
    own = " + ".join(f"coalesce(r{k} * ea{k}, 0D)" for k in range(width))
    return sigmoid_clip(f"{odds} + x * ({own} - eb)")


def select_ssl(signal: str = "signal") -> str:
    """Spike-and-slab rule: data signal, ratio of the two scales, reward, inclusion rate."""
    return sigmoid_clip(f"{signal} + log_ratio + slope * greatest({signal}, 0D) + rate_odds")


def select_ssl_excess(excess: str = "excess") -> str:
    return sigmoid_clip(f"log_ratio + slope * {excess} + rate_odds")


def discriminative_signal(share: str = "share") -> str:
    """Mean distance of the group profiles from the background, weighted by group share."""
    return array_sum(f"zip_with({share}, ea, (w, e) -> w * abs(e - eb))")


def rate_prior(n_features: int, kappa: float) -> float:
    s = max(n_features, 2)
    return s ** (1.0 + kappa) / math.log(s)


def ssl_rate(sum_xi: float, n_features: int, beta_theta: float) -> float:
    """Posterior mean inclusion rate."""
    return min(max((1.0 + sum_xi) / (1.0 + beta_theta + n_features), EPS), 1.0 - EPS)


def ssl_rate_table(df: DataFrame, xi: str, kappa: float) -> DataFrame:
    """The same from a feature table, as one row."""
    sums = df.selectExpr(f"{xi} as xi").groupBy().agg(F.sum("xi").alias("sum_xi"), F.expr("cast(count(*) as double) as s"))
    sums = sums.withColumn("beta_theta", F.expr(f"pow(greatest(s, 2D), {num(1.0 + kappa)}) / ln(greatest(s, 2D))"))
    return sums.selectExpr(
        "sum_xi", "beta_theta", f"{clip('(1D + sum_xi) / (1D + beta_theta + s)', EPS, 1.0 - EPS)} as theta"
    )


def null_quantile(theta: float) -> float:
    """Share of features taken as noise, as a fraction."""
    share = min(max(3.0 * theta, 0.05), 0.40)
    return min(max(1.0 - share, 0.50), 0.90)


def exact_quantile(df: DataFrame, value: str, q: float, slots: int = 4096) -> float:
    """Exact interpolated quantile of one column."""
    return exact_quantiles(df.selectExpr("0 as k", f"{value} as v"), "k", "v", {0: q}, slots)[0]


def exact_quantiles(df: DataFrame, key: str, value: str, q: dict[int, float], slots: int = 4096) -> dict[int, float]:
    """Exact interpolated quantile of each key's values, at a share of its own.

    Each round counts the values of the range that holds the wanted rank in ``slots``
    equal slots and goes on with one of them, until one value is left. All keys share
    the rounds; a task or the driver holds at most ``slots`` numbers per key.
    """
    rows = df.selectExpr(f"{key} as k", f"{value} as v").where("v is not null")
    ranges = {r["k"]: r for r in rows.groupBy("k").agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    if any(k not in ranges for k in q):
        raise ValueError("no rows")
    place = {k: (ranges[k]["n"] - 1) * share for k, share in q.items()}
    low, high = ({k: ranges[k][side] for k in q} for side in ("low", "high"))
    rank = {k: math.floor(p) for k, p in place.items()}
    spark = df.sparkSession
    while wide := [k for k in q if low[k] < high[k]]:
        bounds = spark.createDataFrame([(k, low[k], high[k]) for k in wide], "k int, low double, high double")
        inside = rows.join(F.broadcast(bounds), "k").where("v between low and high")  # one row per key
        slot = f"cast(least(floor((v - low) / (high - low) * {slots}), {slots - 1}) as int)"
        counted = inside.withColumn("slot", F.expr(slot)).groupBy("k", "slot").agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        done = set()
        for r in sorted(counted.collect(), key=lambda r: (r["k"], r["slot"])):
            k = r["k"]
            if k in done:
                continue
            if rank[k] < r["n"]:
                low[k], high[k] = r["low"], r["high"]
                done.add(k)
            else:
                rank[k] -= r["n"]
    bounds = spark.createDataFrame([(k, low[k]) for k in q], "k int, at double")
    after = rows.join(F.broadcast(bounds), "k").groupBy("k").agg(
        F.count_if(F.col("v") <= F.col("at")).alias("n"), F.min(F.when(F.col("v") > F.col("at"), F.col("v"))).alias("v"))
    out = {}
    for r in after.collect():
        k = r["k"]
        follows = low[k] if r["v"] is None or r["n"] > math.floor(place[k]) + 1 else r["v"]
        out[k] = low[k] + (follows - low[k]) * (place[k] - math.floor(place[k]))
    return out


def select_stochastic(mass: str, own: str, other: str, prior: str, old: str, step: float) -> str:
    """Batch update of per-group selection; groups with almost no mass keep their value.

    ``own`` and ``other`` are scaled batch log-likelihoods under the group and the background.
    """
    yes, no = f"({own} + ln({prior}))", f"({other} + ln(1D - {prior}))"
    p, q = f"exp({yes} - greatest({yes}, {no}))", f"exp({no} - greatest({yes}, {no}))"
    fresh = f"{p} / ({p} + {q} + {num(EPS)})"
    return f"case when {mass} < 0.1D then {old} else {num(1.0 - step)} * {old} + {num(step)} * ({fresh}) end"
