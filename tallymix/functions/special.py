"""Numeric building blocks as SQL expressions.

Spark SQL has neither digamma nor log-gamma. Both are composed here from plain
arithmetic, so they stay JVM-side. Formulas are kept as SQL text: the functions take a
column name or expression and return text for ``F.expr`` / ``selectExpr``, also usable
inside ``transform`` and ``aggregate``. ``*_value`` twins work on Python floats for the
K-row arithmetic between jobs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-10  # floor used for memberships, probabilities and stick parameters

# Coefficients of the asymptotic series of digamma and log-gamma.
DIGAMMA_SERIES = (1 / 12, 1 / 120, 1 / 252, 1 / 240, 1 / 132)
LGAMMA_SERIES = (1 / 12, 1 / 360, 1 / 1260, 1 / 1680, 1 / 1188)
HALF_LOG_TWO_PI = 0.5 * math.log(2 * math.pi)


def num(v: float) -> str:
    """A double literal."""
    return f"{float(v)!r}D"


def _alternating(inv: str, coefficients) -> str:
    """c0 - inv*(c1 - inv*(c2 - ...))"""
    acc = num(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        acc = f"({num(c)} - {inv}*{acc})"
    return acc


def digamma(x: str) -> str:
    """psi(x) for x > 0: the argument is shifted by 8, the eight terms 1/(x+i) pair up over t = x(x+7).

    Equal parts of the text are evaluated once by generated code as long as ``x`` is a
    column, so stage longer arguments in a select first.
    """
    x = f"({x})"
    t, w = f"({x}*({x}+7D))", f"(1D/({x}+8D))"
    pairs = f"(2D*{x}+7D)*((2D*{t}+12D)/({t}*({t}+12D)) + (2D*{t}+16D)/(({t}+6D)*({t}+10D)))"
    return f"(ln({x}+8D) - 0.5D*{w} - ({w}*{w})*{_alternating(f'({w}*{w})', DIGAMMA_SERIES)} - {pairs})"


def lgamma(x: str) -> str:
    """ln Gamma(x) for x > 0."""
    x = f"({x})"
    t, w = f"({x}*({x}+7D))", f"(1D/({x}+8D))"
    stirling = f"({x}+7.5D)*ln({x}+8D) - ({x}+8D) + {num(HALF_LOG_TWO_PI)} + {w}*{_alternating(f'({w}*{w})', LGAMMA_SERIES)}"
    return f"({stirling} - ln({t}*({t}+6D)*({t}+10D)*({t}+12D)))"


def digamma_value(x: float) -> float:
    return float(digamma_array(np.float64(x)))


def digamma_array(x: np.ndarray) -> np.ndarray:
    """psi for the block kernels."""
    t, y = x * (x + 7.0), x + 8.0
    inv = 1.0 / (y * y)
    acc = DIGAMMA_SERIES[-1]
    for c in reversed(DIGAMMA_SERIES[:-1]):
        acc = c - inv * acc
    pairs = (2.0 * x + 7.0) * (1.0 / t + 1.0 / (t + 6.0) + 1.0 / (t + 10.0) + 1.0 / (t + 12.0))
    return np.log(y) - 0.5 / y - inv * acc - pairs


def lgamma_array(x: np.ndarray) -> np.ndarray:
    """ln Gamma for the block kernels."""
    t, y = x * (x + 7.0), x + 8.0
    inv = 1.0 / (y * y)
    acc = LGAMMA_SERIES[-1]
    for c in reversed(LGAMMA_SERIES[:-1]):
        acc = c - inv * acc
    return (y - 0.5) * np.log(y) - y + HALF_LOG_TWO_PI + acc / y - np.log(t * (t + 6.0) * (t + 10.0) * (t + 12.0))


def lgamma_value(x: float) -> float:
    return math.lgamma(x)


def clip(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {num(low)}), {num(high)})"


def sigmoid_clip(x: str, eps: float = EPS) -> str:
    """Logistic function of the argument held in +-500, result held in (eps, 1-eps)."""
    return clip(f"1D/(1D + exp(-({clip(x, -500, 500)})))", eps, 1.0 - eps)


def sigmoid_clip_value(x: float, eps: float = EPS) -> float:
    p = 1.0 / (1.0 + math.exp(-min(max(x, -500.0), 500.0)))
    return min(max(p, eps), 1.0 - eps)


def array_sum(a: str) -> str:
    """Sum of an array's non-null elements."""
    return f"aggregate({a}, 0D, (acc, v) -> acc + coalesce(v, 0D))"


def with_softmax(df: DataFrame, logits: str, out: str, floor: float | None = EPS, log_norm: str | None = None) -> DataFrame:
    """Add memberships ``out`` from an array of logits, max-shifted.

    With ``floor`` they are lifted to it and made to sum to one again; ``log_norm`` names
    a column for the log normaliser.
    """
    df = df.withColumn("_top", F.array_max(logits))
    df = df.withColumn("_e", F.expr(f"transform({logits}, v -> exp(v - _top))"))
    df = df.withColumn("_s", F.expr(array_sum("_e")))
    if log_norm:
        df = df.withColumn(log_norm, F.expr("_top + ln(_s)"))
    if floor is None:
        return df.withColumn(out, F.expr("transform(_e, v -> v / _s)")).drop("_top", "_e", "_s")
    df = df.withColumn("_e", F.expr(f"transform(_e, v -> greatest(v / _s, {num(floor)}))"))
    return normalised(df.drop("_top", "_s"), "_e", out)


def normalised(df: DataFrame, a: str, out: str) -> DataFrame:
    """Replace an array column by one that sums to one."""
    df = df.withColumn("_n", F.expr(array_sum(a)))
    return df.withColumn(out, F.expr(f"transform({a}, v -> v / _n)")).drop(a, "_n")


def hash_uniform(*cols: str, seed: int = 0) -> str:
    """A repeatable draw from [0, 1) per row: same keys and seed, same number.

    The first 52 bits of the md5 of the keys' text and the seed, so that any engine, and ``hash_uniform_value``,
    draw the same. Null keys are left out of the text.
    """
    keys = ", ".join(f"cast({c} as string)" for c in cols)
    return f"(cast(conv(substr(md5(concat_ws('|', {keys}, '{int(seed)}')), 1, 13), 16, 10) as bigint) / {num(1 << 52)})"


def hash_uniform_value(*keys, seed: int = 0) -> float:
    text = "|".join([*(str(k) for k in keys), str(int(seed))])
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:13], 16) / (1 << 52)


def beta_kl(a: str, b: str, a0: str, b0: str) -> str:
    """KL divergence of Beta(a, b) from Beta(a0, b0)."""
    s, s0 = f"{a} + {b}", f"{a0} + {b0}"
    prior = f"{lgamma(s0)} - {lgamma(a0)} - {lgamma(b0)}"
    shift = f"(({a}) - ({a0}))*({digamma(a)} - {digamma(s)}) + (({b}) - ({b0}))*({digamma(b)} - {digamma(s)})"
    return f"({prior} - {lgamma(s)} + {lgamma(a)} + {lgamma(b)} + {shift})"


def beta_kl_value(a: float, b: float, a0: float, b0: float) -> float:
    psi, lg, s = digamma_value, math.lgamma, a + b
    prior = lg(a0 + b0) - lg(a0) - lg(b0)
    return prior - lg(s) + lg(a) + lg(b) + (a - a0) * (psi(a) - psi(s)) + (b - b0) * (psi(b) - psi(s))


def dirichlet_kl(df: DataFrame, keys: list[str], value: str, prior: float) -> DataFrame:
    """KL divergence of the Dirichlet held as rows from the symmetric one, per key."""
    c = num(prior)
    sums = df.groupBy(*keys).agg(
        F.sum(value).alias("total"),
        F.count(value).cast("double").alias("dim"),
        F.expr(f"sum({lgamma(value)})").alias("sum_lg"),
        F.expr(f"sum(({value} - {c}) * {digamma(value)})").alias("sum_lin"),
        F.expr(f"sum({value} - {c})").alias("sum_dev"),
    )
    kl = (
        f"{lgamma(f'dim * {c}')} - dim * {num(lgamma_value(prior))} - {lgamma('total')} + sum_lg"
        f" + sum_lin - {digamma('total')} * sum_dev"
    )
    return sums.select(*keys, F.expr(kl).alias("kl"))
