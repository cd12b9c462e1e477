"""Mixture-weight priors: update from group masses, expected log weight, mean weight.

Two forms: tables ``(keys, k, mass)`` with window sums for any number of models, and
the K numbers a fit holds between two jobs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.special import EPS, clip, digamma, digamma_value, num

MODEL = ("model_id",)


def _over(keys, frame: str = "") -> str:
    return f"over (partition by {', '.join(keys)}{frame})"


def _later(keys) -> str:
    """Mass of all groups after this one."""
    return f"coalesce(sum(mass) {_over(keys, ' order by k rows between 1 following and unbounded following')}, 0D)"


def _earlier(keys, column: str) -> str:
    return f"coalesce(sum({column}) {_over(keys, ' order by k rows between unbounded preceding and 1 preceding')}, 0D)"


def _sticks(df: DataFrame, a: str, b: str, keys) -> DataFrame:
    staged = df.selectExpr(*keys, "k", "mass", f"{_later(keys)} as after", f"count(*) {_over(keys)} as groups")
    return staged.selectExpr(*keys, "k", f"greatest({a}, {num(EPS)}) as a", f"greatest({b}, {num(EPS)}) as b")


def dp_sticks(df: DataFrame, nu: float, keys=MODEL) -> DataFrame:
    """Dirichlet-process sticks."""
    return _sticks(df, "1D + mass", f"{num(nu)} + after", keys)


def py_sticks(df: DataFrame, d: float, theta: float, keys=MODEL) -> DataFrame:
    """Pitman-Yor sticks; needs ``theta > -d``."""
    if theta <= -d:
        raise ValueError(f"concentration {theta} must exceed {-d}")
    return _sticks(df, f"{num(1.0 - d)} + mass", f"{num(theta)} + (k + 1) * {num(d)} + after", keys)


def nig_sticks(df: DataFrame, sigma: float, alpha: float, keys=MODEL) -> DataFrame:
    """Normalized-inverse-Gaussian sticks."""
    prior = f"{num(1.0 - sigma)} + {num(alpha)} / groups"
    return _sticks(df, f"{prior} + mass", f"{prior} + after", keys)


def mfm_weights(df: DataFrame, delta: float, gamma: float, frozen_k: int | None = None, keys=MODEL) -> DataFrame:
    """Dirichlet parameters of a mixture of finite mixtures; ``frozen_k`` keeps the starting K in the prior."""
    groups = str(frozen_k) if frozen_k else f"count(*) {_over(keys)}"
    staged = df.selectExpr(*keys, "k", "mass", f"{groups} as groups")
    phi = f"{num(delta)} + {num(gamma)} / groups + mass"
    return staged.selectExpr(*keys, "k", f"greatest({phi}, {num(EPS)}) as phi")


def stochastic_sticks(old: DataFrame, mass: DataFrame, concentration: float, scale: float, step: float,
                      more_clusters: bool = False, keys=MODEL) -> DataFrame:
    """Blend old stick parameters ``(k, rho, tau)`` with those of a scaled batch."""
    rate = step * 0.5 if more_clusters else step
    staged = old.join(mass, [*keys, "k"]).selectExpr(*keys, "k", "rho", "tau", "mass", f"{_later(keys)} as after")
    rho = f"{num(1 - rate)} * rho + {num(rate)} * (1D + {num(scale)} * mass)"
    tau = f"{num(1 - rate)} * tau + {num(rate)} * ({num(concentration)} + {num(scale)} * after)"
    return staged.selectExpr(*keys, "k", f"greatest({rho}, 0.5D) as rho", f"greatest({tau}, 0.1D) as tau")


def elog_sticks(df: DataFrame, a: str = "a", b: str = "b", clipped: bool = False, keys=MODEL) -> DataFrame:
    """Expected log weights of sticks; ``clipped`` holds each term in [-20, 0]."""
    take, leave = (f"{digamma(v)} - {digamma(f'{a} + {b}')}" for v in (a, b))
    if clipped:
        take, leave = clip(take, -20, 0), clip(leave, -20, 0)
    staged = df.selectExpr(*keys, "k", f"{take} as take", f"{leave} as leave")
    return staged.selectExpr(*keys, "k", f"take + {_earlier(keys, 'leave')} as elog_pi")


def elog_dirichlet(df: DataFrame, keys=MODEL) -> DataFrame:
    staged = df.selectExpr(*keys, "k", "phi", f"sum(phi) {_over(keys)} as total")
    return staged.selectExpr(*keys, "k", f"{digamma('phi')} - {digamma('total')} as elog_pi")


def mean_weights(df: DataFrame, kind: str, keys=MODEL) -> DataFrame:
    """Mean weight per group.

    ``sticks`` (a, b): product form through logs; ``normalised`` (rho, tau): the same,
    scaled to sum to one; ``dirichlet`` (phi): share of the total; ``softmax`` (elog_pi).
    """
    every = _over(keys)
    if kind == "dirichlet":
        return df.selectExpr(*keys, "k", f"phi / sum(phi) {every} as weight")
    if kind == "softmax":
        staged = df.selectExpr(*keys, "k", f"exp(elog_pi - max(elog_pi) {every}) as e")
        return staged.selectExpr(*keys, "k", f"e / sum(e) {every} as weight")
    a, b = ("a", "b") if kind == "sticks" else ("rho", "tau")
    share = f"{a} / ({a} + {b})"
    staged = df.selectExpr(
        *keys, "k", f"ln(greatest({share}, {num(EPS)})) as taken", f"ln(greatest(1D - {share}, {num(EPS)})) as left_over"
    )
    raw = staged.selectExpr(*keys, "k", f"exp(taken + {_earlier(keys, 'left_over')}) as weight")
    if kind == "sticks":
        return raw
    return raw.selectExpr(*keys, "k", f"weight / (sum(weight) {every} + {num(EPS)}) as weight")


# --- the same rules on the K numbers a fit holds between two jobs ---------------------------


def update(kind: str, mass: list[float], p: dict, frozen_k: int | None = None):
    """Posterior parameters (a, b) from group masses; b is None for a Dirichlet prior."""
    groups = frozen_k or len(mass)
    after = [sum(mass[k + 1:]) for k in range(len(mass))]
    if kind == "mfm":
        return [max(p["delta"] + p["gamma"] / groups + m, EPS) for m in mass], None
    if kind == "dp":
        prior = [(1.0, p["nu"])] * len(mass)
    elif kind == "py":
        prior = [(1.0 - p["d"], p["theta"] + (k + 1) * p["d"]) for k in range(len(mass))]
    elif kind == "nig":
        prior = [((1.0 - p["sigma"]) + p["alpha"] / groups,) * 2] * len(mass)
    else:
        raise ValueError(f"unknown weight prior {kind}")
    a = [max(a0 + m, EPS) for (a0, _), m in zip(prior, mass)]
    return a, [max(b0 + m, EPS) for (_, b0), m in zip(prior, after)]


def start(kind: str, k_max: int, p: dict):
    """Stick parameters before any data: (1, nu) or the Pitman-Yor prior."""
    if kind == "dp":
        return [1.0] * k_max, [float(p["nu"])] * k_max
    return [1.0 - p["d"]] * k_max, [p["theta"] + (k + 1) * p["d"] for k in range(k_max)]


def elog(a: list[float], b: list[float] | None, clipped: bool = False) -> list[float]:
    if b is None:
        total = digamma_value(sum(a))
        return [digamma_value(v) - total for v in a]
    out, before = [], 0.0
    for ak, bk in zip(a, b):
        whole = digamma_value(ak + bk)
        take, leave = digamma_value(ak) - whole, digamma_value(bk) - whole
        if clipped:
            take, leave = min(max(take, -20.0), 0.0), min(max(leave, -20.0), 0.0)
        out.append(take + before)
        before += leave
    return out


def means(kind: str, a: list[float], b: list[float] | None, elog_pi: list[float] | None = None) -> list[float]:
    """Mean weights: ``mfm`` shares, ``nig`` softmax of the expected logs, else stick products."""
    if kind == "mfm":
        return [v / sum(a) for v in a]
    if kind == "nig":
        top = max(elog_pi)
        e = [math.exp(v - top) for v in elog_pi]
        return [v / sum(e) for v in e]
    out, left = [], 0.0
    for ak, bk in zip(a, b):
        v = ak / (ak + bk)
        out.append(math.exp(math.log(max(v, EPS)) + left))
        left += math.log(max(1.0 - v, EPS))
    if kind == "stochastic":
        total = sum(out) + EPS
        out = [v / total for v in out]
    return out
