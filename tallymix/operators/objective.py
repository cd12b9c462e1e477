"""Objectives: parts computed by aggregates, combined from one number per model."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.special import (
    EPS, array_sum, beta_kl, beta_kl_value, clip, digamma, digamma_value, lgamma, lgamma_value, num,
)
from tallymix.operators.likelihood import at, unfold


def plogp(r: str = "r") -> str:
    """Sum over groups of r ln r for one sample (a non-positive number)."""
    return f"aggregate({r}, 0D, (acc, v) -> acc + coalesce(v * ln(greatest(v, {num(EPS)})), 0D))"


def membership_parts(resp: DataFrame, width: int) -> DataFrame:
    """Per model: sum of r ln r and the mass of each group."""
    staged = resp.selectExpr("model_id", *unfold("r", "r", width))
    entropy = " + ".join(f"coalesce(r{k} * ln(greatest(r{k}, {num(EPS)})), 0D)" for k in range(width))
    sums = staged.groupBy("model_id").agg(
        F.expr(f"sum({entropy}) as plogp"), *[F.expr(f"sum(r{k}) as m{k}") for k in range(width)]
    )
    return sums.selectExpr("model_id", "plogp", f"array({', '.join(f'm{k}' for k in range(width))}) as mass")


def elbo_fast(per_sample: DataFrame, width: int) -> DataFrame:
    """sum r (elog_pi + ll) - sum r ln r from rows with ``r, elog_pi`` arrays and ``ll0..``."""
    ll = f"array({', '.join(f'll{k}' for k in range(width))})"
    fit = array_sum(f"zip_with(r, zip_with(elog_pi, {ll}, (e, l) -> e + l), (w, v) -> w * v)")
    staged = per_sample.selectExpr("model_id", f"{fit} as fit", f"{plogp()} as p")
    return staged.groupBy("model_id").agg(F.expr("sum(fit) - sum(p) as elbo"))


def evidence(per_sample: DataFrame, log_norm: str, last: float = -1e10) -> DataFrame:
    """Sum of finite log normalisers; the last known value where none is finite."""
    finite = f"not isnan({log_norm}) and abs({log_norm}) < double('infinity')"
    return per_sample.groupBy("model_id").agg(
        F.expr(f"coalesce(sum(case when {finite} then {log_norm} end), {num(last)}) as evidence")
    )


def icl(elbo: float, plogp_sum: float) -> float:
    """Objective plus sum of r ln r: prefers sharp memberships."""
    return elbo + plogp_sum


def gram(params: DataFrame, width: int) -> DataFrame:
    """All products of profile pairs in one aggregate: ``model_id, i, j, dot`` with i <= j."""
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    staged = params.selectExpr("model_id", *unfold("lam", "l", width))
    sums = staged.groupBy("model_id").agg(*[F.expr(f"sum(l{i} * l{j}) as g{i}_{j}") for i, j in pairs])
    rows = ", ".join(f"struct({i} as i, {j} as j, g{i}_{j} as dot)" for i, j in pairs)
    return sums.selectExpr("model_id", f"inline(array({rows}))").where("dot is not null")


def profile_similarity(params: DataFrame, width: int) -> DataFrame:
    """Cosine of every pair of profiles: ``model_id, i, j, cosine`` with i < j."""
    g = gram(params, width)
    left = g.where("i = j").selectExpr("model_id", "i", "sqrt(dot) as ni")
    right = g.where("i = j").selectExpr("model_id", "j", "sqrt(dot) as nj")
    pairs = g.where("i < j").join(left, ["model_id", "i"]).join(right, ["model_id", "j"])
    return pairs.selectExpr(
        "model_id", "i", "j", f"if(ni * nj < {num(EPS)}, 0D, dot / greatest(ni * nj, {num(EPS)})) as cosine"
    )


def profile_sym_kl(params: DataFrame, width: int) -> DataFrame:
    """Half the symmetric KL divergence of every pair of normalised profiles."""
    staged = params.selectExpr("model_id", *unfold("lam", "l", width))
    sums = staged.groupBy("model_id").agg(*[F.expr(f"sum(l{k}) as s{k}") for k in range(width)])
    shares = staged.join(F.broadcast(sums), "model_id").selectExpr(  # one row per model
        "model_id",
        *[f"case when l{k} is not null then greatest(l{k} / (s{k} + {num(EPS)}), {num(EPS)}) end as p{k}"
          for k in range(width)],
    )
    pairs = [(i, j) for i in range(width) for j in range(i + 1, width)]
    gap = [F.expr(f"sum(0.5D * (p{i} - p{j}) * (ln(p{i}) - ln(p{j}))) as k{i}_{j}") for i, j in pairs]
    rows = ", ".join(f"struct({i} as i, {j} as j, k{i}_{j} as sym_kl)" for i, j in pairs)
    return shares.groupBy("model_id").agg(*gap).selectExpr("model_id", f"inline(array({rows}))").where("sym_kl is not null")


def repulsion(params: DataFrame, width: int, weight: float) -> DataFrame:
    """Penalty on aligned profiles: -weight times the sum of squared cosines over pairs."""
    return profile_similarity(params, width).groupBy("model_id").agg(
        F.expr(f"-{num(weight)} * sum(cosine * cosine) as repulsion")
    )


def selection_kl(f: str, xi_1: str = "xi_1", xi_2: str = "xi_2", n: str = "1D") -> str:
    """KL of one selection posterior from its prior, after seeing f on n samples."""
    return beta_kl(f"({xi_1} + {n} * {f})", f"({xi_2} + {n} * (1D - {f}))", xi_1, xi_2)


def cell_kl(f: str = "f") -> str:
    """The same for a single cell, where a + b is fixed: columns ``xa, xb, kl_const``."""
    return f"(kl_const + {lgamma('xa')} + {lgamma('xb')} + {f} * {digamma('xa')} + (1D - {f}) * {digamma('xb')})"


def cell_kl_const(xi_1: float, xi_2: float) -> float:
    s0 = xi_1 + xi_2
    return lgamma_value(s0) - lgamma_value(xi_1) - lgamma_value(xi_2) - lgamma_value(s0 + 1.0) - digamma_value(s0 + 1.0)


def selection_kl_value(f: float, xi_1: float, xi_2: float) -> float:
    return beta_kl_value(xi_1 + f, xi_2 + 1.0 - f, xi_1, xi_2)


def entropy(xi: str) -> str:
    """Entropy of one inclusion probability."""
    p = clip(xi, EPS, 1.0 - EPS)
    return f"(-({p}) * ln({p}) - (1D - {p}) * ln(1D - {p}))"


def profile_kl_parts(rows: DataFrame, width: int) -> DataFrame:
    """Per model, the sums from which the KL terms of profiles and background follow.

    ``rows`` are feature rows with ``lam, iota, psi_lam, psi_iota, zeta, eta``.
    """
    staged = rows.selectExpr(
        "model_id", *unfold("lam", "l", width), "iota",
        f"transform(lam, v -> {lgamma('v')}) as lg",
        f"transform(lam, (v, i) -> (v - zeta) * ({digamma('v')} - get(psi_lam, i))) as ld",
        f"{lgamma('iota')} as ig", f"(iota - eta) * ({digamma('iota')} - psi_iota) as dev",
    )
    aggs = []
    for k in range(width):
        aggs += [F.expr(f"sum(l{k}) as ls{k}"), F.expr(f"sum({at('lg', k)}) as lg{k}"), F.expr(f"sum({at('ld', k)}) as ld{k}")]
    aggs += [F.expr("sum(iota) as isum"), F.expr("sum(ig) as ig"), F.expr("sum(dev) as idev")]
    return staged.groupBy("model_id").agg(*aggs)


def dirichlet_kl_value(total_: float, sum_lg: float, sum_dev: float, dim: int, prior: float) -> float:
    return lgamma_value(prior * dim) - dim * lgamma_value(prior) - (lgamma_value(total_) - sum_lg) + sum_dev


def weights_kl(kind: str, a: list[float], b: list[float] | None, p: dict, groups: int | None = None) -> float:
    """KL of the weight posterior from its prior."""
    if kind == "mfm":
        k = len(a)
        de, whole = p["delta"] + p["gamma"] / (groups or k), sum(a)
        lin = sum((v - de) * (digamma_value(v) - digamma_value(whole)) for v in a)
        return lgamma_value(de * k) - k * lgamma_value(de) - (lgamma_value(whole) - sum(map(lgamma_value, a))) + lin
    if kind == "nig":
        prior = [(1.0 - p["sigma"], 1.0 - p["sigma"])] * len(a)
    else:
        prior = [(1.0 - p["d"], p["theta"] + (k + 1) * p["d"]) for k in range(len(a))]
    return sum(beta_kl_value(ak, bk, a0, b0) for ak, bk, (a0, b0) in zip(a, b, prior))


def rate_term(theta: float, beta_theta: float) -> float:
    return (beta_theta - 1.0) * math.log(1.0 - min(max(theta, EPS), 1.0 - EPS))
