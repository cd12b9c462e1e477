"""Expected log-likelihoods and soft memberships.

A feature-keyed table carries ``lam ARRAY<DOUBLE>`` (one profile value per group) and
``iota`` (background). Per-feature and per-sample rows work on arrays; only the sums
over cells, where the volume is, unfold them into ``width`` plain columns so that they
run as generated code. The number of groups may differ between models: elements beyond
the end of a model's array read as null and drop out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymix.functions.special import EPS, digamma, lgamma, normalised, num


def at(array: str, k: int) -> str:
    """Element k of an array, null beyond its end."""
    return f"get({array}, {k})"


def unfold(array: str, prefix: str, width: int) -> list[str]:
    """Select expressions that turn an array into columns prefix0.."""
    return [f"{at(array, k)} as {prefix}{k}" for k in range(width)]


def fold(prefix: str, width: int, size: str = "k_live", default: str | None = None) -> str:
    """Columns prefix0.. back into an array of the model's own length."""
    cells = [f"coalesce({prefix}{k}, {default})" if default else f"{prefix}{k}" for k in range(width)]
    return f"slice(array({', '.join(cells)}), 1, {size})"


def total(terms: list[str]) -> str:
    """Sum that skips nulls."""
    return "(" + " + ".join(f"coalesce({t}, 0D)" for t in terms) + ")"


def profile_totals(params: DataFrame, width: int) -> DataFrame:
    """Per model: psi of each profile's total and of the background total."""
    sums = params.groupBy("model_id").agg(
        *[F.expr(f"sum({at('lam', k)}) as s{k}") for k in range(width)], F.sum("iota").alias("si")
    )
    psi = ", ".join(digamma(f"s{k}") for k in range(width))
    return sums.selectExpr("model_id", f"array({psi}) as psi_lam", f"{digamma('si')} as psi_iota")


def elog_profiles(params: DataFrame, totals: DataFrame, keep: tuple = ()) -> DataFrame:
    """Expected log profiles: array ``ea`` per group and ``eb`` for the background.

    ``totals(model_id, psi_lam, psi_iota)`` has one row per model.
    """
    joined = params.join(F.broadcast(totals), "model_id")
    return joined.selectExpr(
        "model_id",
        "feature_id",
        *keep,
        f"transform(lam, (v, i) -> {digamma('v')} - get(psi_lam, i)) as ea",
        f"{digamma('iota')} - psi_iota as eb",
    )


def blended(kind: str, f: str = "f") -> str:
    """Feature score per group: selection blends the group profile with the background.

    ``shared``: one f per feature; ``cluster``: an array of f; ``ungated``: profile only.
    """
    if kind == "ungated":
        return "ea"
    if kind == "shared":
        return f"transform(ea, v -> {f} * v + (1D - {f}) * eb)"
    return f"zip_with(ea, {f}, (v, g) -> g * v + (1D - g) * eb)"


def weighted_sums(width: int) -> list[Column]:
    """Sums of count times feature score (columns c0..), one per group."""
    return [F.expr(f"sum(x * c{k}) as ll{k}") for k in range(width)]


def gated_sums(width: int) -> list[Column]:
    """The same where every cell has its own selection value f (columns ea0.., eb)."""
    return [F.expr(f"sum(x * f * ea{k} + x * (1D - f) * eb) as ll{k}") for k in range(width)]


def dm_sums(width: int) -> list[Column]:
    """Dirichlet-multinomial part of single cells (columns xe0.. = x + e, le0.. = lgamma(e)); zero cells add nothing."""
    return [F.expr(f"sum({lgamma(f'xe{k}')} - le{k}) as ll{k}") for k in range(width)]


def responsibilities(rows: DataFrame, width: int, floor: float | None = EPS, log_norm: str | None = None,
                     tempered: bool = True) -> DataFrame:
    """Memberships ``r`` from ``ll0..`` joined to ``k_live, elog_pi, beta``."""
    scale = "beta * " if tempered else ""
    each = range(width)
    listed = ", ".join(f"_v{k}" for k in each)
    # plain columns for generated code; groups beyond a model's own are null and drop out of sums
    staged = rows.selectExpr("*", *[f"if({k} < k_live, {scale}({at('elog_pi', k)} + ll{k}), null) as _v{k}" for k in each])
    staged = staged.selectExpr("*", f"greatest({listed}, cast(null as double)) as _top")
    staged = staged.selectExpr("*", *[f"exp(_v{k} - _top) as _e{k}" for k in each])
    staged = staged.selectExpr("*", f"{total([f'_e{k}' for k in each])} as _s")
    kept = [*rows.columns, *([f"_top + ln(_s) as {log_norm}"] if log_norm else [])]
    if floor is None:
        return staged.selectExpr(*kept, f"slice(array({', '.join(f'_e{k} / _s' for k in each)}), 1, k_live) as r")
    staged = staged.selectExpr(*kept, *[f"if({k} < k_live, greatest(_e{k} / _s, {num(floor)}), null) as _u{k}" for k in each])
    staged = staged.selectExpr("*", f"{total([f'_u{k}' for k in each])} as _n")
    return staged.selectExpr(
        *rows.columns, *([log_norm] if log_norm else []),
        f"slice(array({', '.join(f'_u{k} / _n' for k in each)}), 1, k_live) as r")


def blend(rows: DataFrame, r: str, anchor: str, share: str, out: str = "r") -> DataFrame:
    """(1 - share) r + share * anchor, floored and renormalised."""
    mixed = f"zip_with({r}, {anchor}, (v, w) -> greatest((1D - {share}) * v + {share} * w, {num(EPS)}))"
    return normalised(rows.withColumn("_mix", F.expr(mixed)), "_mix", out)


def ring(size: int) -> np.ndarray:
    """Adjacency of groups on a ring."""
    h = np.zeros((size, size))
    for k in range(size):
        h[k, (k + 1) % size] = h[(k + 1) % size, k] = 1.0
    return h


def density_rows(energy: np.ndarray, beta: float, s: float) -> np.ndarray:
    """Diagonal of the normalised matrix exponential for a block of samples.

    The matrix is symmetric, so a batched eigen-decomposition gives its exponential.
    """
    h = energy - energy.min(axis=1, keepdims=True)
    span = h.max(axis=1, keepdims=True)
    h = np.where(span > 1e-10, h / np.maximum(span, 1e-300), h)
    size = energy.shape[1]
    m = np.repeat((-beta * s * ring(size))[None], len(h), axis=0)
    idx = np.arange(size)
    m[:, idx, idx] += np.clip(-beta * (1.0 - s) * h, -500.0, 0.0)
    values, vectors = np.linalg.eigh(m)
    weight = np.exp(values - values.max(axis=1, keepdims=True))
    diag = np.einsum("nik,nk->ni", vectors**2, weight)
    diag = np.maximum(diag / diag.sum(axis=1, keepdims=True), EPS)
    return diag / diag.sum(axis=1, keepdims=True)


def responsibilities_density(df: DataFrame, beta: float, s: float) -> DataFrame:
    """Memberships from ``(model_id, sample_id, logit ARRAY<DOUBLE>)`` by the density-matrix rule."""
    id_type = df.schema["sample_id"].dataType.simpleString()

    def kernel(batches):
        for pdf in batches:
            out = pdf[["model_id", "sample_id"]].copy()
            r = pd.Series([None] * len(pdf), dtype=object)
            sizes = pdf["logit"].map(len).to_numpy()
            for size in np.unique(sizes):  # models may differ in their number of groups
                rows = np.flatnonzero(sizes == size)
                block = density_rows(-np.stack(pdf["logit"].to_numpy()[rows]), beta, s)
                for pos, row in zip(rows, block):
                    r.iloc[pos] = row
            out["r"] = r.to_numpy()
            yield out

    return df.mapInPandas(kernel, f"model_id int, sample_id {id_type}, r array<double>")


def hard_label(r: str = "r") -> Column:
    """First group of highest membership."""
    return F.expr(f"cast(array_position({r}, array_max({r})) - 1 as int)")
