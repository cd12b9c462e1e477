"""Group profiles and background: starting values and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.special import num
from tallymix.operators.cells import CountData, sums_by_feature
from tallymix.operators.likelihood import unfold

PROFILE_FLOOR = 0.1
MEMBER = 0.1  # a sample counts as a member of a group above this membership


def with_models(df: DataFrame, ids: list[int]) -> DataFrame:
    """Repeat every row once per model; the list of models is short."""
    listed = ", ".join(f"cast({int(i)} as int)" for i in ids)
    return df.withColumn("model_id", F.expr(f"explode(array({listed}))"))


def per_model(values: dict[int, float]) -> str:
    """A number looked up by model_id; one entry per model."""
    pairs = ", ".join(f"{int(i)}, {num(v)}" for i, v in values.items())
    return f"element_at(map({pairs}), model_id)"


def unfolded(resp: DataFrame, width: int, prefix: str = "r") -> DataFrame:
    """Memberships as plain columns r0.. for the sums over cells."""
    return resp.selectExpr("model_id", "sample_id", *unfold("r", prefix, width))


def packed_sums(sums: DataFrame, prefix: str, width: int, out: str) -> DataFrame:
    """Sum columns of a feature table back into one array, missing sums as 0."""
    cells = ", ".join(f"coalesce({prefix}{k}, 0D)" for k in range(width))
    return sums.withColumn(out, F.expr(f"array({cells})")).drop(*[f"{prefix}{k}" for k in range(width)])


def cluster_sums(data: CountData, resp: DataFrame, width: int) -> DataFrame:
    """Sums of membership times count per feature and group: the one shuffle of a sweep.

    Result ``model_id, feature_id, rx ARRAY``.
    """
    joined = data.with_samples(data.cells, unfolded(resp, width))
    sums = sums_by_feature(joined, [F.expr(f"sum(r{k} * x) as rx{k}") for k in range(width)])
    return packed_sums(sums, "rx", width, "rx")


def member_sums(data: CountData, resp: DataFrame, width: int, weighting: str) -> DataFrame:
    """Sums per feature over the members of each group.

    ``plain``: members count 1; ``member``: members count their membership;
    ``all``: every sample counts its membership.
    """
    if weighting == "all":
        return cluster_sums(data, resp, width)
    value = "v" if weighting == "member" else "1D"
    marked = resp.withColumn("r", F.expr(f"transform(r, v -> if(v > {num(MEMBER)}, {value}, 0D))"))
    return cluster_sums(data, marked, width)


def membership_totals(data: CountData, resp: DataFrame, width: int) -> DataFrame:
    """Per model, arrays over groups: mass, number of members, count totals of members and by membership."""
    joined = resp.join(data.samples.select("sample_id", "n_i"), "sample_id").selectExpr(
        "model_id", "n_i", *unfold("r", "r", width)
    )
    one = []
    for k in range(width):
        member = f"if(r{k} > {num(MEMBER)}, 1D, 0D)"
        one += [
            F.expr(f"sum(r{k}) as mass{k}"),
            F.expr(f"sum({member}) as members{k}"),
            F.expr(f"sum({member} * n_i) as total{k}"),
            F.expr(f"sum(r{k} * n_i) as weighted{k}"),
        ]
    sums = joined.groupBy("model_id").agg(*one)
    names = ("mass", "members", "total", "weighted")
    return sums.selectExpr(
        "model_id", *[f"array({', '.join(f'{n}{k}' for k in range(width))}) as {n}" for n in names]
    )


def starting_profiles(features: DataFrame, ids: list[int], sums: DataFrame, totals: DataFrame, models: DataFrame,
                      kind: str, n_samples: int, n_features: int, grand_total: float) -> DataFrame:
    """First profiles and background for every (model, feature).

    ``mean``: normalised member mean (+0.5) scaled to zeta*S; ``sum``: zeta plus weighted
    member sums; ``scaled``: weighted mean share times 100 plus 1. ``models`` carries
    ``model_id, k_live, zeta, eta``, ``sums`` the array ``rx`` and ``totals`` the arrays
    of ``membership_totals``.
    """
    one_row_each = models.select("model_id", "k_live", "zeta", "eta").join(F.broadcast(totals), "model_id")
    grid = with_models(features.select("feature_id", "colsum"), ids).join(sums, ["model_id", "feature_id"], "left")
    grid = grid.join(F.broadcast(one_row_each), "model_id")
    s, n, mean_all = num(n_features), num(n_samples), num(grand_total / n_samples)
    floor, rx = num(PROFILE_FLOOR), "coalesce(get(rx, k), 0D)"
    if kind == "mean":
        size = "greatest(get(members, k), 1D)"
        share = f"({rx} / {size} + 0.5D) / (get(total, k) / {size} + 0.5D * {s})"
        lam = f"greatest(if(get(members, k) > 0, {share} * zeta * {s}, zeta), {floor})"
        iota = f"greatest((colsum / {n} + 0.5D) / ({mean_all} + 0.5D * {s}) * eta * {s}, {floor})"
    elif kind == "sum":
        lam = f"greatest(zeta + {rx}, {floor})"
        iota = f"greatest(eta + colsum / {n} + 0.5D, {floor})"
    else:
        mass = "(get(mass, k) + 1e-10D)"
        share = f"({rx} / {mass}) / (get(weighted, k) / {mass} + 1e-10D)"
        share_all = f"colsum / {n} / ({mean_all} + 1e-10D)"
        lam = f"greatest(if(get(mass, k) > 0, {share}, {share_all}) * 100D + 1D, 1D)"
        iota = f"{share_all} * 100D + 1D"
    return grid.selectExpr(
        "model_id", "feature_id", "colsum", f"transform(sequence(0, k_live - 1), k -> {lam}) as lam", f"{iota} as iota"
    )


def lambda_update(gated: str) -> str:
    """max(zeta + gated sum, 0.1) per group; ``gated`` is an array that already carries the selection."""
    return f"transform({gated}, v -> greatest(zeta + v, {num(PROFILE_FLOOR)}))"


def iota_update(rest: str) -> str:
    """max(eta + counts left to the background, 0.1)."""
    return f"greatest(eta + {rest}, {num(PROFILE_FLOOR)})"


def lambda_stochastic(mass: str, gradient: str, old: str, step: float) -> str:
    """Blend towards 1 + gradient, floor 1; a group with almost no batch mass keeps its profile."""
    fresh = f"greatest({num(1.0 - step)} * {old} + {num(step)} * (1D + {gradient}), 1D)"
    return f"case when {mass} < 0.1D then {old} else {fresh} end"


def iota_stochastic(gradient: str, old: str, step: float) -> str:
    return f"greatest({num(1.0 - step)} * {old} + {num(step)} * (1D + {gradient}), 1D)"

