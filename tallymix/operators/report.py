"""Prediction and reports of a finished fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.special import EPS, num
from tallymix.operators import likelihood as lk
from tallymix.operators.cells import sums_by_sample
from tallymix.operators.likelihood import unfold
from tallymix.operators.profiles import per_model
from tallymix.operators.selection import discriminative_signal
from tallymix.plans.mixture import Fit, feature_scores, models_table


def predict_scores(fit: Fit, data=None, f_new: str | None = None) -> DataFrame:
    """Log-likelihood columns ``ll0..`` of the samples of ``data`` (default: the training data).

    A fit with per-sample selection has no selection value for a new sample: the column
    mean of the training values stands in, or a constant where the fit uses one.
    """
    data = data or fit.data
    state, width = fit.state, fit.state.width
    table = models_table(fit.data, state.models)
    if fit.spec.selection == "sample":
        logs = lk.elog_profiles(state.params, table.select("model_id", "psi_lam", "psi_iota"))
        if f_new is not None:
            logs = logs.withColumn("f", F.expr(f_new))
        else:
            means = mean_selection(fit).withColumnRenamed("selection", "f")
            logs = logs.join(means, ["model_id", "feature_id"])
        scores = logs.selectExpr("model_id", "feature_id", f"{lk.blended('shared')} as score").selectExpr(
            "model_id", "feature_id", *unfold("score", "c", width)
        )
    else:
        scores = feature_scores(fit.spec, state, table)
    joined = data.with_features(data.cells, scores, width, len(state.models))
    ll = sums_by_sample(joined, lk.weighted_sums(width))
    return data.add_empty_samples(ll, sorted(state.models), [f"ll{k}" for k in range(width)])


def membership(fit: Fit, data=None) -> DataFrame:
    """Soft memberships and log normaliser per sample."""
    table = models_table(fit.data, fit.models)
    constant = "0.5D" if fit.spec.name in ("mfm_moves", "nig_moves") else None
    ll = predict_scores(fit, data, constant)
    rows = ll.join(F.broadcast(table.select("model_id", "k_live", "elog_pi", "beta")), "model_id")
    floor = None if fit.spec.selection in ("cluster", "sample") else EPS
    return lk.responsibilities(rows, fit.state.width, floor, "log_norm").select("model_id", "sample_id", "r", "log_norm")


def predict(fit: Fit, data=None) -> DataFrame:
    """Label of the highest membership: ``model_id, sample_id, label``."""
    return membership(fit, data).select("model_id", "sample_id", lk.hard_label().alias("label"))


def hard_labels(resp: DataFrame) -> DataFrame:
    return resp.select("model_id", "sample_id", lk.hard_label().alias("label"))


def mean_selection(fit: Fit) -> DataFrame:
    """Mean selection per feature over all samples, zero cells included."""
    if fit.spec.selection != "sample":
        value = "aggregate(f, 0D, (a, v) -> a + v) / size(f)" if fit.spec.selection == "cluster" else "f"
        return fit.state.params.selectExpr("model_id", "feature_id", f"{value} as selection")
    zero = per_model({i: m.zero_f for i, m in fit.models.items()})
    n = num(fit.data.n_samples)
    stats = fit.state.params.select("model_id", "feature_id", "f_total").join(
        fit.data.features.select("feature_id", "nnz"), "feature_id"
    )
    return stats.selectExpr("model_id", "feature_id", f"(f_total + ({n} - nnz) * {zero}) / {n} as selection")


def rank_features(selection: DataFrame, value: str = "selection") -> DataFrame:
    """Mean selection per feature, highest first."""
    means = selection.groupBy("feature_id").agg(F.avg(value).alias("mean_selection"))
    return means.orderBy(F.desc("mean_selection"), "feature_id")


def selected_by_sample(fit: Fit, threshold: float = 0.5) -> DataFrame:
    """Features above the threshold for each sample: ``model_id, sample_id, feature_id, probability``.

    A row without ``sample_id`` stands for all samples that have no row of their own for
    its feature. With shared selection these are all rows; with per-sample selection the
    nonzero cells have rows of their own, and the zero cells of a feature share one
    value, so they share one row.
    """
    sample_type = fit.data.samples.schema["sample_id"].dataType.simpleString()
    anyone = f"cast(null as {sample_type}) as sample_id"
    if fit.spec.selection != "sample":
        return fit.state.params.where(F.col("f") > threshold).selectExpr(
            "model_id", anyone, "feature_id", "f as probability"
        )
    own = fit.state.cells.where(F.col("f") > threshold).selectExpr(
        "model_id", "sample_id", "feature_id", "f as probability"
    )
    zero = per_model({i: float(m.zero_f) for i, m in fit.models.items()})
    sparse = fit.data.features.where(f"nnz < {num(fit.data.n_samples)}").select("feature_id")
    rest = fit.state.params.select("model_id", "feature_id").join(sparse, "feature_id").selectExpr(
        "model_id", anyone, "feature_id", f"{zero} as probability"
    )
    return own.unionByName(rest.where(F.col("probability") > threshold))


def selected_by_majority(fit: Fit, threshold: float = 0.5) -> DataFrame:
    """Features selected (above 0.5) in more than ``threshold`` of all samples."""
    n = num(fit.data.n_samples)
    if fit.spec.selection != "sample":
        return fit.state.params.selectExpr(
            "model_id", "feature_id", "if(f > 0.5D, 1D, 0D) as share"
        ).where(F.col("share") > threshold)
    zero = per_model({i: float(m.zero_f > 0.5) for i, m in fit.models.items()})
    stats = fit.state.params.select("model_id", "feature_id", "n_selected").join(
        fit.data.features.select("feature_id", "nnz"), "feature_id"
    )
    share = f"(n_selected + ({n} - nnz) * {zero}) / {n}"
    return stats.selectExpr("model_id", "feature_id", f"{share} as share").where(F.col("share") > threshold)


def by_cluster(params: DataFrame, column: str, name: str) -> DataFrame:
    """An array column of the feature table as rows ``model_id, k, feature_id, value``."""
    return params.selectExpr("model_id", "feature_id", f"posexplode({column}) as (k, {name})").select(
        "model_id", "k", "feature_id", name
    )


def selected_by_cluster(fit: Fit, threshold: float = 0.5) -> DataFrame:
    """Features above the threshold per group, with their probability."""
    return by_cluster(fit.state.params, "f", "probability").where(F.col("probability") > threshold)


def selected_ssl(fit: Fit, threshold: float = 0.5) -> DataFrame:
    """Included features with inclusion probability and raw discriminative signal."""
    table = models_table(fit.data, fit.models)
    logs = lk.elog_profiles(fit.state.params, table.select("model_id", "psi_lam", "psi_iota"), keep=("f",))
    rows = logs.join(F.broadcast(table.select("model_id", "share")), "model_id")
    return rows.where(F.col("f") > threshold).selectExpr(
        "model_id", "feature_id", "f as inclusion", f"{discriminative_signal()} as signal"
    )


def member_counts(resp: DataFrame, width: int) -> DataFrame:
    """Samples with membership above one half, per group: ``model_id, k, n_samples``."""
    flat = resp.selectExpr("model_id", *unfold("r", "r", width))
    counts = flat.groupBy("model_id").agg(*[F.expr(f"count_if(r{k} > 0.5D) as n{k}") for k in range(width)])
    rows = ", ".join(f"struct({k} as k, n{k} as n_samples)" for k in range(width))
    return counts.selectExpr("model_id", f"inline(array({rows}))")


def profile_rows(params: DataFrame, width: int, only: DataFrame | None = None) -> DataFrame:
    """Normalised profile per group and feature; ``only`` restricts (and renormalises over) features."""
    if only is not None:
        params = params.join(only.select("model_id", "feature_id"), ["model_id", "feature_id"], "left_semi")
    long = by_cluster(params, "lam", "lam")
    totals = long.groupBy("model_id", "k").agg(F.sum("lam").alias("total"))
    joined = long.join(F.broadcast(totals), ["model_id", "k"])  # one row per group
    return joined.selectExpr("model_id", "k", "feature_id", "lam / total as profile")


def signatures(fit: Fit, threshold: float = 0.5) -> DataFrame:
    """Selected features per group with selection, profile and number of members."""
    width, spec = fit.state.width, fit.spec
    members = member_counts(fit.state.resp, width)
    if spec.selection == "cluster":
        chosen = selected_by_cluster(fit, threshold).withColumnRenamed("probability", "selection")
        chosen = chosen.join(F.broadcast(members), ["model_id", "k"])
        profile = profile_rows(fit.state.params, width)
        return chosen.join(profile, ["model_id", "k", "feature_id"]).select(
            "model_id", "k", "feature_id", "selection", "profile", "n_samples"
        )
    live = members.where("n_samples > 0")
    if spec.selection == "sample":
        chosen = _member_selection(fit).join(F.broadcast(live), ["model_id", "k"])
        chosen = chosen.selectExpr("model_id", "k", "feature_id", "selection", "n_samples").where(
            F.col("selection") > threshold
        )
        profile = profile_rows(fit.state.params, width)
    else:
        kept = fit.state.params.where(F.col("f") > threshold)
        chosen = kept.selectExpr("model_id", "feature_id", "f as selection").join(F.broadcast(live), "model_id")
        profile = profile_rows(fit.state.params, width, kept if spec.selection == "ssl_excess" else None)
    return chosen.join(profile, ["model_id", "k", "feature_id"]).select(
        "model_id", "k", "feature_id", "selection", "profile", "n_samples"
    )


def _member_selection(fit: Fit) -> DataFrame:
    """Mean per-sample selection over the members of each group, zero cells included."""
    width, data = fit.state.width, fit.data
    flags = fit.state.resp.selectExpr(
        "model_id", "sample_id", *[f"if(get(r, {k}) > 0.5D, 1D, 0D) as m{k}" for k in range(width)]
    )
    joined = data.with_samples(fit.state.cells, flags, ["model_id"])
    sums = joined.groupBy("model_id", "feature_id").agg(
        *[F.expr(f"sum(m{k} * f) as s{k}") for k in range(width)], *[F.expr(f"sum(m{k}) as c{k}") for k in range(width)]
    )
    rows = ", ".join(f"struct({k} as k, coalesce(s{k}, 0D) as s, coalesce(c{k}, 0D) as c)" for k in range(width))
    full = fit.state.params.select("model_id", "feature_id").join(sums, ["model_id", "feature_id"], "left")
    long = full.selectExpr("model_id", "feature_id", f"inline(array({rows}))")
    members = member_counts(fit.state.resp, width)
    zero = per_model({i: m.zero_f for i, m in fit.models.items()})
    return long.join(F.broadcast(members.withColumnRenamed("n_samples", "n")), ["model_id", "k"]).where("n > 0").selectExpr(
        "model_id", "k", "feature_id", f"(s + (n - c) * {zero}) / n as selection"
    )


def mixing_weights(fit: Fit) -> DataFrame:
    rows = [(i, k, w) for i, m in fit.models.items() for k, w in enumerate(fit.weights(i))]
    return fit.data.spark.createDataFrame(rows, "model_id int, k int, weight double")


def profiles(fit: Fit) -> DataFrame:
    """Mean profile, mass and weight per group and feature."""
    rows = [(i, k, float(m.mass[k]), w) for i, m in fit.models.items() for k, w in enumerate(fit.weights(i))]
    groups = fit.data.spark.createDataFrame(rows, "model_id int, k int, mass double, weight double")
    return profile_rows(fit.state.params, fit.state.width).join(F.broadcast(groups), ["model_id", "k"])


def model_summary(fit: Fit, threshold: float = 0.5) -> DataFrame:
    """One row per model: sizes, selected features, rate, sparsity, objective, convergence."""
    selected = mean_selection(fit).groupBy("model_id").agg(
        F.expr(f"count_if(selection > {num(threshold)}) as n_selected")
    )
    rows = [
        (i, fit.data.n_samples, fit.data.n_features, m.k, float(m.theta_ssl), float(m.beta_theta),
         float(m.history[-1][1]) if m.history else None, m.converged, m.n_iter)
        for i, m in fit.models.items()
    ]
    facts = fit.data.spark.createDataFrame(
        rows, "model_id int, n_samples bigint, n_features bigint, k int, rate double, beta_theta double, "
              "objective double, converged boolean, iterations int"
    )
    return facts.join(selected, "model_id").selectExpr("*", "1D - n_selected / n_features as sparsity")


def top_features(inclusion: DataFrame, n: int, value: str = "inclusion") -> DataFrame:
    return inclusion.orderBy(F.desc(value), "feature_id").limit(n)
