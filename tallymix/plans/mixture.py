"""The conjugate mixture fits as repeated Spark jobs.

One sweep is the same for every fit:

1. cells x expected log profiles -> sums by sample -> memberships (written),
2. cells x memberships -> sums by feature -> selection, profiles, background (written),
3. K masses and profile totals per model come back to the driver, which updates the
   mixture weights and decides on pruning.

Expected logs are those of the sweep's start throughout the sweep. All tables carry
``model_id``; independent models (restarts, search trials) share the same jobs.

Where a whole sample lies in one row (``operators.packed``), 1. and the sums of 2. are one pass;
the memberships of such a sweep are written only where something reads them.
"""

from __future__ import annotations

import copy
import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.special import EPS, array_sum, clip, digamma_value, normalised, num, sigmoid_clip_value
from tallymix.operators import likelihood as lk
from tallymix.operators import objective as ob
from tallymix.operators import profiles as pf
from tallymix.operators import selection as sl
from tallymix.operators import weights as wt
from tallymix.operators.cells import CountData, sums_by_feature, sums_by_sample
from tallymix.operators.likelihood import unfold
from tallymix.operators.packed import PackedCells, one_pass, packed_cells
from tallymix.operators.profiles import per_model
from tallymix.plans.specs import Spec, relative_changes, two_phase_anneal


@dataclass
class Model:
    """The few numbers of one model that live on the driver."""

    model_id: int
    p: dict
    k: int
    a: list[float] = field(default_factory=list)
    b: list[float] | None = None
    elog_pi: list[float] = field(default_factory=list)
    mass: list[float] = field(default_factory=list)
    plogp: float = 0.0
    lam_sum: list[float] = field(default_factory=list)
    iota_sum: float = 0.0
    fit: float = 0.0  # sum of membership times expected log-likelihood
    selection_kl: float = 0.0
    zero_f: float = 0.0  # selection shared by all zero cells (per-sample selection)
    started: bool = False  # selection has been updated at least once
    theta_ssl: float = 0.0
    beta_theta: float = 0.0
    sum_xi: float = 0.0
    xi_entropy: float = 0.0
    baseline: float | None = None
    xi_count: int = 0
    theta_window: list[float] = field(default_factory=list)
    pruned: bool = False
    converged: bool = False
    n_iter: int = 0
    history: list[tuple[int, float, int]] = field(default_factory=list)
    elbo: float | None = None
    final_weights: list[float] | None = None

    def recent(self) -> list[float]:
        return [h[1] for h in self.history]


@dataclass
class State:
    """Tables of the current round, keyed by model_id."""

    models: dict[int, Model]
    params: DataFrame  # model_id, feature_id, colsum, lam, iota, f (, f_sum)
    resp: DataFrame | None  # model_id, sample_id, r; None after a sweep in one pass
    cells: DataFrame | None = None  # per-sample selection: model_id, cell, x, f

    @property
    def width(self) -> int:
        return max(m.k for m in self.models.values())

    def only(self, ids) -> State:
        ids = [int(i) for i in ids]
        cells = None if self.cells is None else self.cells.where(F.col("model_id").isin(ids))
        return State(
            {i: self.models[i] for i in ids},
            self.params.where(F.col("model_id").isin(ids)),
            None if self.resp is None else self.resp.where(F.col("model_id").isin(ids)),
            cells,
        )


def join_states(parts: list[State]) -> State:
    """One state from states of different models."""
    out = parts[0]
    for s in parts[1:]:
        cells = None if out.cells is None else out.cells.unionByName(s.cells)
        out = State({**out.models, **s.models}, out.params.unionByName(s.params, allowMissingColumns=True),
                    out.resp.unionByName(s.resp), cells)
    return out


_ARRAYS = ("elog_pi", "psi_lam", "share")
_NUMBERS = ("psi_iota", "beta", "zeta", "eta", "xi_1", "xi_2", "started", "log_ratio", "slope", "rate_odds", "baseline",
            "ema", "kl_const")


def models_table(data: CountData, models: dict[int, Model], beta: float = 1.0) -> DataFrame:
    """One row per model with everything a job needs to know about it."""
    rows = []
    for m in models.values():
        p = m.p
        theta = min(max(m.theta_ssl, EPS), 1.0 - EPS)
        l0, l1 = p.get("l0", 1.0), p.get("l1", 1.0)
        rows.append({
            "model_id": m.model_id, "k_live": m.k,
            "elog_pi": m.elog_pi, "psi_lam": [digamma_value(s) for s in m.lam_sum],
            "share": [v / data.n_samples for v in m.mass],
            "psi_iota": digamma_value(m.iota_sum) if m.iota_sum > 0 else 0.0,
            "beta": beta, "zeta": float(p["zeta"]), "eta": float(p["eta"]),
            "xi_1": float(p["xi_1"]), "xi_2": float(p["xi_2"]), "started": float(m.started),
            "log_ratio": math.log(l1 / max(l0, EPS)), "slope": l0 - l1, "rate_odds": math.log(theta / (1.0 - theta)),
            "baseline": m.baseline if m.baseline is not None else 0.0,
            "kl_const": ob.cell_kl_const(p["xi_1"], p["xi_2"]),
            "ema": 1.0 if m.baseline is not None else min(max(p.get("xi_ema", 1.0), EPS), 1.0),
        })
    schema = "model_id int, k_live int, " + ", ".join(f"{c} array<double>" for c in _ARRAYS) + ", " + ", ".join(
        f"{c} double" for c in _NUMBERS
    )
    columns = ["model_id", "k_live", *_ARRAYS, *_NUMBERS]
    return data.spark.createDataFrame(pd.DataFrame(rows, columns=columns), schema)


def _doubles(row, prefix: str, k: int) -> list[float]:
    return [float(row[f"{prefix}{i}"]) for i in range(k)]


def read_masses(state: State, resp: DataFrame) -> dict[int, tuple[list[float], float]]:
    """Group masses and sum of r ln r per model."""
    width = state.width
    rows = ob.membership_parts(resp, width).collect()  # one row per model
    return {r["model_id"]: ([float(v) for v in r["mass"][: state.models[r["model_id"]].k]], r["plogp"]) for r in rows}


def read_profile_totals(spec: Spec, state: State) -> None:
    """Totals over features that the next sweep needs, one row per model."""
    width = state.width
    scalars = {"iota": "iota"}
    if "fit" in state.params.columns:
        scalars.update(fit="fit", kl="kl")
    if spec.selection.startswith("ssl"):
        scalars.update(xi="f", entropy=ob.entropy("f"))
    staged = state.params.selectExpr(
        "model_id", *unfold("lam", "l", width), *[f"{e} as {n}" for n, e in scalars.items()]
    )
    names = [f"l{k}" for k in range(width)] + list(scalars)
    for r in staged.groupBy("model_id").agg(*[F.expr(f"sum({n}) as {n}") for n in names]).collect():
        m = state.models[r["model_id"]]
        m.lam_sum, m.iota_sum = _doubles(r, "l", m.k), r["iota"]
        if "fit" in scalars:
            m.fit, m.selection_kl = r["fit"] or 0.0, r["kl"] or 0.0
        if "xi" in scalars:
            m.sum_xi, m.xi_entropy = r["xi"], r["entropy"]


# --- start ------------------------------------------------------------------------------


def start_state(data: CountData, spec: Spec, resp: DataFrame, params: dict[int, dict]) -> State:
    """Profiles, background, selection and weights from starting memberships."""
    ws = data.ws
    models = {i: Model(i, p, p["k_max"]) for i, p in params.items()}
    resp = ws.put(resp.select("model_id", "sample_id", "r"), "resp")
    width = max(m.k for m in models.values())
    totals = ws.put(pf.membership_totals(data, resp, width), "membership-totals")
    for r in totals.collect():
        m = models[r["model_id"]]
        m.mass = [float(v or 0.0) for v in r["mass"][: m.k]]
    for m in models.values():
        if spec.weights in ("dp", "py"):
            m.a, m.b = wt.start(spec.weights, m.k, m.p)
        else:
            m.a, m.b = wt.update(spec.weights, m.mass, m.p, m.p["k_max"] if spec.frozen_groups else None)
        m.elog_pi = wt.elog(m.a, m.b)
        m.zero_f = m.p["f0"]
        if spec.selection.startswith("ssl"):
            m.beta_theta = sl.rate_prior(data.n_features, m.p["kappa"])
            m.theta_ssl = 1.0 / (1.0 + m.beta_theta)
    table = models_table(data, models)
    sums = pf.member_sums(data, resp, width, "member" if spec.start == "sum" else "plain")
    first = pf.starting_profiles(
        data.features, sorted(models), sums, totals, table, spec.start, data.n_samples, data.n_features, data.total
    )
    state = State(models, first, resp)
    if spec.selection == "sample":
        state.params = ws.put(first, "params")
        cells = pf.with_models(data.cells, sorted(models))
        f0 = per_model({i: m.p["f0"] for i, m in models.items()})
        state.cells = cells.selectExpr("model_id", *data.cell_columns, f"{f0} as f")
    else:
        values = {}
        for m in models.values():
            if spec.selection == "ssl":
                f = min(max(m.p["init_xi"], 1e-6), 1 - 1e-6)
            elif spec.selection == "ssl_excess":
                f = min(max(m.theta_ssl, 1e-3), 1.0 - EPS)
            else:
                f = float(m.p["f0"])
            values[m.model_id] = f
        f = per_model(values)
        if spec.selection == "cluster":
            f = f"transform(lam, v -> {f})"
        state.params = ws.put(first.withColumn("f", F.expr(f)), "params")
    read_profile_totals(spec, state)
    return state


# --- one sweep --------------------------------------------------------------------------


def feature_scores(spec: Spec, state: State, table: DataFrame, gated: bool = True) -> DataFrame:
    """Feature table the membership step joins to the cells, scores as plain columns."""
    width = state.width
    totals = table.select("model_id", "psi_lam", "psi_iota")
    if spec.selection == "sample":
        logs = lk.elog_profiles(state.params, totals)
        return logs.selectExpr("model_id", "feature_id", *unfold("ea", "ea", width), "eb")
    logs = lk.elog_profiles(state.params, totals, keep=("f",))
    kind = "ungated" if not gated else "cluster" if spec.selection == "cluster" else "shared"
    scored = logs.selectExpr("model_id", "feature_id", f"{lk.blended(kind)} as score")
    return scored.selectExpr("model_id", "feature_id", *unfold("score", "c", width))


def log_likelihoods(data: CountData, spec: Spec, state: State, table: DataFrame, gated: bool = True) -> DataFrame:
    """``model_id, sample_id, ll0..`` for every sample."""
    width, n_models = state.width, len(state.models)
    scores = feature_scores(spec, state, table, gated)
    if spec.selection == "sample":
        joined = data.with_features(state.cells, scores, width + 1, n_models, ["model_id"])
        ll = sums_by_sample(joined, lk.gated_sums(width))
    else:
        joined = data.with_features(data.cells, scores, width, n_models)
        ll = sums_by_sample(joined, lk.weighted_sums(width))
    return data.add_empty_samples(ll, sorted(state.models), [f"ll{k}" for k in range(width)])


def memberships(data: CountData, spec: Spec, state: State, beta: float = 1.0, density: float = 0.0,
                gated: bool = True) -> DataFrame:
    """New memberships, not yet written."""
    table = models_table(data, state.models, beta)
    ll = log_likelihoods(data, spec, state, table, gated)
    rows = ll.join(F.broadcast(table.select("model_id", "k_live", "elog_pi", "beta")), "model_id")
    if density > 1e-8:
        logit = f"zip_with(elog_pi, {lk.fold('ll', state.width)}, (e, l) -> e + l)"
        energies = rows.selectExpr("model_id", "sample_id", f"{logit} as logit")
        return lk.responsibilities_density(energies, beta, density)
    return lk.responsibilities(rows, state.width).select("model_id", "sample_id", "r")


def sweep(data: CountData, spec: Spec, state: State, beta: float = 1.0, density: float = 0.0,
          anchor: DataFrame | None = None, gated: bool = True, averaging: bool = False,
          want_objective: bool = True, packed: PackedCells | None = None) -> State:
    """One round of all updates; returns the new state, without memberships where ``packed`` is given."""
    ws = data.ws
    models = copy.deepcopy(state.models)
    resp = sums = None
    if packed is not None:
        scores = feature_scores(spec, state, models_table(data, state.models, beta), gated)
        passed = one_pass(packed, scores, {i: m.elog_pi for i, m in state.models.items()}, beta)
        sums = packed.table({i: v[0] for i, v in passed.items()})
        masses = {i: v[1:] for i, v in passed.items()}
    else:
        resp = ws.put(memberships(data, spec, state, beta, density, gated), "resp")
        masses = read_masses(state, resp)
    for i, m in models.items():
        m.mass, m.plogp = masses[i]
    step_resp, step_mass = resp, {i: v[0] for i, v in masses.items()}
    if density > 1e-8 and anchor is not None:
        mixed = resp.join(anchor.withColumnRenamed("r", "r0"), ["model_id", "sample_id"])
        blended = lk.blend(mixed, "r", "r0", num(density), "b")
        step_resp = ws.put(blended.selectExpr("model_id", "sample_id", "b as r"), "resp-blend")
        step_mass = {i: v[0] for i, v in read_masses(state, step_resp).items()}

    # the jobs below see the groups' shares of this round and everything else as it was
    shared = {i: copy.copy(m) for i, m in state.models.items()}
    for i, m in shared.items():
        m.mass = models[i].mass
    table = models_table(data, shared, beta)
    if spec.selection == "sample":
        params, cells = _update_per_sample(data, spec, state, table, step_resp, want_objective)
    else:
        if sums is None:
            sums = pf.cluster_sums(data, step_resp, state.width)
        params, cells = _update_features(data, spec, state, table, sums, gated, averaging), None
    new = State(models, params, resp, cells)

    for i, m in models.items():
        m.a, m.b = wt.update(spec.weights, step_mass[i], m.p, m.p["k_max"] if spec.frozen_groups else None)
        if spec.selection == "sample":
            xi1, xi2 = (m.p["xi_1"] + m.zero_f, m.p["xi_2"] + 1.0 - m.zero_f) if m.started else (m.p["xi_1"], m.p["xi_2"])
            m.zero_f = sigmoid_clip_value(digamma_value(xi1) - digamma_value(xi2))
        m.started = True
    read_profile_totals(spec, new)
    for i, m in models.items():
        if spec.selection.startswith("ssl"):
            m.theta_ssl = sl.ssl_rate(m.sum_xi, data.n_features, m.beta_theta)
        if averaging:
            m.xi_count += 1
            m.theta_window.append(m.theta_ssl)
        # objective with this round's memberships and selection and the logs of its start
        m.elbo = _objective(data, spec, m, state.models[i].elog_pi) if want_objective else None
        m.elog_pi = wt.elog(m.a, m.b)
    if step_resp is not resp:
        if want_objective:
            fits = _frozen_fit(data, spec, state, new, table)
            for i, m in models.items():
                m.fit = fits[i]
                m.elbo = _objective(data, spec, m, state.models[i].elog_pi)
        ws.release(step_resp)
    return new


def _update_features(data: CountData, spec: Spec, state: State, table: DataFrame, sums: DataFrame, gated: bool,
                     averaging: bool) -> DataFrame:
    """Selection per feature (or per group and feature), profiles and background."""
    n = num(data.n_samples)
    keep = tuple(c for c in ("colsum", "f", "f_sum") if c in state.params.columns)
    logs = lk.elog_profiles(state.params, table.select("model_id", "psi_lam", "psi_iota"), keep=keep)
    rows = logs.join(sums, ["model_id", "feature_id"], "left").join(F.broadcast(table), "model_id")
    rows = rows.withColumn("rx", F.expr("transform(ea, (v, i) -> coalesce(get(rx, i), 0D))"))

    if spec.selection == "cluster":
        odds = f"transform(f, v -> {sl.prior_odds('v', 'xi_1', 'xi_2', n)})"
        rows = rows.withColumn("odds", F.expr(odds)).withColumn("new", F.expr(sl.select_per_cluster()))
        used = "new" if spec.select_first else "f"
        rows = rows.withColumn("gated", F.expr(f"zip_with({used}, rx, (g, v) -> g * v)"))
        rest = array_sum("zip_with(gated, rx, (g, v) -> v - g)")
        score = lk.blended("cluster", "new")
    else:
        if spec.selection == "shared":
            rows = rows.withColumn("new", F.expr(sl.select_shared(sl.prior_odds("f", "xi_1", "xi_2", n))))
        elif spec.selection == "ssl":
            rows = rows.withColumn("signal", F.expr(sl.signal_shared()))
            rows = rows.withColumn("new", F.expr(sl.select_ssl()))
        else:
            rows = rows.withColumn("g", F.expr(sl.discriminative_signal()))
            rows = rows.withColumn("excess", F.expr(f"greatest(g - {_baselines(state, table)}, 0D)"))
            mixed = f"ema * {sl.select_ssl_excess()} + (1D - ema) * f"
            rows = rows.withColumn("new", F.expr(clip(mixed, EPS, 1.0 - EPS)))
        used = "new" if spec.select_first else "f"
        free = spec.selection == "ssl_excess"  # profiles of this fit never feel the selection
        rows = rows.withColumn("gated", F.expr("rx" if free else f"transform(rx, v -> {used} * v)"))
        rest = "colsum" if free and not gated else f"(1D - {used}) * colsum"
        score = lk.blended("shared", "new")

    fit = array_sum(f"zip_with(rx, {score}, (v, c) -> v * c)")
    kl = "0D"
    if spec.objective == "weights":
        kl = ob.selection_kl("new", n=n)
    out = ["model_id", "feature_id", "colsum", f"{pf.lambda_update('gated')} as lam", f"{pf.iota_update(rest)} as iota",
           "new as f", f"{fit} as fit", f"{kl} as kl"]
    if spec.selection == "ssl_excess":
        out.append("g")
        if averaging:
            out.append(f"{'f_sum' if 'f_sum' in keep else '0D'} + new as f_sum")
    return data.ws.put(rows.selectExpr(*out), "params")


def _signal(state: State, table: DataFrame) -> DataFrame:
    """Discriminative signal of every feature under the given group shares."""
    logs = lk.elog_profiles(state.params, table.select("model_id", "psi_lam", "psi_iota"))
    return logs.join(F.broadcast(table.select("model_id", "share")), "model_id").selectExpr(
        "model_id", "feature_id", f"{sl.discriminative_signal()} as g"
    )


def null_levels(state: State, table: DataFrame) -> dict[int, float]:
    """Exact quantile of the signal per model, at the level its inclusion rate asks for."""
    signal = _signal(state, table)
    return sl.exact_quantiles(signal, "model_id", "g", {i: sl.null_quantile(m.theta_ssl) for i, m in state.models.items()})


def _baselines(state: State, table: DataFrame) -> str:
    """Null level of the signal per model: frozen, or the current quantile."""
    level = {i: m.baseline for i, m in state.models.items() if m.baseline is not None}
    moving = {i: m for i, m in state.models.items() if m.baseline is None}
    if moving:
        level.update(null_levels(State(moving, state.params, state.resp), table))
    return per_model(level)


def freeze_baselines(data: CountData, state: State) -> None:
    """Fix the null level from the current profiles and the last memberships."""
    if all(m.baseline is not None for m in state.models.values()):
        return
    for i, level in null_levels(state, models_table(data, state.models)).items():
        if state.models[i].baseline is None:
            state.models[i].baseline = level


def _update_per_sample(data: CountData, spec: Spec, state: State, table: DataFrame, resp: DataFrame,
                       want_objective: bool) -> tuple[DataFrame, DataFrame]:
    """Selection per nonzero cell, then profiles and background."""
    ws, width, n_models = data.ws, state.width, len(state.models)
    logs = lk.elog_profiles(state.params, table.select("model_id", "psi_lam", "psi_iota"), keep=("colsum",))
    priors = table.select("model_id", "xi_1", "xi_2", "started", "zeta", "eta", "k_live", "kl_const")
    slim = logs.selectExpr("model_id", "feature_id", *unfold("ea", "ea", width), "eb").join(
        F.broadcast(priors.select("model_id", "xi_1", "xi_2", "started")), "model_id"
    )
    flat = pf.unfolded(resp, width)
    joined = data.with_features(data.with_samples(state.cells, flat, ["model_id"]), slim, width + 4, n_models, ["model_id"])
    fresh = sl.select_per_sample(width)
    key = data.sample_key + ["model_id"]
    cells = ws.put(
        sl.cell_prior(joined).selectExpr(
            "model_id", *data.cell_columns, f"{fresh} as f", "f as f_old").repartition(data.buckets, *key),
        "cells-f", bucket_by=key, buckets=data.buckets,
    )

    used = "f" if spec.select_first else "f_old"
    moved = data.with_samples(cells, flat, ["model_id"])
    aggs = [f"sum(r{k} * {used} * x) as rx{k}" for k in range(width)]
    aggs += [f"sum((1D - {used}) * x) as rest", "sum(f) as f_total", "count_if(f > 0.5D) as n_selected"]
    if want_objective:
        aggs += [f"sum(r{k} * f * x) as gx{k}" for k in range(width)] + ["sum((1D - f) * x) as gr"]
        moved = sl.cell_prior(moved.join(F.broadcast(priors.select("model_id", "xi_1", "xi_2", "kl_const")).withColumn(
            "started", F.lit(1.0)), "model_id"))
        aggs.append(f"sum({ob.cell_kl()}) as kl")
    sums = sums_by_feature(moved, [F.expr(a) for a in aggs])
    sums = pf.packed_sums(sums, "rx", width, "rx")
    fit = kl = "0D"
    if want_objective:
        sums = pf.packed_sums(sums, "gx", width, "gx")
        fit = f"coalesce({array_sum('zip_with(gx, ea, (v, e) -> v * e)')} + gr * eb, 0D)"
        kl = "coalesce(kl, 0D)"
    rows = logs.join(sums, ["model_id", "feature_id"], "left").join(F.broadcast(priors), "model_id")
    rows = rows.withColumn("rx", F.expr("transform(ea, (v, i) -> coalesce(get(rx, i), 0D))"))
    params = ws.put(
        rows.selectExpr(
            "model_id", "feature_id", "colsum", f"{pf.lambda_update('rx')} as lam",
            f"{pf.iota_update('coalesce(rest, 0D)')} as iota", "coalesce(f_total, 0D) as f_total",
            "coalesce(n_selected, 0L) as n_selected", f"{fit} as fit", f"{kl} as kl",
        ), "params")
    return params, cells


# --- objectives -------------------------------------------------------------------------


def zero_cells(data: CountData) -> int:
    return data.n_samples * data.n_features - data.nnz


def _selection_kl(data: CountData, spec: Spec, m: Model) -> float:
    if spec.selection != "sample":
        return m.selection_kl
    if not m.started:
        return 0.0
    return m.selection_kl + zero_cells(data) * ob.selection_kl_value(m.zero_f, m.p["xi_1"], m.p["xi_2"])


def _objective(data: CountData, spec: Spec, m: Model, elog_pi: list[float]) -> float:
    value = m.fit + sum(r * e for r, e in zip(m.mass, elog_pi)) - m.plogp
    if spec.objective == "weights":
        groups = m.p["k_max"] if spec.frozen_groups else None
        value -= ob.weights_kl(spec.weights, m.a, m.b, m.p, groups) + _selection_kl(data, spec, m)
    elif spec.objective == "ssl":
        theta = min(max(m.theta_ssl, EPS), 1.0 - EPS)
        value += m.sum_xi * math.log(theta) + (data.n_features - m.sum_xi) * math.log(1.0 - theta)
        value += m.xi_entropy + ob.rate_term(theta, m.beta_theta)
    return value


def fit_terms(data: CountData, spec: Spec, state: State, table: DataFrame, params: DataFrame | None = None) -> dict[int, float]:
    """Sum of membership times expected log-likelihood, from the tables as they are."""
    width, n_models = state.width, len(state.models)
    view = State(state.models, params if params is not None else state.params, state.resp, state.cells)
    scores = feature_scores(spec, view, table)
    flat = pf.unfolded(state.resp, width)
    if spec.selection == "sample":
        joined = data.with_features(data.with_samples(state.cells, flat, ["model_id"]), scores, width + 1, n_models, ["model_id"])
        own = lk.total([f"r{k} * ea{k}" for k in range(width)])
        value = f"sum(x * (f * {own} + (1D - f) * eb)) as fit"
        rows = joined.groupBy("model_id").agg(F.expr(value)).collect()
    else:
        sums = pf.cluster_sums(data, state.resp, width).join(scores, ["model_id", "feature_id"])
        value = lk.total([f"get(rx, {k}) * c{k}" for k in range(width)])
        rows = sums.groupBy("model_id").agg(F.expr(f"sum({value}) as fit")).collect()
    return {r["model_id"]: r["fit"] for r in rows}


def _frozen_fit(data: CountData, spec: Spec, old: State, new: State, table: DataFrame) -> dict[int, float]:
    """Fit of new memberships and selection under the profiles of the round's start."""
    mixed = old.params.select("model_id", "feature_id", "lam", "iota").join(
        new.params.select("model_id", "feature_id", "f"), ["model_id", "feature_id"]
    )
    return fit_terms(data, spec, new, table, mixed)


def fresh_objective(data: CountData, spec: Spec, state: State) -> dict[int, float]:
    """The fit's own objective with all expected logs taken from the current tables."""
    table = models_table(data, state.models)
    fits = fit_terms(data, spec, state, table)
    masses = read_masses(state, state.resp)
    out = {}
    for i, m in state.models.items():
        view = copy.copy(m)
        view.fit, (view.mass, view.plogp) = fits[i], masses[i]
        out[i] = _objective(data, spec, view, m.elog_pi)
    return out


def full_objective(data: CountData, spec: Spec, state: State) -> dict[int, float]:
    """Objective with the KL terms of weights, selection, profiles and background."""
    width = state.width
    table = models_table(data, state.models)
    fits = fit_terms(data, spec, state, table)
    masses = read_masses(state, state.resp)
    rows = state.params.join(F.broadcast(table), "model_id")
    sums = {r["model_id"]: r for r in ob.profile_kl_parts(rows, width).collect()}
    if spec.selection == "sample":
        priors = table.select("model_id", "xi_1", "xi_2", "kl_const").withColumn("started", F.lit(1.0))
        cells = sl.cell_prior(state.cells.select("model_id", "f").join(F.broadcast(priors), "model_id"))
        kls = {r[0]: r[1] for r in cells.groupBy("model_id").agg(F.expr(f"sum({ob.cell_kl()}) as kl")).collect()}
    else:
        kls = {i: m.selection_kl for i, m in state.models.items()}
    penalty = {}
    if any(m.p.get("repulsion", 0.0) > 0 for m in state.models.values()) and width > 1:
        pairs = ob.profile_similarity(state.params, width).groupBy("model_id").agg(F.expr("sum(cosine * cosine)"))
        penalty = {r[0]: r[1] for r in pairs.collect()}
    out, s = {}, data.n_features
    for i, m in state.models.items():
        mass, plogp = masses[i]
        value = fits[i] + sum(r * e for r, e in zip(mass, m.elog_pi)) - plogp
        groups = m.p["k_max"] if spec.frozen_groups else None
        value -= ob.weights_kl(spec.weights, m.a, m.b, m.p, groups)
        for k in range(m.k):
            value -= ob.dirichlet_kl_value(sums[i][f"ls{k}"], sums[i][f"lg{k}"], sums[i][f"ld{k}"], s, m.p["zeta"])
        value -= ob.dirichlet_kl_value(sums[i]["isum"], sums[i]["ig"], sums[i]["idev"], s, m.p["eta"])
        view = copy.copy(m)
        view.selection_kl = kls[i]
        value -= _selection_kl(data, spec, view)
        value -= m.p.get("repulsion", 0.0) * (penalty.get(i) or 0.0)
        m.plogp = plogp
        out[i] = value
    return out


# --- pruning ----------------------------------------------------------------------------


def min_size(data: CountData, spec: Spec, p: dict) -> float:
    return max(1.0, data.n_samples / (5.0 * p["k_max"])) if spec.min_size == "adaptive" else 1.0


def kept_groups(weights: list[float], sizes: list[float], threshold: float, size: float, floor: int) -> list[int]:
    """Groups that pass both tests; at least ``floor`` of them, heaviest first (ties: lowest number)."""
    keep = [k for k, (w, n) in enumerate(zip(weights, sizes)) if w > threshold and n > size]
    if len(keep) < floor:
        keep = sorted(sorted(range(len(weights)), key=lambda k: (-weights[k], k))[:floor])
    return keep


def select_groups(state: State, keep: dict[int, list[int]]) -> State:
    """The state with only the listed groups; memberships sum to one again."""
    spark = state.params.sparkSession
    rows = pd.DataFrame([{"model_id": i, "keep": k} for i, k in keep.items()])
    chosen = F.broadcast(spark.createDataFrame(rows, "model_id int, keep array<int>"))

    def pick(col):
        return F.expr(f"transform(keep, k -> get({col}, k))")

    params = state.params.join(chosen, "model_id").withColumn("lam", pick("lam"))
    if dict(state.params.dtypes).get("f") == "array<double>":
        params = params.withColumn("f", pick("f"))
    resp = state.resp.join(chosen, "model_id").withColumn("_u", pick("r")).drop("r", "keep")
    resp = normalised(resp, "_u", "r").select("model_id", "sample_id", "r")
    models = copy.deepcopy(state.models)
    for i, kept in keep.items():
        m = models[i]
        m.k = len(kept)
        m.a = [m.a[k] for k in kept]
        m.b = None if m.b is None else [m.b[k] for k in kept]
        m.lam_sum = [m.lam_sum[k] for k in kept]
        m.mass = [m.mass[k] for k in kept]
        m.elog_pi = wt.elog(m.a, m.b)
    return State(models, params.drop("keep"), resp, state.cells)


def passing_groups(data: CountData, spec: Spec, state: State,
                   frozen_elog: dict[int, list[float]] | None = None) -> tuple[dict[int, list[int]], set[int]]:
    """The groups that stay per model, and the models that lose some."""
    keep, changed = {}, set()
    for i, m in state.models.items():
        elog = (frozen_elog or {}).get(i, m.elog_pi)
        weights = wt.means(spec.weights, m.a, m.b, elog)
        keep[i] = kept_groups(weights, m.mass, m.p["prune_threshold"], min_size(data, spec, m.p), m.p["min_clusters"])
        if len(keep[i]) < m.k:
            changed.add(i)
        else:
            keep[i] = list(range(m.k))
    return keep, changed


def prune(data: CountData, spec: Spec, state: State, frozen_elog: dict[int, list[float]] | None = None) -> tuple[State, set[int]]:
    """Drop groups that are light or small. Returns the new state and the models that changed."""
    keep, changed = passing_groups(data, spec, state, frozen_elog)
    if not changed:
        return state, changed
    new = select_groups(state, keep)
    masses = read_masses(new, new.resp)
    for i in changed:
        m = new.models[i]
        m.mass, m.plogp = masses[i]
        if spec.weights == "nig":
            m.a, m.b = wt.update("nig", m.mass, m.p)
            m.elog_pi = wt.elog(m.a, m.b)
        m.pruned = True
    return new, changed


# --- fit --------------------------------------------------------------------------------


@dataclass
class Fit:
    """A finished fit: tables keyed by model_id and the driver's numbers per model."""

    data: CountData
    spec: Spec
    state: State
    failed: dict[int, str] = field(default_factory=dict)  # models dropped for non-finite numbers

    @property
    def models(self) -> dict[int, Model]:
        return self.state.models

    def weights(self, i: int) -> list[float]:
        m = self.models[i]
        return m.final_weights or wt.means(self.spec.weights, m.a, m.b, m.elog_pi)

    def history(self) -> DataFrame:
        rows = [(i, t, float(v), k) for i, m in self.models.items() for t, v, k in m.history]
        return self.data.spark.createDataFrame(rows, "model_id int, iter int, elbo double, k int")


def broken(m: Model) -> bool:
    """Has a model left the range of finite numbers?"""
    return not all(math.isfinite(v) for v in (*m.mass, *m.lam_sum, m.iota_sum, *m.elog_pi))


def _stopped(spec: Spec, m: Model, t: int) -> bool:
    p = m.p
    if spec.stop == "rate" or len(m.history) < 3:
        return False
    allowed = {
        "pruned": m.pruned,
        "after_start": t > p["prune_start"],
        "after_anneal": m.pruned and t > p.get("tau2", 0),
    }[spec.stop]
    return allowed and all(c < p["tol"] for c in relative_changes(m.recent(), 2))


def _rate_stopped(m: Model, window: int = 10) -> bool:
    """The mean inclusion rate of the last two windows agrees."""
    w = m.theta_window
    if m.xi_count < window or m.xi_count % 5 or len(w) < 2 * window:
        return False
    new, old = sum(w[-window:]) / window, sum(w[-2 * window:-window]) / window
    return abs(new - old) / (abs(old) + 1e-12) < m.p["tol"]


def fit_conjugate(data: CountData, spec: Spec, resp: DataFrame, params: dict[int, dict],
                  history_path: str | None = None, history_every: int = 10) -> Fit:
    """Run the fit of ``spec`` for every model of ``params`` from the starting memberships.

    ``history_path`` keeps memberships and selection of every ``history_every``-th round.
    """
    state = start_state(data, spec, resp, params)
    anchor = state.resp
    live, done, failed = state, [], {}
    limit = max(p["max_iter"] for p in params.values())
    for t in range(1, limit + 1):
        p = next(iter(live.models.values())).p
        beta, density, gated, averaging = 1.0, 0.0, True, False
        if spec.anneal in ("thermal", "density"):
            beta, density = two_phase_anneal(t - 1, p["beta0"], p["s0"], p["tau1"], p["tau2"])
        prune_start = p["prune_start"]
        if spec.anneal == "density":
            prune_start = max(prune_start, p["tau1"] + p["prune_every"])
        if spec.selection == "ssl_excess":
            gated, averaging = t > p["burn_in"], t >= p["burn_in"] + 10
            if t >= p["burn_in"] + 10:
                freeze_baselines(data, live)
        frozen = {i: m.elog_pi for i, m in live.models.items()}
        scored = t % 10 == 0
        old = live
        packed = None
        if spec.selection != "sample" and density <= 1e-8:
            packed = packed_cells(data, live.width, len(live.models))
        live = sweep(data, spec, live, beta, density, anchor, gated, averaging, want_objective=scored, packed=packed)

        def with_resp(state: State) -> State:
            if state.resp is None:  # from the tables the sweep in one pass started from
                state.resp = data.ws.put(memberships(data, spec, old.only(state.models), beta, density, gated), "resp")
            return state

        lost = [i for i, m in live.models.items() if broken(m)]
        if lost:
            failed.update({i: f"non-finite values in round {t}" for i in lost})
            if len(lost) == len(live.models):
                break
            live = live.only([i for i in live.models if i not in lost])

        window = t >= prune_start and t % p["prune_every"] == 0
        if spec.selection == "ssl_excess":
            window = window and gated and not averaging
        changed: set[int] = set()
        if window and passing_groups(data, spec, live, frozen)[1]:
            live, changed = prune(data, spec, with_resp(live), frozen)
        if scored:
            values = {i: m.elbo for i, m in live.models.items()}
            if changed:
                values.update(fresh_objective(data, spec, live.only(changed)))
            for i, m in live.models.items():
                m.history.append((t, values[i], m.k))
        if history_path and t % history_every == 0:
            save_round(with_resp(live), history_path, t)
        finished = []
        for i, m in live.models.items():
            m.n_iter = t
            if scored and spec.stop != "rate" and _stopped(spec, m, t) or spec.stop == "rate" and _rate_stopped(m):
                m.converged = True
            if m.converged or t >= m.p["max_iter"]:
                finished.append(i)
        if finished:
            live = with_resp(live)
        if old.resp is not anchor:
            data.ws.release(old.resp)
        data.ws.release(old.params, old.cells)
        if finished:
            part = live.only(finished)
            if len(finished) < len(live.models):
                part = _settled(data, part)
            done.append(part)
            left = [i for i in live.models if i not in finished]
            done[-1] = _finish(data, spec, part, {i: frozen[i] for i in finished})
            if not left:
                break
            live = live.only(left)
    if not done:
        raise ArithmeticError(f"every model failed: {failed}")
    return Fit(data, spec, join_states(done), failed)


def _settled(data: CountData, part: State) -> State:
    """Own copies of the tables of models that stop while others go on."""
    ws, key = data.ws, data.sample_key + ["model_id"]
    cells = None if part.cells is None else ws.put(
        part.cells.repartition(data.buckets, *key), "cells-done", bucket_by=key, buckets=data.buckets)
    return State(part.models, ws.put(part.params, "params-done"), ws.put(part.resp, "resp-done"), cells)


def _finish(data: CountData, spec: Spec, state: State, frozen: dict[int, list[float]]) -> State:
    """Average the selection where the fit asks for it, then prune once more."""
    if spec.selection == "ssl_excess" and "f_sum" in state.params.columns:
        count = per_model({i: max(m.xi_count, 1) for i, m in state.models.items()})
        state.params = state.params.withColumn("f", F.expr(clip(f"f_sum / {count}", EPS, 1.0 - EPS)))
    # the last round's logs stay in use here unless its pruning already renewed them
    stale = {i: e for i, e in frozen.items() if len(e) == state.models[i].k}
    new, changed = prune(data, spec, state, stale)
    for i, m in new.models.items():
        elog = m.elog_pi if i in changed else stale.get(i, m.elog_pi)
        m.final_weights = wt.means(spec.weights, m.a, m.b, elog)
    return new


def save_round(state: State, path: str, t: int) -> None:
    """Append memberships and selection of one round below ``path``."""
    (state.resp.withColumn("iter", F.lit(t)).write.mode("append").partitionBy("iter").parquet(f"{path}/resp"))
    if "f" in state.params.columns:
        table = state.params.select("model_id", "feature_id", "f")
    else:
        table = state.params.select("model_id", "feature_id", "f_total", "n_selected")
    table.withColumn("iter", F.lit(t)).write.mode("append").partitionBy("iter").parquet(f"{path}/selection")
    if state.cells is not None:
        cells = state.cells.select("model_id", "sample_id", "feature_id", "f")
        cells.withColumn("iter", F.lit(t)).write.mode("append").partitionBy("iter").parquet(f"{path}/cell_selection")
