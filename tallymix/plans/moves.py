"""Fits that change the set of groups: merge, delete and split proposals.

A proposal is a new version of the model's tables. It settles for a few sweeps and
replaces the old version only if the full objective does not fall. Models (restarts)
propose, settle and decide in the same jobs; each model's decision is its own.
"""

from __future__ import annotations

import copy

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.special import EPS, normalised, num
from tallymix.operators import objective as ob
from tallymix.operators import weights as wt
from tallymix.operators.cells import CountData, sums_by_feature
from tallymix.operators.initial import Start, kmeans
from tallymix.operators.profiles import MEMBER, PROFILE_FLOOR, per_model
from tallymix.plans.mixture import (
    Fit, State, _settled, fresh_objective, full_objective, join_states, read_masses, read_profile_totals, start_state, sweep,
)
from tallymix.plans.specs import Spec, linear_anneal, relative_changes

SETTLE = {"merge": 8, "merge_gated": 8, "split": 8, "delete": 5}  # sweeps before a proposal is judged
SIMILAR_COSINE, SIMILAR_KL = 0.95, 0.1  # a gated merge needs one of them


def _choices(data: CountData, rows: list[dict], columns: list[str]) -> DataFrame:
    """One row per proposing model, small enough to broadcast."""
    schema = "model_id int, " + ", ".join(f"{c} int" for c in columns)
    return F.broadcast(data.spark.createDataFrame(pd.DataFrame(rows, columns=["model_id", *columns]), schema))


def _others(dropped: str, array: str) -> str:
    """Indices of an array without one of them."""
    return f"filter(sequence(0, size({array}) - 1), i -> i <> {dropped})"


def _floored(rows: DataFrame, expr: str) -> DataFrame:
    lifted = rows.withColumn("_u", F.expr(f"transform({expr}, v -> greatest(v, {num(EPS)}))")).drop("r")
    return normalised(lifted, "_u", "r")


def _renew(data: CountData, spec: Spec, state: State) -> None:
    """Masses, totals and expected logs of changed models."""
    masses = read_masses(state, state.resp)
    for i, m in state.models.items():
        m.mass, m.plogp = masses[i]
        if spec.weights == "nig":
            m.a, m.b = wt.update("nig", m.mass, m.p)
        m.elog_pi = wt.elog(m.a, m.b)
    read_profile_totals(spec, state)


def merge_pairs(state: State, gated: bool) -> dict[int, tuple[int, int]]:
    """Per model the most similar pair of profiles; ``gated`` asks for real similarity first."""
    width = state.width
    if width < 2:
        return {}
    pairs = ob.profile_similarity(state.params, width)
    if gated:
        pairs = pairs.join(ob.profile_sym_kl(state.params, width), ["model_id", "i", "j"]).where(
            (F.col("cosine") > SIMILAR_COSINE) | (F.col("sym_kl") < SIMILAR_KL)
        )
    best: dict[int, tuple] = {}
    for r in pairs.collect():  # at most K*K/2 rows per model
        rank = (-r["cosine"], r["i"], r["j"])
        if r["model_id"] not in best or rank < best[r["model_id"]]:
            best[r["model_id"]] = rank
    return {i: (rank[1], rank[2]) for i, rank in best.items()}


def propose_merge(data: CountData, spec: Spec, state: State, gated: bool) -> State | None:
    able = [i for i, m in state.models.items() if m.k > m.p["min_clusters"]]
    if not able:
        return None
    pairs = merge_pairs(state.only(able), gated)
    if not pairs:
        return None
    part, ws = state.only(pairs), data.ws
    rows = [{"model_id": i, "k1": a, "k2": b} for i, (a, b) in pairs.items()]
    choice = _choices(data, rows, ["k1", "k2"])
    pooled = f"transform({_others('k2', 'r')}, i -> if(i = k1, get(r, k1) + get(r, k2), get(r, i)))"
    resp = ws.put(_floored(part.resp.join(choice, "model_id"), pooled).select("model_id", "sample_id", "r"), "resp-merge")
    weight = resp.join(choice, "model_id").selectExpr("model_id", "sample_id", "get(r, k1) as w")
    sums = sums_by_feature(data.with_samples(part.cells, weight, ["model_id"]), [F.expr("sum(w * f * x) as pooled")])
    models = copy.deepcopy(part.models)
    zeta = per_model({i: m.p["zeta"] for i, m in models.items()})
    fresh = f"greatest({zeta} + coalesce(pooled, 0D), {num(PROFILE_FLOOR)})"
    params = part.params.join(choice, "model_id").join(sums, ["model_id", "feature_id"], "left")
    lam = f"transform({_others('k2', 'lam')}, i -> if(i = k1, {fresh}, get(lam, i)))"
    params = ws.put(params.selectExpr("model_id", "feature_id", "colsum", f"{lam} as lam", "iota"), "params-merge")
    for i, (_, k2) in pairs.items():
        _drop_group(models[i], k2)
    new = State(models, params, resp, part.cells)
    _renew(data, spec, new)
    return new


def _drop_group(m, k: int) -> None:
    m.k -= 1
    m.a = [v for j, v in enumerate(m.a) if j != k]
    m.b = None if m.b is None else [v for j, v in enumerate(m.b) if j != k]


def propose_delete(data: CountData, spec: Spec, state: State) -> State | None:
    able = [i for i, m in state.models.items() if m.k > m.p["min_clusters"]]
    if not able:
        return None
    part, ws = state.only(able), data.ws
    masses = read_masses(part, part.resp)
    smallest = {i: min(range(len(v[0])), key=lambda k: v[0][k]) for i, v in masses.items()}
    choice = _choices(data, [{"model_id": i, "kd": k} for i, k in smallest.items()], ["kd"])
    rows = part.resp.join(choice, "model_id")
    rows = rows.withColumn("rest", F.expr(f"transform({_others('kd', 'r')}, i -> get(r, i))"))
    rows = rows.withColumn("_rs", F.expr(f"aggregate(rest, 0D, (a, v) -> a + v) + {num(EPS)}"))
    spread = "transform(rest, v -> v + get(r, kd) * v / _rs)"
    resp = ws.put(_floored(rows, spread).select("model_id", "sample_id", "r"), "resp-delete")
    lam = f"transform({_others('kd', 'lam')}, i -> get(lam, i))"
    params = ws.put(
        part.params.join(choice, "model_id").selectExpr("model_id", "feature_id", "colsum", f"{lam} as lam", "iota"),
        "params-delete")
    models = copy.deepcopy(part.models)
    for i, k in smallest.items():
        _drop_group(models[i], k)
    new = State(models, params, resp, part.cells)
    _renew(data, spec, new)
    return new


def propose_split(data: CountData, spec: Spec, state: State, seed: int) -> State | None:
    able = [i for i, m in state.models.items() if m.k < m.p["k_max"]]
    if not able:
        return None
    ws = data.ws
    part = state.only(able)
    masses = read_masses(part, part.resp)
    largest = {i: max(range(len(v[0])), key=lambda k: (v[0][k], -k)) for i, v in masses.items()}
    choice = _choices(data, [{"model_id": i, "ks": k} for i, k in largest.items()], ["ks"])
    marked = part.resp.join(choice, "model_id").where(f"get(r, ks) > {num(MEMBER)}")
    members = ws.put(marked.select("model_id", "sample_id"), "members")
    sizes = {r["model_id"]: r["n"] for r in members.groupBy("model_id").agg(F.count("*").alias("n")).collect()}
    able = [i for i in able if sizes.get(i, 0) >= 4]
    if not able:
        return None
    starts = [Start(i, 2, seed + i) for i in able]
    labels = ws.put(
        kmeans(data, starts, n_init=5, max_iter=100, members=members.where(F.col("model_id").isin(able))), "halves")
    halves: dict[int, set] = {}
    for r in labels.select("model_id", "label").distinct().collect():
        halves.setdefault(r["model_id"], set()).add(r["label"])
    able = [i for i in able if len(halves.get(i, ())) == 2]
    if not able:
        return None
    part = part.only(able)
    rows = part.resp.join(choice, "model_id").join(labels, ["model_id", "sample_id"], "left")
    eps = num(EPS)
    halved = (
        f"concat(transform(r, (v, i) -> if(i = ks and label = 1, {eps}, v)), "
        f"array(if(label = 1, get(r, ks), {eps})))"
    )
    halved = halved.replace("label = 1", "coalesce(label, 0) = 1")
    grown = _floored(rows, halved)
    resp = ws.put(grown.select("model_id", "sample_id", "r"), "resp-split")
    weight = resp.join(labels, ["model_id", "sample_id"]).join(choice, "model_id").selectExpr(
        "model_id", "sample_id", "if(label = 0, get(r, ks), 0D) as wa", "if(label = 1, get(r, size(r) - 1), 0D) as wb"
    )
    sums = sums_by_feature(
        data.with_samples(data.cells, weight), [F.expr("sum(wa * x) as xa"), F.expr("sum(wb * x) as xb")]
    )
    models = copy.deepcopy(part.models)
    zeta, floor = per_model({i: m.p["zeta"] for i, m in models.items()}), num(PROFILE_FLOOR)
    lam = (
        f"concat(transform(lam, (v, i) -> if(i = ks, greatest({zeta} + coalesce(xa, 0D), {floor}), v)), "
        f"array(greatest({zeta} + coalesce(xb, 0D), {floor})))"
    )
    params = part.params.join(choice, "model_id").join(sums, ["model_id", "feature_id"], "left")
    params = ws.put(params.selectExpr("model_id", "feature_id", "colsum", f"{lam} as lam", "iota"), "params-split")
    for m in models.values():
        if spec.weights == "mfm":
            m.a.append(m.p["delta"] + m.p["gamma"] / (m.p["k_max"] if spec.frozen_groups else m.k))
        m.k += 1
    new = State(models, params, resp, part.cells)
    _renew(data, spec, new)
    return new


def try_move(data: CountData, spec: Spec, state: State, kind: str, seed: int = 0) -> tuple[State, set[int]]:
    """One proposal per model; returns the state after the decisions and the models that accepted."""
    if kind == "split":
        new = propose_split(data, spec, state, seed)
    elif kind == "delete":
        new = propose_delete(data, spec, state)
    else:
        new = propose_merge(data, spec, state, gated=kind == "merge_gated")
    if new is None:
        return state, set()
    before = full_objective(data, spec, state.only(new.models))
    for _ in range(SETTLE[kind]):
        old, new = new, sweep(data, spec, new, want_objective=False)
        data.ws.release(old.params, old.resp, old.cells)
    after = full_objective(data, spec, new)
    accepted = {i for i in new.models if after[i] >= before[i]}
    if not accepted:
        data.ws.release(new.params, new.resp, new.cells)
        return state, accepted
    kept = [i for i in state.models if i not in accepted]
    parts = [new if len(accepted) == len(new.models) else new.only(accepted)]
    if kept:
        parts.append(state.only(kept))
        return _settled(data, join_states(parts)), accepted
    return parts[0], accepted


def move_round(data: CountData, spec: Spec, state: State, seed: int) -> tuple[State, set[int]]:
    """Every kind of move once, in the fit's order."""
    moved: set[int] = set()
    for kind in spec.moves:
        state, accepted = try_move(data, spec, state, kind, seed)
        moved |= accepted
    return state, moved


def exhaust_moves(data: CountData, spec: Spec, state: State, seed: int) -> State:
    """Rounds of moves per model until a round accepts nothing (at most K_max rounds)."""
    rest, done = state, []
    rounds = max(m.p["k_max"] for m in state.models.values())
    for t in range(rounds):
        rest, moved = move_round(data, spec, rest, seed + 7919 * (t + 1))
        still = [i for i in rest.models if i not in moved]
        if not moved:
            break
        if still:
            done.append(rest.only(still))
            rest = rest.only(moved)
    return join_states([*done, rest])


def _fast(data: CountData, spec: Spec, state: State, moved: set[int]) -> dict[int, float]:
    """The light objective; repulsion belongs to it where the fit has one."""
    values = {i: m.elbo for i, m in state.models.items()}
    if moved:
        values.update(fresh_objective(data, spec, state.only(moved)))
    weights = {i: m.p.get("repulsion", 0.0) for i, m in state.models.items()}
    if any(weights.values()) and state.width > 1:
        pairs = ob.profile_similarity(state.params, state.width).groupBy("model_id").agg(F.expr("sum(cosine * cosine)"))
        for i, v in pairs.collect():
            values[i] -= weights[i] * (v or 0.0)
    return values


def fit_with_moves(data: CountData, spec: Spec, resp: DataFrame, params: dict[int, dict], seed: int = 42) -> Fit:
    """Anneal, sweep and move every model (one per restart); ``best_model`` picks among them."""
    live, done = start_state(data, spec, resp, params), []
    limit = max(p["max_iter"] for p in params.values())
    for t in range(1, limit + 1):
        p = next(iter(live.models.values())).p
        beta = linear_anneal(t, p["beta_start"], p["beta_end"], p["anneal_iters"])
        annealed = p["beta_start"] >= 1.0 or t >= p["anneal_iters"]
        old = live
        live = sweep(data, spec, live, beta, want_objective=t % 10 == 0)
        data.ws.release(old.params, old.resp, old.cells)
        checked: set[int] = set()
        if annealed and t % p["merge_every"] == 0:
            live, moved = move_round(data, spec, live, seed + t)
            checked = set(live.models)  # the moves end with fresh expected logs
            for i in moved:
                live.models[i].history = []
        if t % 10 == 0:
            for i, v in _fast(data, spec, live, checked).items():
                live.models[i].history.append((t, v, live.models[i].k))
        finished = []
        for i, m in live.models.items():
            m.n_iter = t
            late = annealed and t > m.p["anneal_iters"] + m.p["merge_every"] and len(m.history) >= 3
            if t % 10 == 0 and late and all(c < m.p["tol"] for c in relative_changes(m.recent(), 2)):
                m.converged = True
            if m.converged or t >= m.p["max_iter"]:
                finished.append(i)
        if finished:
            left = [i for i in live.models if i not in finished]
            done.append(_settled(data, live.only(finished)) if left else live.only(finished))
            if not left:
                break
            live = live.only(left)
    settled = join_states(done)
    final = exhaust_moves(data, spec, settled, seed)
    return _choose(data, spec, settled, final)


def _choose(data: CountData, spec: Spec, settled: State, final: State) -> Fit:
    """Per model: the final state, or under ICL the better of the settled and the final one."""
    value = full_objective(data, spec, final)
    for i, m in final.models.items():
        m.elbo = ob.icl(value[i], m.plogp) if spec.choose == "icl" else value[i]
    if spec.choose == "icl":
        before = full_objective(data, spec, settled)
        for i, m in settled.models.items():
            m.elbo = ob.icl(before[i], m.plogp)
        earlier = [i for i in final.models if settled.models[i].elbo > final.models[i].elbo]
        later = [i for i in final.models if i not in earlier]
        final = join_states([s.only(ids) for s, ids in ((settled, earlier), (final, later)) if ids])
    for m in final.models.values():
        m.final_weights = wt.means(spec.weights, m.a, m.b, m.elog_pi)
    return Fit(data, spec, final)


def best_model(fit: Fit, value=lambda m: m.elbo) -> Fit:
    """The fit reduced to its best model (ties: lowest id)."""
    best = max(sorted(fit.models), key=lambda i: (value(fit.models[i]), -i))
    return Fit(fit.data, fit.spec, fit.state.only([best]))
