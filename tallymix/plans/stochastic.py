"""Mini-batch fit of the Dirichlet-multinomial mixture with per-group selection.

One step touches only the cells of a batch of samples: memberships under the current
profiles, then blended updates of sticks, profiles, background and selection. The same
step is driven by sampled batches (``fit_stochastic``) and by a stream.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.special import digamma, lgamma, num
from tallymix.operators import likelihood as lk
from tallymix.operators import objective as ob
from tallymix.operators import profiles as pf
from tallymix.operators import selection as sl
from tallymix.operators import weights as wt
from tallymix.operators.cells import CountData, sums_by_feature, sums_by_sample
from tallymix.operators.initial import Start, add_noise, init_kmeans
from tallymix.operators.likelihood import unfold
from tallymix.operators.prep import batch_window, in_window, shuffled_places
from tallymix.plans.specs import relative_changes, remap_concentration, step_size

DEFAULTS = dict(
    k_max=10, concentration=1.0, f0=0.3, prune_threshold=0.01, min_clusters=None, burn_in=100,
    batch_size=256, max_iter=1000, tol=1e-4,
)


def stochastic_params(**given) -> dict:
    p = {**DEFAULTS, **given}
    unknown = set(given) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"the stochastic fit does not take {sorted(unknown)}")
    if p["min_clusters"] is None:
        p["min_clusters"] = max(2, p["k_max"] // 4)
    p["alpha"], p["more_clusters"] = remap_concentration(p["concentration"])
    return p


@dataclass
class BatchModel:
    """The numbers of one model that live on the driver."""

    model_id: int
    p: dict
    k: int
    rho: list[float] = field(default_factory=list)
    tau: list[float] = field(default_factory=list)
    lam_sum: list[float] = field(default_factory=list)
    iota_sum: float = 0.0
    eff_sum: list[float] = field(default_factory=list)  # totals of the blended profiles
    mass: list[float] = field(default_factory=list)
    history: list[tuple[int, float, int]] = field(default_factory=list)
    converged: bool = False
    n_iter: int = 0

    @property
    def weights(self) -> list[float]:
        return wt.means("stochastic", self.rho, self.tau)


@dataclass
class BatchFit:
    data: CountData
    models: dict[int, BatchModel]
    params: DataFrame  # model_id, feature_id, lam ARRAY, iota, phi ARRAY
    resp: DataFrame | None = None

    @property
    def width(self) -> int:
        return max(m.k for m in self.models.values())


def _table(data: CountData, models: dict[int, BatchModel]) -> DataFrame:
    rows = [
        (i, m.k, wt.elog(m.rho, m.tau, clipped=True), m.lam_sum, float(m.iota_sum), m.eff_sum, m.mass,
         float(m.p["f0"]))
        for i, m in models.items()
    ]
    columns = ["model_id", "k_live", "elog_pi", "lam_sum", "iota_sum", "eff_sum", "mass", "f0"]
    schema = (
        "model_id int, k_live int, elog_pi array<double>, lam_sum array<double>, iota_sum double, "
        "eff_sum array<double>, mass array<double>, f0 double"
    )
    return F.broadcast(data.spark.createDataFrame(pd.DataFrame(rows, columns=columns), schema))


EFFECTIVE = "transform(lam, (v, i) -> greatest(get(phi, i) * v / get(lam_sum, i) + (1D - get(phi, i)) * iota / iota_sum, 1e-10D))"


def read_totals(data: CountData, params: DataFrame, models: dict[int, BatchModel]) -> None:
    """Totals of profiles, background and blended profiles over all features."""
    width = max(m.k for m in models.values())
    flat = params.selectExpr("model_id", "iota", *unfold("lam", "l", width))
    names = ["iota", *[f"l{k}" for k in range(width)]]
    for r in flat.groupBy("model_id").agg(*[F.expr(f"sum({n}) as {n}") for n in names]).collect():
        m = models[r["model_id"]]
        m.iota_sum, m.lam_sum = r["iota"], [r[f"l{k}"] for k in range(m.k)]
    eff = params.join(_table(data, models), "model_id").selectExpr("model_id", f"{EFFECTIVE} as eff")
    flat = eff.selectExpr("model_id", *unfold("eff", "e", width))
    for r in flat.groupBy("model_id").agg(*[F.expr(f"sum(e{k}) as e{k}") for k in range(width)]).collect():
        m = models[r["model_id"]]
        m.eff_sum = [r[f"e{k}"] for k in range(m.k)]


def batch_memberships(data: CountData, params: DataFrame, models: dict[int, BatchModel]) -> DataFrame:
    """``model_id, sample_id, r, log_norm`` for the samples of ``data``; no floor on memberships."""
    width = max(m.k for m in models.values())
    table = _table(data, models)
    eff = params.join(table, "model_id").selectExpr("model_id", "feature_id", f"{EFFECTIVE} as eff")
    eff = eff.selectExpr("model_id", "feature_id", "eff", f"transform(eff, v -> {lgamma('v')}) as le")
    eff = eff.selectExpr("model_id", "feature_id", *unfold("eff", "e", width), *unfold("le", "le", width))
    joined = data.with_features(data.cells, eff, 2 * width, len(models))
    joined = joined.selectExpr("*", *[f"x + e{k} as xe{k}" for k in range(width)])
    ll = data.add_empty_samples(
        sums_by_sample(joined, lk.dm_sums(width)), sorted(models), [f"ll{k}" for k in range(width)]
    )
    rows = ll.join(data.samples.select("sample_id", "n_i"), "sample_id").join(table, "model_id")
    whole = [
        f"ll{k} + {lgamma(f'get(eff_sum, {k})')} - {lgamma(f'n_i + get(eff_sum, {k})')} as ll{k}" for k in range(width)
    ]
    rows = rows.selectExpr("model_id", "sample_id", "k_live", "elog_pi", *whole)
    return lk.responsibilities(rows, width, None, "log_norm", tempered=False).select(
        "model_id", "sample_id", "r", "log_norm"
    )


def _shifted(batch: CountData, params: DataFrame, table: DataFrame, resp: DataFrame, function, width: int,
             n_models: int) -> DataFrame:
    """Batch cells with memberships ``r0..``, shifted counts ``xa0.., xb`` and ``function`` of the shifts alone ``pa0.., pb``."""
    means = params.join(table, "model_id").selectExpr(
        "model_id", "feature_id", "transform(lam, (v, i) -> v / get(lam_sum, i)) as a", "iota / iota_sum as b")
    means = means.selectExpr(
        "model_id", "feature_id", "a", "b", f"transform(a, v -> {function('v')}) as pa", f"{function('b')} as pb")
    means = means.selectExpr(
        "model_id", "feature_id", *unfold("a", "a", width), *unfold("pa", "pa", width), "b", "pb")
    joined = batch.with_samples(batch.with_features(batch.cells, means, 2 * width + 2, n_models), resp, ["model_id"])
    return joined.selectExpr("*", *[f"x + a{k} as xa{k}" for k in range(width)], "x + b as xb")


def batch_step(batch: CountData, params: DataFrame, models: dict[int, BatchModel], n_total: float, t: int,
               ) -> tuple[DataFrame, dict[int, BatchModel]]:
    """One blended update from the samples of ``batch``; ``n_total`` is the size of the whole table."""
    ws, width = batch.ws, max(m.k for m in models.values())
    models = copy.deepcopy(models)
    step, scale = step_size(t), n_total / max(batch.n_samples, 1)
    resp = ws.put(batch_memberships(batch, params, models), "batch-resp")
    for r in ob.membership_parts(resp, width).collect():  # one row per model
        models[r["model_id"]].mass = [v or 0.0 for v in r["mass"][: models[r["model_id"]].k]]
    table = _table(batch, models)
    flat = pf.unfolded(resp, width)

    # profiles and background, from the profiles of the step's start
    joined = _shifted(batch, params, table, flat, digamma, width, len(models))
    gains = [F.expr(f"sum(r{k} * ({digamma(f'xa{k}')} - pa{k})) as g{k}") for k in range(width)]
    gains.append(F.expr(f"sum({digamma('xb')} - pb) as gb"))
    sums = pf.packed_sums(sums_by_feature(joined, gains), "g", width, "g")
    rows = params.join(sums, ["model_id", "feature_id"], "left").join(table, "model_id")
    gradient = f"{num(scale)} * get(phi, i) * coalesce(get(g, i), 0D)"
    lam = f"transform(lam, (v, i) -> {pf.lambda_stochastic('get(mass, i)', gradient, 'v', step)})"
    push = f"(1D - array_max(phi)) * coalesce(gb, 0D) / {num(max(batch.n_samples, 1))} * {num(n_total)}"
    half = ws.put(
        rows.selectExpr("model_id", "feature_id", f"{lam} as lam", f"{pf.iota_stochastic(push, 'iota', step)} as iota", "phi"),
        "batch-profiles")
    for i, m in models.items():
        rate = step * 0.5 if m.p["more_clusters"] else step
        after = [sum(m.mass[k + 1:]) for k in range(m.k)]
        m.rho = [max((1 - rate) * a + rate * (1.0 + scale * n), 0.5) for a, n in zip(m.rho, m.mass)]
        m.tau = [max((1 - rate) * b + rate * (m.p["alpha"] + scale * n), 0.1) for b, n in zip(m.tau, after)]
    read_totals(batch, half, models)

    # selection, from the new profiles and background
    table = _table(batch, models)
    joined = _shifted(batch, half, table, flat, lgamma, width, len(models))
    likes = [F.expr(f"sum(r{k} * ({lgamma(f'xa{k}')} - pa{k})) as own{k}") for k in range(width)]
    joined = joined.withColumn("gb", F.expr(f"{lgamma('xb')} - pb"))
    likes += [F.expr(f"sum(r{k} * gb) as other{k}") for k in range(width)]
    sums = sums_by_feature(joined, likes)
    sums = pf.packed_sums(pf.packed_sums(sums, "own", width, "own"), "other", width, "other")
    rows = half.join(sums, ["model_id", "feature_id"], "left").join(table, "model_id")
    own, other = (f"({num(scale)} * coalesce(get({n}, i), 0D))" for n in ("own", "other"))
    phi = f"transform(phi, (v, i) -> {sl.select_stochastic('get(mass, i)', own, other, 'f0', 'v', step)})"
    out = ws.put(rows.selectExpr("model_id", "feature_id", "lam", "iota", f"{phi} as phi"), "batch-params")
    read_totals(batch, out, models)
    ws.release(resp, half)
    return out, models


def start_sticks(m: BatchModel) -> None:
    m.rho = [3.0 if m.p["more_clusters"] else 2.0] * m.k
    m.tau = [0.5 if m.p["more_clusters"] else m.p["alpha"]] * m.k


def kept(m: BatchModel, sizes: list[float] | None) -> list[int]:
    """Groups that survive the safe pruning rule."""
    threshold = m.p["prune_threshold"] * (0.5 if m.p["more_clusters"] else 1.0)
    least, w = (1.0 if m.p["more_clusters"] else 2.0), m.weights
    keep = [k for k in range(m.k) if w[k] > threshold and (sizes is None or sizes[k] > least)]
    if len(keep) < m.p["min_clusters"]:
        keep = sorted(sorted(range(m.k), key=lambda k: (-w[k], k))[: m.p["min_clusters"]])
    return keep


def _combine(fit: BatchFit, mix: dict[int, list[list[float]]], keep: dict[int, list[int]], norm: bool) -> BatchFit:
    """New groups as weighted sums of old profiles; memberships keep the listed columns."""
    data, models = fit.data, copy.deepcopy(fit.models)
    rows = pd.DataFrame([{"model_id": i, "mix": mix[i], "keep": keep[i]} for i in models])
    chosen = F.broadcast(data.spark.createDataFrame(rows, "model_id int, mix array<array<double>>, keep array<int>"))
    blend = "transform(mix, w -> aggregate(zip_with(w, {0}, (c, v) -> c * v), 0D, (a, v) -> a + coalesce(v, 0D)))"
    params = data.ws.put(
        fit.params.join(chosen, "model_id").selectExpr(
            "model_id", "feature_id", f"{blend.format('lam')} as lam", "iota", f"{blend.format('phi')} as phi"),
        "params-kept")
    resp = fit.resp
    if resp is not None:
        picked = "transform(keep, k -> get(r, k))"
        if norm:
            picked = f"transform({picked}, v -> v / aggregate({picked}, 0D, (a, w) -> a + w))"
        resp = resp.join(chosen, "model_id").selectExpr("model_id", "sample_id", f"{picked} as r", "log_norm")
    for i, m in models.items():
        m.k, m.rho, m.tau = len(keep[i]), [m.rho[k] for k in keep[i]], [m.tau[k] for k in keep[i]]
    read_totals(data, params, models)
    return BatchFit(data, models, params, resp)


def prune_safe(fit: BatchFit, sizes: dict[int, list[float]] | None = None) -> BatchFit:
    """Pruning after burn-in; models still burning in stay as they are."""
    keep = {}
    for i, m in fit.models.items():
        free = m.n_iter >= m.p["burn_in"]
        keep[i] = kept(m, (sizes or {}).get(i)) if free else list(range(m.k))
    if all(len(k) == fit.models[i].k for i, k in keep.items()):
        return fit
    one = {i: [[float(j == k) for j in range(fit.models[i].k)] for k in ks] for i, ks in keep.items()}
    return _combine(fit, one, keep, norm=False)


def merge_weighted(fit: BatchFit, threshold: float = 0.95) -> BatchFit:
    """Merge similar profiles as weighted averages, never below the least number of groups."""
    pairs: dict[int, list] = {i: [] for i in fit.models}
    if fit.width > 1:
        for r in ob.profile_similarity(fit.params, fit.width).collect():  # K*K/2 rows per model
            if r["cosine"] > threshold:
                pairs[r["model_id"]].append((r["i"], r["j"], r["cosine"]))
    mix, keep = {}, {}
    for i, m in fit.models.items():
        todo = sorted(pairs[i])
        if m.k <= m.p["min_clusters"]:
            todo = []
        elif m.k - len(todo) < m.p["min_clusters"]:
            todo = sorted(todo, key=lambda p: -p[2])[: m.k - m.p["min_clusters"]]
        rows = [[float(j == k) for j in range(m.k)] for k in range(m.k)]
        gone: set[int] = set()
        w = m.weights
        for a, b, _ in todo:
            if a in gone or b in gone:
                continue
            both = w[a] + w[b]
            if both > 0:
                rows[a] = [(w[a] * x + w[b] * y) / both for x, y in zip(rows[a], rows[b])]
            gone.add(b)
        keep[i] = [k for k in range(m.k) if k not in gone]
        mix[i] = [rows[k] for k in keep[i]]
    if all(len(k) == fit.models[i].k for i, k in keep.items()):
        return fit
    return _combine(fit, mix, keep, norm=True)


def _sizes(fit: BatchFit) -> dict[int, list[float]]:
    rows = ob.membership_parts(fit.resp, fit.width).collect()
    return {r["model_id"]: [v or 0.0 for v in r["mass"][: fit.models[r["model_id"]].k]] for r in rows}


STRETCHES = 1000  # folders of the cells in random order, at most


@dataclass
class BatchOrder:
    """The count table in a random order of its samples, cut into stretches with a folder each, so that a batch, a run
    of places, reads its own one or two folders and no others."""

    data: CountData
    cells: DataFrame  # as in data, with place and stretch
    samples: DataFrame
    per: int  # samples of a stretch
    size: int
    seed: int

    def batch(self, t: int) -> CountData:
        """The samples of step ``t`` and their cells."""
        window = batch_window(self.data.n_samples, self.size, t, self.seed)
        own = sorted({s for a, b in window for s in range(a // self.per, (b - 1) // self.per + 1)})
        mine = f"stretch in ({', '.join(map(str, own)) or 'null'}) and ({in_window(window)})"
        samples = self.samples.where(mine).drop("place", "stretch")
        empty = None if self.data.empty_samples is None else samples.where("nnz = 0").select("sample_id")
        return replace(self.data, cells=self.cells.where(mine).select(self.data.cell_columns), samples=samples,
                       n_samples=sum(b - a for a, b in window), empty_samples=empty)


def lay_out_batches(data: CountData, size: int | None, seed: int) -> BatchOrder:
    """Write the cells and samples once in random order; the parts written are even in cells, and a hot sample's
    slices may lie in several."""
    n, ws = data.n_samples, data.ws
    size = min(size or 256, n)
    per = max(size, -(-n // STRETCHES), 1)
    places = ws.put(shuffled_places(data.samples, seed, ws).selectExpr("*", f"cast(place div {per} as int) as stretch"), "places")
    cells = data.with_samples(data.cells, places)
    parts = max(data.buckets, min(ws.spark.sparkContext.defaultParallelism, -(-n // per)))
    slices = [c for c in data.sample_key if c != "sample_id"]
    cells = cells.repartitionByRange(parts, "place", *slices).sortWithinPartitions("stretch", "place")
    samples = data.samples.join(places, "sample_id").repartitionByRange("place").sortWithinPartitions("stretch", "place")
    return BatchOrder(data, ws.put(cells, "ordered-cells", folders_by="stretch"),
                      ws.put(samples, "ordered-samples", folders_by="stretch"), per, size, seed)


def start_batch_fit(data: CountData, params: dict[int, dict], resp: DataFrame) -> BatchFit:
    """Profiles, background and sticks from starting memberships."""
    ws = data.ws
    models = {i: BatchModel(i, p, p["k_max"]) for i, p in params.items()}
    width = max(m.k for m in models.values())
    resp = ws.put(resp.select("model_id", "sample_id", "r"), "resp")
    plain = data.spark.createDataFrame(
        [(i, m.k, 1.0, 1.0) for i, m in models.items()], "model_id int, k_live int, zeta double, eta double"
    )
    first = pf.starting_profiles(
        data.features, sorted(models), pf.member_sums(data, resp, width, "all"), pf.membership_totals(data, resp, width),
        plain, "scaled", data.n_samples, data.n_features, data.total,
    )
    table = ws.put(first.selectExpr("model_id", "feature_id", "lam", "iota", "transform(lam, v -> 0.5D) as phi"), "params")
    for m in models.values():
        start_sticks(m)
    read_totals(data, table, models)
    return BatchFit(data, models, table, resp.withColumn("log_norm", F.lit(0.0)))


def fit_stochastic(data: CountData, params: dict[int, dict], resp: DataFrame | None = None, seed: int = 42) -> BatchFit:
    """Fit by sampled batches; all models see the same batches."""
    ws = data.ws
    if resp is None:
        starts = [Start(i, p["k_max"], seed + i) for i, p in params.items()]
        resp = add_noise(init_kmeans(data, starts, n_init=3, max_iter=100), seed)
    fit = start_batch_fit(data, params, resp)
    order = lay_out_batches(data, next(iter(params.values()))["batch_size"], seed)
    limit = max(p["max_iter"] for p in params.values())
    # models that have converged go on with the others; one job serves all
    for t in range(1, limit + 1):
        old = fit.params
        new, stepped = batch_step(order.batch(t), fit.params, fit.models, data.n_samples, t)
        for m in stepped.values():
            m.n_iter = t
        fit = BatchFit(data, stepped, new, fit.resp)
        ws.release(old)
        if t % 30 == 0 and all(t > m.p["burn_in"] for m in fit.models.values()):
            fit = prune_safe(fit, _sizes(fit))
        if t % 20 == 0:
            full = ws.put(batch_memberships(data, fit.params, fit.models), "resp")
            fit.resp = full
            for r in ob.evidence(full, "log_norm").collect():
                m = fit.models[r["model_id"]]
                m.history.append((t, r["evidence"], m.k))
                values = [h[1] for h in m.history]
                m.converged = len(values) >= 5 and all(c < m.p["tol"] for c in relative_changes(values, 3))
            if all(m.converged for m in fit.models.values()):
                break
    ws.release(order.cells, order.samples)
    return finish(fit)


def finish(fit: BatchFit) -> BatchFit:
    """Memberships of all samples, then prune, merge and prune."""
    fit.resp = fit.data.ws.put(batch_memberships(fit.data, fit.params, fit.models), "resp")
    fit = prune_safe(fit, _sizes(fit))
    fit = merge_weighted(fit)
    return prune_safe(fit, _sizes(fit))


def predict_stochastic(fit: BatchFit, data: CountData | None = None) -> DataFrame:
    rows = batch_memberships(data or fit.data, fit.params, fit.models)
    return rows.select("model_id", "sample_id", lk.hard_label().alias("label"))



def best_batch_fit(fit: BatchFit) -> BatchFit:
    """The fit reduced to the model with the largest evidence of all samples (ties: lowest id)."""
    if len(fit.models) == 1:
        return fit
    found = {r["model_id"]: r["evidence"] for r in ob.evidence(
        batch_memberships(fit.data, fit.params, fit.models), "log_norm").collect()}
    best = max(sorted(found), key=lambda i: (found[i], -i))
    mine = F.col("model_id") == best
    return BatchFit(fit.data, {best: fit.models[best]}, fit.params.where(mine), fit.resp.where(mine))
