"""Entry points: fit a model by name, with restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallymix.operators.cells import CountData, prepare
from tallymix.operators.initial import Start, init_from_labels, init_kmeans, init_random
from tallymix.plans.base import BaseFit, best_start, fit_base
from tallymix.plans.mixture import Fit, fit_conjugate
from tallymix.plans.moves import best_model, fit_with_moves
from tallymix.plans.specs import FITS, Spec
from tallymix.plans.stochastic import BatchFit, best_batch_fit, fit_stochastic, stochastic_params
from tallymix.workspace import Workspace


def as_data(counts: DataFrame | CountData, **options) -> CountData:
    if isinstance(counts, CountData):
        return counts
    return prepare(counts, Workspace(counts.sparkSession), **options)


def starting_memberships(data: CountData, starts: list[Start], init, n_init: int, max_iter: int) -> DataFrame:
    """Memberships from k-means, random draws, or given labels ``(sample_id, label)``."""
    if isinstance(init, DataFrame):
        if "r" in init.columns:
            return init
        parts = [init_from_labels(init, s.k, s.model_id) for s in starts]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    if init == "random":
        return init_random(data.samples, starts)
    return init_kmeans(data, starts, n_init, max_iter)


def fit_models(data: CountData, spec: Spec, params: dict[int, dict], seeds: dict[int, int], init="kmeans",
               n_init: int = 10, kmeans_iter: int | None = None, **options) -> Fit:
    """Fit several models of one kind in the same jobs."""
    starts = [Start(i, p["k_max"], seeds[i]) for i, p in params.items()]
    resp = starting_memberships(data, starts, init, n_init, kmeans_iter or (300 if spec.moves else 100))
    if spec.moves:
        return fit_with_moves(data, spec, resp, params, seed=min(seeds.values()))
    return fit_conjugate(data, spec, resp, params, **options)


def fit(counts: DataFrame | CountData, model: str = "dp", init="kmeans", seed: int = 42, n_init: int = 10,
        n_restarts: int | None = None, per_sample: bool | None = None, kmeans_iter: int | None = None,
        history_path: str | None = None, **given) -> Fit | BaseFit | BatchFit:
    """Fit one model; with restarts, all starts share the jobs and the best objective wins.

    ``model`` is a key of ``FITS``, ``base`` (first-order, ``given`` goes to ``fit_base``) or ``stochastic``
    (mini-batches); ``given`` overrides its defaults. ``per_sample`` switches selection between one value per cell and
    one per feature where the fit has both. ``history_path`` keeps memberships and selection of every tenth round;
    fits with moves and mini-batches refuse it.
    """
    if model in ("base", "stochastic") and per_sample is not None:
        raise ValueError(f"{model} has one selection mode")
    if history_path and (model == "stochastic" or model in FITS and FITS[model].moves):
        raise ValueError(f"{model} keeps no tables per round")
    if model == "base":
        out = fit_base(as_data(counts), init=init, seed=seed, n_init=n_restarts or 1, history_path=history_path, **given)
        return best_start(out)
    if model == "stochastic":
        data, p = as_data(counts), stochastic_params(**given)
        params = {i: dict(p) for i in range(n_restarts or 1)}
        starts = [Start(i, p["k_max"], seed + 1000 * i) for i in params]
        plain = isinstance(init, str) and init == "kmeans"  # its own start: noisy k-means
        resp = None if plain else starting_memberships(data, starts, init, n_init, kmeans_iter or 100)
        return best_batch_fit(fit_stochastic(data, params, resp, seed))
    spec = FITS[model]
    if per_sample is not None:
        if spec.weights == "dp" or spec.moves:
            raise ValueError(f"{model} has one selection mode")
        spec = spec.per_sample(per_sample)
    data = as_data(counts)
    p = spec.params(**given)
    restarts = n_restarts or p.get("n_restarts", 1)
    params = {i: dict(p) for i in range(restarts)}
    options = {"history_path": history_path} if history_path else {}
    out = fit_models(data, spec, params, {i: seed + 1000 * i for i in params}, init, n_init, kmeans_iter, **options)
    if restarts == 1:
        return out
    if spec.moves:
        return best_model(out)
    return best_model(out, value=lambda m: m.history[-1][1] if m.history else float("-inf"))
