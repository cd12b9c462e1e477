"""Random hyper-parameter search: configurations are rows, trials are models of one fit."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymix.functions.special import hash_uniform, num
from tallymix.operators import metrics as mt
from tallymix.operators import report
from tallymix.operators.cells import CountData
from tallymix.operators.initial import Start
from tallymix.plans.fit import fit_models, starting_memberships
from tallymix.plans.specs import FITS, Spec
from tallymix.plans.stochastic import fit_stochastic, predict_stochastic, stochastic_params

# Default search ranges per model (parameter, kind of draw, low, high).
_PY = [("d", "uniform", 0.0, 0.8), ("theta", "log", 0.05, 5.0)]
_SSL = [("k_max", "int", 3, 15), ("nu", "log", 0.01, 2.0), ("l0", "log", 10.0, 500.0), ("l1", "log", 0.01, 10.0),
        ("kappa", "uniform", 0.01, 0.5)]
_PRUNE = ("prune_threshold", "log", 1e-4, 0.1)
_F0 = ("f0", "uniform", 0.05, 0.95)
SPACES: dict[str, list[tuple[str, str, float, float]]] = {
    "dp": [("k_max", "int", 3, 20), ("nu", "log", 1e-3, 2.0), ("prune_threshold", "log", 1e-3, 0.40), _F0],
    "stochastic": [("k_max", "int", 3, 20), ("concentration", "log", 0.01, 10.0), ("prune_threshold", "log", 1e-3, 0.20),
                   _F0],
    "dp_cluster": [("k_max", "int", 3, 15), ("nu", "log", 0.01, 2.0), ("zeta", "log", 0.1, 5.0), ("eta", "log", 0.1, 5.0),
                   _F0, _PRUNE],
    "py": [("k_max", "int", 3, 15), *_PY, _F0, _PRUNE],
    "mfm": [("k_max", "int", 3, 15), ("delta", "log", 0.1, 5.0), ("gamma", "log", 0.1, 5.0), _F0, _PRUNE],
    "nig": [("k_max", "int", 3, 15), ("sigma", "uniform", 0.1, 0.9), ("alpha", "log", 0.1, 5.0), _F0, _PRUNE],
    "py_moves": [("k_max", "int", 5, 20), ("d", "uniform", 0.0, 0.9), ("theta", "log", 0.1, 10.0), _F0, _PRUNE],
    "mfm_moves": [("k_max", "int", 5, 20), ("delta", "log", 0.1, 5.0), ("gamma", "log", 0.5, 10.0), _F0],
    "nig_moves": [("k_max", "int", 5, 20), ("sigma", "uniform", 0.1, 0.9), ("alpha", "log", 0.1, 10.0), _F0,
                  ("repulsion", "log", 0.01, 2.0)],
    "ssl": [*_SSL, ("init_xi", "uniform", 0.01, 0.5), _PRUNE],
    "ssl_excess": [*_SSL, ("xi_ema", "uniform", 0.01, 0.5), _PRUNE],
}


def search_spaces(spark: SparkSession) -> DataFrame:
    """All default ranges: ``model, param, kind, lo, hi``."""
    rows = [(m, p, kind, float(lo), float(hi)) for m, ranges in SPACES.items() for p, kind, lo, hi in ranges]
    return spark.createDataFrame(rows, "model string, param string, kind string, lo double, hi double")


def sample_configs(spark: SparkSession, model: str, n: int, seed: int = 42, space: dict | None = None) -> DataFrame:
    """``n`` random configurations: ``trial_id, seed`` and one column per parameter.

    ``space`` overrides ranges by parameter; None fixes a parameter at its default.
    """
    ranges = {p: (kind, lo, hi) for p, kind, lo, hi in SPACES[model]}
    for p, bounds in (space or {}).items():
        if bounds is None:
            ranges.pop(p)
        else:
            ranges[p] = (ranges[p][0], *bounds)
    out = ["cast(id as int) as trial_id", f"cast({hash_uniform('id', seed=seed * 31 + 7)} * 2147483647 as bigint) as seed"]
    for i, (p, (kind, lo, hi)) in enumerate(sorted(ranges.items())):
        u = hash_uniform("id", str(i), seed=seed)
        if kind == "int":
            out.append(f"cast({int(lo)} + floor({u} * {int(hi) - int(lo) + 1}) as int) as {p}")
        elif kind == "log":
            out.append(f"exp(ln({num(lo)}) + {u} * (ln({num(hi)}) - ln({num(lo)}))) as {p}")
        else:
            out.append(f"{num(lo)} + {u} * {num(hi - lo)} as {p}")
    rows = spark.range(n).selectExpr(*out)
    if "theta" in ranges and "d" in ranges:
        rows = rows.withColumn("theta", F.expr("greatest(theta, -d + 1e-6D)"))
    if "l0" in ranges and "l1" in ranges:
        rows = rows.selectExpr(*[c for c in rows.columns if c not in ("l0", "l1")],
                               "greatest(l0, l1) as l0", "least(l0, l1) as l1")
    return rows


TRIALS = ("trial_id int, seed_no int, config string, seed bigint, ari double, nmi double, proxy double, "
          "plogp double, objective double, k_est int, elapsed double, error string")


@dataclass
class Scores:
    ari: float | None = None
    nmi: float | None = None
    proxy: float | None = None
    plogp: float | None = None
    objective: float | None = None
    k_est: int = -1
    elapsed: float = 0.0
    error: str | None = None


def isolated(job: Callable[[list[int]], dict], ids: list[int]) -> tuple[dict, dict[int, str]]:
    """Results of ``job`` on all ids, and the errors of those it fails on even alone.

    A job that fails is run again on each half of its ids, so one bad id costs the others a few more jobs.
    """
    if not ids:
        return {}, {}
    try:
        return job(ids), {}
    except Exception as e:  # whatever ends the job is the reason on record
        if len(ids) == 1:
            return {}, {ids[0]: f"{type(e).__name__}: {e}"[:2000]}
    half = len(ids) // 2
    found, errors = isolated(job, ids[:half])
    more, further = isolated(job, ids[half:])
    return found | more, errors | further


def _fit_and_score(data: CountData, spec: Spec | None, params: dict[int, dict], seeds: dict[int, int],
                   labels: DataFrame | None, init, n_init: int) -> dict[int, Scores]:
    """One multi-model job (``spec`` None: mini-batches) and the scores of its models."""
    started, failed = time.time(), {}
    if spec is None:
        starts = [Start(i, p["k_max"], seeds[i]) for i, p in params.items()]
        resp = starting_memberships(data, starts, init, n_init, 100)
        fitted = fit_stochastic(data, params, resp, seed=min(seeds.values()))
        predicted, objective = predict_stochastic(fitted), {i: None for i in fitted.models}
        width, resp = fitted.width, fitted.resp
    else:
        fitted = fit_models(data, spec, params, seeds, init, n_init)
        failed = fitted.failed
        predicted, objective = report.predict(fitted), {i: m.elbo for i, m in fitted.models.items()}
        width, resp = fitted.state.width, fitted.state.resp
    out = {i: Scores(error=failed.get(i)) for i in params}
    for i, m in fitted.models.items():
        out[i].k_est, out[i].objective = m.k, (m.history[-1][1] if m.history else objective[i])
    if labels is not None:
        pairs = data.ws.put(
            predicted.join(labels.selectExpr("sample_id", "label as truth"), "sample_id")
            .groupBy("model_id", F.col("truth").alias("a"), F.col("label").alias("b")).agg(F.count("*").alias("n")),
            "pairs")
        for r in mt.ari_from_contingency(pairs, ["model_id"]).collect():
            out[r[0]].ari = r[1]
        for r in mt.nmi_from_contingency(pairs, ["model_id"]).collect():
            out[r[0]].nmi = r[1]
        data.ws.release(pairs)
    for r in mt.quality_proxy(resp, width).collect():
        out[r["model_id"]].proxy = r["quality"]
    for i, v in report_plogp(resp, width).items():
        out[i].plogp = v
    work = {i: max(1, fitted.models[i].n_iter if i in fitted.models else 1) * p["k_max"] for i, p in params.items()}
    seconds = time.time() - started
    for i in out:
        out[i].elapsed = seconds * work[i] / sum(work.values())
    return out


def run_trials(data: CountData, configs: DataFrame, model: str, labels: DataFrame | None = None, n_seeds: int = 1,
               init="kmeans", n_init: int = 10, per_sample: bool = False, **fixed) -> DataFrame:
    """Fit every configuration (times seeds) as one multi-model job and score it.

    With ``labels(sample_id, label)`` the score is agreement, else the label-free quality
    proxy. A configuration that is invalid, leaves the finite numbers or ends its job gets -1 and the reason;
    the others are fitted without it. ``elapsed`` is a trial's part of its job's seconds, by rounds times groups.
    """
    spark = data.spark
    rows = [r.asDict() for r in configs.collect()]  # one row per trial
    todo, errors, meta = {}, {}, {}
    spec = None if model == "stochastic" else FITS[model]
    if spec is not None and spec.selection == "sample" and not spec.moves:
        spec = spec.per_sample(per_sample)
    for r in rows:
        config = {k: v for k, v in r.items() if k not in ("trial_id", "seed")}
        for s in range(n_seeds):
            i = r["trial_id"] * n_seeds + s
            meta[i] = (r["trial_id"], s, json.dumps(config), int((r["seed"] + s * 997) % (2**31 - 1)))
            try:
                given = {**fixed, **config}
                todo[i] = stochastic_params(**given) if spec is None else spec.params(**given)
            except ValueError as e:
                errors[i] = str(e)

    def fit_and_score(ids: list[int]) -> dict[int, Scores]:
        params, seeds = {i: todo[i] for i in ids}, {i: meta[i][3] for i in ids}
        return _fit_and_score(data, spec, params, seeds, labels, init, n_init)

    scores, failed = isolated(fit_and_score, sorted(todo))
    errors.update(failed)
    errors.update({i: s.error for i, s in scores.items() if s.error})
    out = []
    for i, (trial, s, config, seed) in meta.items():
        got = scores.get(i, Scores())
        if i in errors:
            out.append((trial, s, config, seed, -1.0, -1.0, -1.0, None, None, -1, got.elapsed, errors[i]))
        else:
            out.append((trial, s, config, seed, got.ari, got.nmi, got.proxy, got.plogp, got.objective, got.k_est, got.elapsed, None))
    columns = [c.strip().split(" ")[0] for c in TRIALS.split(",")]
    return spark.createDataFrame(pd.DataFrame(out, columns=columns).astype(object).where(lambda d: d.notna(), None), TRIALS)


def report_plogp(resp: DataFrame, width: int) -> dict[int, float]:
    from tallymix.operators.objective import membership_parts

    return {r["model_id"]: r["plogp"] for r in membership_parts(resp, width).collect()}


def rank_trials(trials: DataFrame, k: int | None = None, by: tuple[str, ...] = ("ari", "nmi")) -> DataFrame:
    """Trials by score, best first, with their rank; ``k`` keeps the top (always set it for long trial tables)."""
    order = [F.desc(c) for c in by] + [F.asc("trial_id")]
    if k is not None:
        trials = trials.orderBy(*order).limit(k)
    # the window sees one row per trial
    return trials.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def seed_average(trials: DataFrame, score: str = "ari") -> DataFrame:
    """Mean score and mean number of groups over the seeds of each configuration."""
    return trials.groupBy("trial_id").agg(
        F.avg(score).alias("mean_score"), F.avg("k_est").alias("mean_k"), F.count("*").alias("n_seeds")
    )


def running_best(trials: DataFrame, score: str = "ari", block: int = 10_000) -> DataFrame:
    """Best score so far in trial order, whether the trial is a new best, and by how much.

    Trials are scanned in blocks of ids: the best of all earlier blocks comes from one
    row per block, the best inside the block from a window over the block.
    """
    cut = trials.withColumn("_block", F.expr(f"trial_id div {block}"))
    inside = "max({0}) over (partition by _block order by trial_id rows between unbounded preceding and 1 preceding)"
    tops = cut.groupBy("_block").agg(F.max(score).alias("_top"))
    earlier = tops.selectExpr(
        "_block", "max(_top) over (order by _block rows between unbounded preceding and 1 preceding) as _earlier")
    staged = cut.withColumn("_inside", F.expr(inside.format(score))).join(earlier, "_block")
    staged = staged.withColumn("best_before", F.expr("greatest(_inside, _earlier)"))
    return staged.selectExpr(
        *trials.columns, "best_before", f"greatest(best_before, {score}) as best",
        f"best_before is null or {score} > best_before as is_best", f"{score} - best_before as delta",
    )


# How refits of each model are compared.
REFIT_BY = {"dp_cluster": ("ari", "objective"), "mfm_moves": ("ari", "plogp"), "nig_moves": ("ari", "plogp")}


def refit_best(data: CountData, model: str, config: dict, seed: int, labels: DataFrame | None = None, n_restarts: int = 5,
               cap_prune: bool = False, **fixed) -> DataFrame:
    """The best configuration again with its own seed and further ones; all runs, best first.

    ``cap_prune`` holds the pruning threshold at 0.1 where the model has one.
    """
    config = dict(config)
    if cap_prune and "prune_threshold" in config:
        config["prune_threshold"] = min(config["prune_threshold"], 0.1)
    spark = data.spark
    row = pd.DataFrame([{"trial_id": 0, "seed": int(seed), **config}])
    runs = run_trials(data, spark.createDataFrame(row), model, labels, n_seeds=n_restarts, **fixed)
    by = REFIT_BY.get(model, ("ari", "nmi")) if labels is not None else ("proxy", "objective")
    return rank_trials(runs.withColumn("trial_id", F.col("seed_no")), by=by)


@dataclass
class SearchResult:
    best_config: dict
    best: dict
    trials: DataFrame
    averages: DataFrame
    history: DataFrame
    refits: DataFrame | None = None


def search(data: CountData, model: str, n_trials: int = 30, seed: int = 42, labels: DataFrame | None = None,
           n_seeds: int = 1, space: dict | None = None, refit: int = 0, init="kmeans", n_init: int = 10, **fixed) -> SearchResult:
    """Draw configurations, fit them all in shared jobs, average seeds, rank, refit the best."""
    configs = sample_configs(data.spark, model, n_trials, seed, space)
    trials = data.ws.put(run_trials(data, configs, model, labels, n_seeds, init, n_init, **fixed), "trials")
    score = "ari" if labels is not None else "proxy"
    averages = seed_average(trials, score)
    top = rank_trials(
        trials.where("seed_no = 0").drop(score).join(averages.withColumnRenamed("mean_score", score), "trial_id"), 1,
        (score, "nmi") if labels is not None else (score,),
    ).first().asDict()
    history = running_best(averages.withColumnRenamed("mean_score", score), score)
    config = json.loads(top["config"])
    refits = refit_best(data, model, config, top["seed"], labels, refit, init=init, n_init=n_init, **fixed) if refit else None
    return SearchResult(config, top, trials, averages, history, refits)
