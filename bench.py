"""Headline timings. Prints one JSON line; reads BENCH_SF_DIR and BENCH_CPUS."""

from __future__ import annotations

import json
import os
import time

from checks import data as cd
from tallymix.operators import metrics, prep, report
from tallymix.operators.cells import prepare
from tallymix.operators.initial import Start, init_from_labels, kmeans
from tallymix.plans.fit import fit
from tallymix.plans.mixture import start_state, sweep
from tallymix.plans.search import run_trials, sample_configs
from tallymix.plans.specs import FITS
from tallymix.session import local_session
from tallymix.workspace import Workspace

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = local_session(CPUS, "bench")
    ws, out = Workspace(spark), {}

    def timed(name, fn):
        started = time.time()
        result = fn()
        out[name] = round(time.time() - started, 3)
        return result

    tokens = timed("count_tokens", lambda: ws.put(prep.filter_features(cd.doc_token(spark, SF_DIR), 20), "tokens"))
    data = timed("lay_out_cells", lambda: prepare(tokens, ws))
    labels = cd.start_labels(data, 10)
    memberships = init_from_labels(labels, 10)
    for name in ("dp", "dp_cluster", "py", "ssl"):
        spec = FITS[name]
        state = timed(f"start_{name}", lambda: start_state(data, spec, memberships, {0: spec.params(k_max=10)}))
        state = sweep(data, spec, state)  # the first sweep compiles
        timed(f"sweep_{name}", lambda: sweep(data, spec, state))
    timed("kmeans_5_rounds", lambda: kmeans(data, [Start(0, 4, 1)], n_init=1, max_iter=5))
    timed("silhouette_squared", lambda: metrics.silhouette_squared(data, labels).collect())

    suppliers = timed("lay_out_suppliers", lambda: prepare(cd.supplier_brand(spark, SF_DIR), ws))
    fitted = timed("fit_dp_10_rounds", lambda: fit(suppliers, "dp", init="random", k_max=5, max_iter=10))
    timed("predict", lambda: report.predict(fitted).count())
    configs = sample_configs(spark, "dp", 8, seed=1, space={"k_max": (3, 6)})
    timed("search_8_trials", lambda: run_trials(suppliers, configs, "dp", init="random", max_iter=5).count())
    languages = cd.read(spark, SF_DIR, "documents").selectExpr("doc_id as sample_id", "lang as label")
    sources = cd.read(spark, SF_DIR, "documents").selectExpr("doc_id as sample_id", "source as label")
    timed("adjusted_rand", lambda: metrics.ari(languages, sources).collect())

    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": SF_DIR,
        "cells": data.nnz, "samples": data.n_samples, "features": data.n_features,
    }))


if __name__ == "__main__":
    main()
