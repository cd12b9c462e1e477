"""Mini-batch fit, stream, first-order model, search."""

import math
from dataclasses import replace

import numpy as np
import pytest
from dense import lgam, psi
from pyspark.sql import functions as F

from planted import as_counts, as_labels, planted
from tallymix.functions.special import digamma_value, hash_uniform, hash_uniform_value
from tallymix.operators import metrics as mt
from tallymix.operators import prep
from tallymix.operators.cells import prepare
from tallymix.operators.initial import Start, init_from_labels, init_random
from tallymix.plans import base, search, stochastic
from tallymix.plans.fit import fit
from tallymix.streaming import stream
from tallymix.workspace import Workspace


def test_one_batch_step_matches_dense(spark, sliced):
    x, _, data = sliced
    n, s = x.shape
    labels = np.arange(n) % 3
    p = stochastic.stochastic_params(k_max=3, concentration=0.05)
    fitted = stochastic.start_batch_fit(data, {0: p}, init_from_labels(as_labels(spark, labels), 3))
    params, models = stochastic.batch_step(data, fitted.params, fitted.models, 2.0 * n, 4)

    r0 = np.eye(3)[labels]
    mean = r0.T @ x / (r0.sum(0)[:, None] + 1e-10)
    lam = np.maximum(mean / (mean.sum(1, keepdims=True) + 1e-10) * 100 + 1, 1)
    iota = x.mean(0) / (x.mean(0).sum() + 1e-10) * 100 + 1
    al, be, phi = lam / lam.sum(1, keepdims=True), iota / iota.sum(), np.full((3, s), 0.5)
    eff = np.maximum(phi * al + (1 - phi) * be, 1e-10)
    rho, tau = np.full(3, 3.0), np.full(3, 0.5)
    take = np.clip(psi(rho) - psi(rho + tau), -20, 0)
    leave = np.clip(psi(tau) - psi(rho + tau), -20, 0)
    ll = np.stack([lgam(e.sum()) - lgam(x.sum(1) + e.sum()) + (lgam(x + e) - lgam(e)).sum(1) for e in eff], 1)
    z = ll + take + np.concatenate([[0], leave.cumsum()[:-1]])
    r = np.exp(z - z.max(1, keepdims=True))
    r /= r.sum(1, keepdims=True)
    step, scale, mass = 14 ** -0.7, 2.0, r.sum(0)
    half = step / 2  # more groups wanted
    rho = np.maximum((1 - half) * rho + half * (1 + scale * mass), 0.5)
    after = mass[::-1].cumsum()[::-1] - mass
    tau = np.maximum((1 - half) * tau + half * (0.5 + scale * after), 0.1)
    gain = np.stack([phi[k] * (r[:, k:k + 1] * (psi(x + al[k]) - psi(al[k]))).sum(0) * scale for k in range(3)])
    lam2 = np.where(mass[:, None] < 0.1, lam, np.maximum((1 - step) * lam + step * (1 + gain), 1))
    push = (1 - phi.max(0)) * (psi(x + be) - psi(be)).mean(0) * 2 * n
    iota2 = np.maximum((1 - step) * iota + step * (1 + push), 1)
    al, be = lam2 / lam2.sum(1, keepdims=True), iota2 / iota2.sum()
    yes = scale * np.stack([(r[:, k:k + 1] * (lgam(x + al[k]) - lgam(al[k]))).sum(0) for k in range(3)]) + math.log(0.3)
    no = scale * np.stack([(r[:, k:k + 1] * (lgam(x + be) - lgam(be))).sum(0) for k in range(3)]) + math.log(0.7)
    top = np.maximum(yes, no)
    fresh = np.exp(yes - top) / (np.exp(yes - top) + np.exp(no - top) + 1e-10)
    phi2 = np.where(mass[:, None] < 0.1, phi, (1 - step) * phi + step * fresh)

    rows = {q["feature_id"]: q for q in params.collect()}
    names = [f"f{j:03d}" for j in range(s)]
    np.testing.assert_allclose(np.array([rows[f]["lam"] for f in names]).T, lam2, rtol=1e-7)
    np.testing.assert_allclose([rows[f]["iota"] for f in names], iota2, rtol=1e-7)
    np.testing.assert_allclose(np.array([rows[f]["phi"] for f in names]).T, phi2, atol=1e-7)
    np.testing.assert_allclose(models[0].rho, rho, rtol=1e-7)
    np.testing.assert_allclose(models[0].tau, tau, rtol=1e-7)


def test_stochastic_fit_and_merge(spark, small):
    x, labels, data = small
    p = stochastic.stochastic_params(k_max=4, max_iter=3, batch_size=30, burn_in=1, min_clusters=2)
    fitted = stochastic.fit_stochastic(data, {0: p}, init_from_labels(as_labels(spark, np.where(np.arange(60) % 2, labels, 3)), 4))
    assert 2 <= fitted.models[0].k <= 4
    got = stochastic.predict_stochastic(fitted).select("sample_id", "label")
    assert got.count() == len(x)


def test_a_batch_reads_its_own_files(spark):
    """200 samples, one of them hot, batches of 20: a step reads at most two of the ten folders, wrapping included."""
    x, _ = planted(n=200, s=30, draws=60)
    x[17] += 5
    x[23] = 0
    samples = spark.range(200).withColumnRenamed("id", "sample_id")
    data = prepare(as_counts(spark, x), Workspace(spark), samples=samples, slice_rows=25)
    order = stochastic.lay_out_batches(data, 20, 3)
    assert order.samples.count() == 200 and order.cells.count() == np.count_nonzero(x) and "s_slice" in order.cells.columns
    for t in range(1, 15):
        batch = order.batch(t)
        own = {r["sample_id"] for r in batch.samples.collect()}
        assert batch.n_samples == len(own) == 20
        got = batch.cells.groupBy("sample_id").agg(F.count("*"), F.sum("x")).collect()
        assert {r[0]: (r[1], r[2]) for r in got} == {i: (np.count_nonzero(x[i]), x[i].sum()) for i in own if x[i].any()}
        folders = {p.split("stretch=")[1].split("/")[0] for (p,) in
                   batch.cells.select(F.input_file_name()).distinct().collect()}
        scan = batch.cells._jdf.queryExecution().executedPlan().toString()
        pushed = scan.split("PartitionFilters: [")[1].split("]")[0], scan.split("PushedFilters: [")[1].split("]")[0]
        assert len(folders) <= 3 and "stretch" in pushed[0] and "place" in pushed[1]
        assert (23 in own) == (23 in {r["sample_id"] for r in batch.empty_samples.collect()})


def test_draws_are_those_of_the_driver(spark):
    rows = spark.range(300).selectExpr("id", f"{hash_uniform('id', 'id % 7', seed=4)} as u").collect()
    assert all(r["u"] == hash_uniform_value(r["id"], r["id"] % 7, seed=4) for r in rows)
    assert 0.45 < np.mean([r["u"] for r in rows]) < 0.55


def test_merge_weighted_averages_and_respects_the_floor(spark, small):
    _, _, data = small
    p = stochastic.stochastic_params(k_max=3, min_clusters=2)
    m = stochastic.BatchModel(0, p, 3, [2.0, 3.0, 4.0], [1.0, 1.0, 1.0])
    rows = [(0, "f000", [10.0, 10.0, 1.0], 1.0, [0.2, 0.4, 0.9]), (0, "f001", [1.0, 1.5, 10.0], 1.0, [0.5, 0.5, 0.1])]
    params = spark.createDataFrame(rows, "model_id int, feature_id string, lam array<double>, iota double, phi array<double>")
    w = m.weights
    out = stochastic.merge_weighted(stochastic.BatchFit(data, {0: m}, params))
    got = {r["feature_id"]: r for r in out.params.collect()}
    share = w[0] / (w[0] + w[1])
    assert out.models[0].k == 2 and out.models[0].rho == [2.0, 4.0]
    assert got["f001"]["lam"] == pytest.approx([share * 1.0 + (1 - share) * 1.5, 10.0])
    assert got["f000"]["phi"] == pytest.approx([share * 0.2 + (1 - share) * 0.4, 0.9])
    assert stochastic.merge_weighted(out).models[0].k == 2


def test_stream_replay_changes_nothing(spark, tmp_path):
    x, _ = planted(n=30, s=9, draws=50)
    files, state = str(tmp_path / "in"), str(tmp_path / "state")
    counts = as_counts(spark, x)
    counts.where("sample_id < 15").coalesce(1).write.parquet(files)
    counts.where("sample_id >= 15 and feature_id < 'f007'").coalesce(1).write.mode("append").parquet(files)
    p = stochastic.stochastic_params(k_max=2)
    source = spark.readStream.schema(counts.schema).option("maxFilesPerTrigger", 1).parquet(files)
    stream.fit_stream(source, state, p, str(tmp_path / "cp")).awaitTermination()
    last = stream.latest_before(spark, state, 1000)
    assert last == 1
    params, models, counters = stream.load_state(spark, state, last)
    assert counters == {"steps": 2, "samples": 30} and params.count() == 9
    before = params.orderBy("feature_id").collect()
    assert not stream.update_from_batch(counts, last, state, p)  # the same batch id once more
    again, _, _ = stream.load_state(spark, state, last)
    assert again.orderBy("feature_id").collect() == before
    new = spark.createDataFrame([(99, "unseen", 3.0)], counts.schema)
    assert stream.update_from_batch(new, 2, state, p)
    grown, _, counters = stream.load_state(spark, state, 2)
    assert grown.count() == 10 and counters["samples"] == 31


def _dense_base(x, labels, k, rounds, sel):
    """The first-order model on whole matrices, from a given first selection; ends with one more expectation."""
    n, s = x.shape
    r, g, i = np.eye(k)[labels], np.ones((k, s)), np.ones(s)
    total = x.sum(1)
    d = psi(1.0) - psi(total + 1)

    def expectation():
        mass = r.sum(0) + 10 * np.finfo(float).eps
        a, b = 1 + mass, 1.0 / k + mass[::-1].cumsum()[::-1] - mass
        xi1, xi2 = 1 + sel.sum(0), 1 + (1 - sel).sum(0)
        m = g / g.sum(1, keepdims=True)
        slope = m * (psi(g) - psi(g.sum(1, keepdims=True)) - np.log(m))
        mb = i / i.sum()
        sb = mb * (psi(i) - psi(i.sum()) - np.log(mb))
        whole = psi(a + b)
        lp = psi(a) - whole + np.concatenate([[0], (psi(b) - whole).cumsum()[:-1]])
        z, yes = np.zeros((n, k)), np.zeros((n, s))
        for c in range(k):
            part = d[:, None] * slope[c] + lgam(x + m[c]) - lgam(m[c]) + slope[c] * (psi(x + m[c]) - psi(m[c]))
            z[:, c] = (sel * part).sum(1) - sel.sum(1) * lgam(total + 1) + lp[c]
            yes += r[:, c:c + 1] * part
        yes += psi(xi1) - psi(xi1 + xi2)
        no = d[:, None] * sb + lgam(x + mb) - lgam(mb) + sb * (psi(x + mb) - psi(mb)) + psi(xi2) - psi(xi1 + xi2)
        fresh = (np.exp(yes) + 1e-6) / (np.exp(yes) + np.exp(no) + 1e-6)
        top = z.max(1, keepdims=True)
        norm = np.exp(z - top).sum(1, keepdims=True)
        return np.exp(z - top) / norm, fresh, (top + np.log(norm))[:, 0], m, mb

    for _ in range(rounds):
        r, sel, _, m, mb = expectation()
        g = np.maximum(1 + np.stack([m[c] * (r[:, c:c + 1] * sel * (d[:, None] + psi(x + m[c]) - psi(m[c]))).sum(0) for c in range(k)]), 1e-10)
        i = np.maximum(1 + mb * ((1 - sel) * (d[:, None] + psi(x + mb) - psi(mb))).sum(0), 1e-10)
    last, final, log_norm, _, _ = expectation()
    return last, final, g, i, log_norm


def _matrix(rows, n, s):
    out = np.full((n, s), np.nan)
    for row in rows:
        out[row["sample_id"], int(row["feature_id"][1:])] = row["selection"]
    return out


@pytest.mark.parametrize("tile", [(256, 4096), (16, 8)])
def test_base_model_matches_dense(spark, sliced, tile):
    x, _, data = sliced
    n, s = x.shape
    labels = np.arange(n) % 3
    tiles = base.make_tiles(data, *tile)
    first = _matrix(base.start_selection(data, tiles, [0], 7).collect(), n, s)
    fitted = base.fit_base(data, 3, max_iter=2, init=as_labels(spark, labels), seed=7, tiles=tiles)
    r, want, g, i, log_norm = _dense_base(x, labels, 3, 2, first)
    rows = {q["feature_id"]: q for q in fitted.params.collect()}
    names = [f"f{j:03d}" for j in range(s)]
    np.testing.assert_allclose([rows[f]["iota"] for f in names], i, rtol=1e-6)
    np.testing.assert_allclose(np.array([rows[f]["gamma"] for f in names]).T, g, rtol=1e-6)
    means = {q["feature_id"]: q["selection"] for q in base.mean_selection(fitted).collect()}
    np.testing.assert_allclose([means[f] for f in names], want.mean(0), atol=1e-8)
    np.testing.assert_allclose(_matrix(base.cell_selection(fitted).collect(), n, s), want, atol=1e-8)
    resp = {q["sample_id"]: q for q in fitted.resp.collect()}
    np.testing.assert_allclose([resp[v]["r"] for v in range(n)], r, atol=1e-8)
    np.testing.assert_allclose([resp[v]["log_norm"] for v in range(n)], log_norm, rtol=1e-8)
    assert fitted.models[0].log_norm == pytest.approx(log_norm.mean(), rel=1e-8) and fitted.models[0].n_iter == 2


def test_tiles_hold_every_cell_once_and_keep_their_place(spark, sliced):
    x, _, data = sliced
    tiles = base.make_tiles(data, 16, 8)
    cells = base.cells_of(tiles).withColumnRenamed("x", "selection").collect()
    assert len(cells) == x.size and (_matrix(cells, *x.shape) == x).all()
    state = base._first_state(tiles, data.samples.selectExpr("0 as model_id", "sample_id", "array(1D) as r"), 1)
    rows = base._tile_rows(data, tiles, state.hint("shuffle_hash"), base._first_blocks(tiles, 1), 2, 1)
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert "Bucketed: true" in plan


def test_memberships_of_tiles_are_never_broadcast(spark, sliced):
    """They grow with the samples, so the driver doesn't carry them, however small a file they make."""
    _, _, data = sliced
    tiles = base.make_tiles(data, 16, 8)
    resp = data.samples.selectExpr("cast(0 as int) as model_id", "sample_id", "array(0.5D, 0.5D) as r")
    state = data.ws.put(base._first_state(tiles, resp, 1), "chunks")
    rows = base._tile_rows(data, tiles, state, base._first_blocks(tiles, 1), 2, 1)
    joins = [j for j in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in j and "[chunk#" in j]
    assert joins and not any("Broadcast" in j for j in joins)
    assert rows.count() == tiles.chunks * tiles.blocks


def test_a_round_over_one_block_is_one_pass(spark, small, monkeypatch, tmp_path):
    """One table a round instead of two and two readings; the same numbers as the two steps over blocks."""
    _, _, data = small
    tiles, names, put = base.make_tiles(data), [], Workspace.put
    init = init_random(data.samples, [Start(0, 3, 1), Start(1, 3, 2)])
    monkeypatch.setattr(Workspace, "put", lambda self, df, name, **k: names.append(name) or put(self, df, name, **k))
    fits, kept = [], []
    for bound in (data.broadcast_bytes, 0):
        path = str(tmp_path / f"history-{bound}")
        fits.append(base.fit_base(replace(data, broadcast_bytes=bound), 3, 4, init, n_init=2, tiles=tiles,
                                  history_path=path, history_every=2))
        kept.append([sorted(map(tuple, spark.read.parquet(f"{path}/cell_selection").select(
            "iter", "model_id", "sample_id", "feature_id", "f").collect())),
            sorted(map(tuple, spark.read.parquet(f"{path}/resp").selectExpr(
                "iter", "model_id", "sample_id", "r[0]", "r[1]", "r[2]").collect()))])
        assert names.count("round") == 4 and names.count("chunks") == (2 if bound else 8)
    for one, two in zip(*kept):
        assert len(one) == len(two) > 0
        for a, b in zip(one, two):
            assert a[:3] == b[:3] and a[-1] == pytest.approx(b[-1], rel=1e-6, abs=1e-9)
    columns = [f.params.columns for f in fits]
    assert columns[0] == columns[1]
    for a, b in zip(*(sorted(f.params.collect()) for f in fits)):
        assert a[:4] == b[:4] and np.hstack(a[4:]) == pytest.approx(np.hstack(b[4:]), rel=1e-6, abs=1e-9)
    for a, b in zip(*(sorted(f.resp.collect()) for f in fits)):
        assert a[:2] == b[:2] and np.hstack(a[2:]) == pytest.approx(np.hstack(b[2:]), rel=1e-6, abs=1e-9)
    for i, m in fits[0].models.items():
        other = fits[1].models[i]
        assert m.log_norm == pytest.approx(other.log_norm) and m.a == pytest.approx(other.a) and m.n_iter == other.n_iter == 4


def test_one_pass_fits_also_run_where_frames_are_made_without_arrow(spark, small, tmp_path):
    _, labels, data = small
    path, name = str(tmp_path / "history"), "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        fitted = base.fit_base(data, 3, 2, as_labels(spark, labels), history_path=path, history_every=2)
        assert fitted.resp.count() == data.n_samples and spark.read.parquet(f"{path}/cell_selection").count() > 0
        assert fit(data, "dp", init=as_labels(spark, labels), k_max=3, max_iter=2).state.resp.count() == data.n_samples
    finally:
        spark.conf.set(name, before)


def test_base_entry_keeps_the_best_start_and_a_history(spark, small, tmp_path):
    x, labels, data = small
    path = str(tmp_path / "history")
    best = fit(data, "base", init=as_labels(spark, labels), n_restarts=3, k=3, max_iter=2, history_every=1, history_path=path)
    every = base.fit_base(data, 3, 2, as_labels(spark, labels), n_init=3)
    norms = {i: m.log_norm for i, m in every.models.items()}
    (i, m), = best.models.items()
    assert len(set(norms.values())) == 3 and norms[i] == max(norms.values()) and m.log_norm == norms[i]
    assert {r["model_id"] for r in best.resp.select("model_id").distinct().collect()} == {i}
    cells = spark.read.parquet(f"{path}/cell_selection").groupBy("iter", "model_id").count().collect()
    assert {r["iter"] for r in cells} == {1, 2} and {r["count"] for r in cells} == {x.size}
    assert spark.read.parquet(f"{path}/resp").count() == 2 * 3 * len(x)
    with pytest.raises(ValueError):
        fit(data, "base", per_sample=True)


def test_stochastic_entry_keeps_one_of_its_restarts(spark, small):
    x, labels, data = small
    out = fit(data, "stochastic", init="random", n_restarts=2, k_max=3, max_iter=2, batch_size=20)
    assert len(out.models) == 1 and out.resp.count() == len(x)
    assert {r["model_id"] for r in out.params.select("model_id").distinct().collect()} == set(out.models)
    with pytest.raises(ValueError):
        fit(data, "stochastic", history_path="unused")


def test_a_failing_trial_leaves_the_others_alone(spark, small, monkeypatch):
    _, labels, data = small
    truth = as_labels(spark, labels)
    real = search.fit_models

    def breaks(data, spec, params, seeds, *rest):
        if any(p["nu"] > 1 for p in params.values()):
            raise RuntimeError("lost")
        return real(data, spec, params, seeds, *rest)

    monkeypatch.setattr(search, "fit_models", breaks)
    configs = spark.createDataFrame([(0, 5, 3, 0.5), (1, 6, 3, 1.5), (2, 7, 3, 0.2)], "trial_id int, seed bigint, k_max int, nu double")
    runs = {r["trial_id"]: r for r in search.run_trials(data, configs, "dp", truth, init=truth, max_iter=2).collect()}
    assert runs[1]["ari"] == -1.0 and runs[1]["error"] == "RuntimeError: lost" and runs[1]["k_est"] == -1
    assert all(runs[i]["error"] is None and runs[i]["ari"] > 0.9 and runs[i]["elapsed"] > 0 for i in (0, 2))


def test_isolated_asks_each_failing_id_alone():
    asked = []

    def job(ids):
        asked.append(tuple(ids))
        if {3, 6} & set(ids):
            raise ValueError("bad")
        return {i: i * i for i in ids}

    found, errors = search.isolated(job, list(range(8)))
    assert found == {i: i * i for i in range(8) if i not in (3, 6)} and set(errors) == {3, 6} and (3,) in asked
    assert search.isolated(job, []) == ({}, {})


def test_sampled_configurations_stay_in_range(spark):
    rows = search.sample_configs(spark, "py", 200, seed=3).collect()
    assert {r["k_max"] for r in rows} == set(range(3, 16)) and all(0 <= r["d"] < 0.8 and 0.05 <= r["theta"] <= 5 for r in rows)
    assert rows == search.sample_configs(spark, "py", 200, seed=3).collect()
    ssl = search.sample_configs(spark, "ssl", 50, space={"l0": (1.0, 5.0), "l1": (2.0, 9.0), "nu": None}).collect()
    assert all(r["l0"] >= r["l1"] for r in ssl) and "nu" not in ssl[0].asDict()
    assert search.search_spaces(spark).where("model = 'ssl_excess' and param = 'xi_ema'").count() == 1


def test_search_scores_trials_and_reports_invalid_ones(spark, small):
    _, labels, data = small
    truth = as_labels(spark, labels)
    rows = [(0, 11, 3, 0.1, 0.5), (1, 12, 4, 0.1, -0.5)]
    configs = spark.createDataFrame(rows, "trial_id int, seed bigint, k_max int, d double, theta double")
    runs = {(r["trial_id"], r["seed_no"]): r for r in
            search.run_trials(data, configs, "py", truth, n_seeds=2, init=truth, max_iter=3).collect()}
    assert len(runs) == 4 and runs[(0, 0)]["ari"] > 0.9 and runs[(0, 0)]["error"] is None
    assert runs[(1, 0)]["ari"] == -1.0 and "exceed" in runs[(1, 0)]["error"]
    out = search.search(data, "stochastic", 2, seed=1, labels=truth, space={"k_max": (2, 3)}, init="random", max_iter=2, batch_size=20)
    assert out.trials.count() == 2 and set(out.best_config) == {"k_max", "concentration", "prune_threshold", "f0"}
    assert out.history.where("is_best").count() >= 1


def test_running_best_over_blocks(spark):
    rows = [(i, float((i * 37) % 101)) for i in range(60)]
    trials = spark.createDataFrame(rows, "trial_id bigint, ari double")
    best = None
    for r in search.running_best(trials, block=7).orderBy("trial_id").collect():
        assert r["is_best"] == (best is None or r["ari"] > best) and r["best_before"] == best
        best = r["ari"] if best is None else max(best, r["ari"])
    assert search.rank_trials(trials.selectExpr("*", "ari as nmi"), 5).count() == 5


def test_agreement_with_known_pair_counts(spark):
    """Pair counts of published labelings and their adjusted Rand indices."""
    for counts, want in (
        ({(1, 1): 195, (2, 2): 192, (1, 2): 6}, 0.9397099308883915),
        ({(1, 1): 176, (2, 2): 171, (1, 2): 25, (2, 1): 21}, 0.5855511695222572),
        ({(1, 1): 164, (2, 2): 120, (1, 2): 35}, 0.6081055675611263),
    ):
        pairs = spark.createDataFrame([(a, b, n) for (a, b), n in counts.items()], "a int, b int, n bigint")
        assert mt.ari_from_contingency(pairs).first()[0] == pytest.approx(want, abs=1e-12)
    same = spark.createDataFrame([(1, 1, 9)], "a int, b int, n bigint")
    assert mt.ari_from_contingency(same).first()[0] == 1.0 and mt.nmi_from_contingency(same).first()[0] == 1.0


def test_silhouettes_against_brute_force(spark):
    x, labels = planted(n=40, s=12, draws=80)
    data = prepare(as_counts(spark, x), Workspace(spark), slice_rows=10)
    v = np.log1p(x)
    square = ((v[:, None] - v[None]) ** 2).sum(2)
    for dist, got in ((np.sqrt(square), mt.silhouette(data, as_labels(spark, labels), block=16)),
                      (square, mt.silhouette_squared(data, as_labels(spark, labels)))):
        scores = []
        for i, g in enumerate(labels):
            own = (labels == g) & (np.arange(len(x)) != i)
            a = dist[i, own].mean()
            b = min(dist[i, labels == h].mean() for h in set(labels) - {g})
            scores.append((b - a) / max(a, b))
        assert got.first()[0] == pytest.approx(np.mean(scores), abs=1e-9)


def test_silhouettes_of_empty_samples_and_of_one_group(spark):
    x, labels = planted(n=20, s=8, draws=40)
    x[3] = 0
    samples = spark.range(20).withColumnRenamed("id", "sample_id")
    data = prepare(as_counts(spark, x), Workspace(spark), samples=samples)
    v = np.log1p(x)
    dist = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    scores = []
    for i, g in enumerate(labels):
        a = dist[i, (labels == g) & (np.arange(20) != i)].mean()
        b = min(dist[i, labels == h].mean() for h in set(labels) - {g})
        scores.append((b - a) / max(a, b))
    assert mt.silhouette(data, as_labels(spark, labels), block=8).first()[0] == pytest.approx(np.mean(scores), abs=1e-9)
    one = as_labels(spark, np.zeros(20, int))
    assert mt.silhouette(data, one).first()[0] == 0.0 and mt.silhouette_squared(data, one).first()[0] == 0.0


def test_missing_counts_are_refused(spark):
    counts = spark.createDataFrame([(0, "a", 1.0), (1, "a", None)], "sample_id bigint, feature_id string, x double")
    with pytest.raises(ValueError):
        prepare(counts, Workspace(spark))


def test_projection_finds_the_principal_plane(spark):
    x, _ = planted(n=50, s=15, draws=200)
    data = prepare(as_counts(spark, x), Workspace(spark))
    v = np.log1p(x) - np.log1p(x).mean(0)
    u, sv, _ = np.linalg.svd(v, full_matrices=False)
    rows = mt.project_2d(data, iterations=12).orderBy("sample_id").collect()
    got = np.array([[r["pc1"], r["pc2"]] for r in rows])
    for c in range(2):
        assert abs(np.dot(got[:, c], u[:, c])) == pytest.approx(sv[c], rel=1e-3)


def test_digamma_twin():
    assert digamma_value(1.0) == pytest.approx(-0.5772156649015329)
