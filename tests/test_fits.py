"""Full fits on planted tables, restarts, moves, prediction, saving."""

import numpy as np
import pytest
from dense import Dense

from planted import as_counts, as_labels, planted
from tallymix.operators import metrics as mt
from tallymix.operators import report
from tallymix.operators.cells import prepare
from tallymix.operators.initial import Start, init_from_labels, init_kmeans, init_random, kmeans
from tallymix.plans import mixture as mx
from tallymix.plans import moves
from tallymix.plans.fit import fit
from tallymix.plans.specs import (
    FITS, linear_anneal, relative_changes, remap_concentration, step_size, two_phase_anneal,
)
from tallymix.sources import load_model, save_model
from tallymix.workspace import Workspace


def ari(spark, fitted, labels):
    predicted = report.predict(fitted).select("sample_id", "label")
    return mt.ari(predicted, as_labels(spark, labels)).first()[0]


def test_kmeans_finds_planted_groups(spark, small, sliced):
    for x, labels, data in (small, sliced):
        got = kmeans(data, [Start(0, 3, 5), Start(4, 2, 6)], n_init=3, max_iter=20)
        three = got.where("model_id = 0").select("sample_id", "label")
        assert three.count() == len(x)
        assert mt.ari(three, as_labels(spark, labels)).first()[0] > 0.95
        assert {r[0] for r in got.where("model_id = 4").select("label").distinct().collect()} == {0, 1}


def test_kmeans_members_only(spark, small):
    _, _, data = small
    members = data.samples.where("sample_id < 20").selectExpr("cast(2 as int) as model_id", "sample_id")
    got = kmeans(data, [Start(2, 2, 1)], n_init=2, max_iter=5, members=members)
    assert got.count() == 20 and {r[0] for r in got.select("model_id").distinct().collect()} == {2}


def test_random_start_is_repeatable(spark, small):
    _, _, data = small
    starts = [Start(0, 3, 1), Start(1, 4, 2)]
    a = init_random(data.samples, starts).orderBy("model_id", "sample_id").toPandas()
    b = init_random(data.samples, starts).orderBy("model_id", "sample_id").toPandas()
    assert all(np.array_equal(p, r) for p, r in zip(a["r"], b["r"]))
    assert all(abs(sum(r) - 1) < 1e-12 for r in a["r"]) and {len(r) for r in a["r"]} == {3, 4}


def test_fit_prunes_to_the_planted_groups(spark, small):
    x, labels, data = small
    fitted = fit(data, "dp", n_init=2, kmeans_iter=10, k_max=4, max_iter=12, seed=1)
    m = fitted.models[0]
    assert ari(spark, fitted, labels) > 0.6
    assert 2 <= m.k <= 4 and m.history and sum(m.mass) == pytest.approx(len(x))
    assert sum(fitted.weights(0)) <= 1.0 + 1e-9


def test_fit_follows_the_dense_loop(spark, small):
    """Sweeps and pruning over ten rounds, from the same labels."""
    x, _, data = small
    spec = FITS["nig"]
    labels = np.arange(len(x)) % 4
    fitted = fit(data, "nig", init=as_labels(spark, labels), k_max=4, max_iter=10, min_clusters=2)
    p = spec.params(k_max=4, min_clusters=2, max_iter=10)
    dense = Dense(x, spec, p, labels)
    for _ in range(10):
        dense.sweep()
    w = np.exp(dense.lp - dense.lp.max())
    keep = mx.kept_groups(list(w / w.sum()), list(dense.r.sum(0)), p["prune_threshold"], 1.0, 2)
    resp = {r["sample_id"]: r["r"] for r in fitted.state.resp.collect()}
    got = np.array([resp[i] for i in sorted(resp)])
    want = dense.r[:, keep] / dense.r[:, keep].sum(1, keepdims=True)
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_restarts_share_jobs_and_the_best_wins(spark, small):
    _, _, data = small
    spec = FITS["dp"]
    fitted = fit(data, "dp", init="random", n_restarts=3, k_max=4, max_iter=10)
    assert len(fitted.models) == 1
    all_three = mx.fit_conjugate(
        data, spec, init_random(data.samples, [Start(i, 4, 42 + 1000 * i) for i in range(3)]),
        {i: spec.params(k_max=4, max_iter=10) for i in range(3)})
    values = {i: m.history[-1][1] for i, m in all_three.models.items()}
    assert fitted.models[max(values, key=values.get)].history[-1][1] == pytest.approx(max(values.values()))


def test_excess_fit_freezes_its_baseline_and_averages(spark):
    x, labels = planted(n=45, s=30, own=6.0, rest=0.4, draws=300, seed=3)
    data = prepare(as_counts(spark, x), Workspace(spark))
    fitted = fit(data, "ssl_excess", init=as_labels(spark, labels), k_max=3, burn_in=2, max_iter=16, min_clusters=2)
    m = fitted.models[0]
    assert m.baseline is not None and m.xi_count == 16 - 12 + 1 and len(m.theta_window) == m.xi_count
    f = [r["f"] for r in fitted.state.params.select("f").collect()]
    assert min(f) >= 1e-10 and max(f) <= 1 - 1e-10


def test_broken_models_are_dropped(spark, small):
    _, _, data = small
    spec = FITS["dp"]
    params = {0: spec.params(k_max=3, max_iter=2), 1: spec.params(k_max=3, max_iter=2, nu=float("inf"))}
    starts = [Start(0, 3, 1), Start(1, 3, 2)]
    fitted = mx.fit_conjugate(data, spec, init_random(data.samples, starts), params)
    assert list(fitted.models) == [0] and 1 in fitted.failed


def _state(spark, data, name, labels, k, **given):
    spec = FITS[name]
    p = spec.params(k_max=given.pop("k_max", k), **given)
    resp = init_from_labels(as_labels(spark, labels), k)
    state = mx.start_state(data, spec, resp, {0: {**p, "k_max": k}})
    state.models[0].p = p
    return spec, mx.sweep(data, spec, state)


def test_merge_joins_a_group_that_was_cut_in_two(spark, small):
    x, labels, data = small
    cut = np.where((labels == 0) & (np.arange(len(x)) % 2 == 0), 3, labels)
    spec, state = _state(spark, data, "py_moves", cut, 4, min_clusters=2)
    pair = moves.merge_pairs(state, gated=False)[0]
    assert pair == (0, 3)
    proposal = moves.propose_merge(data, spec, state, gated=False)
    assert proposal.models[0].k == 3 and len(proposal.models[0].a) == 3
    rows = proposal.resp.collect()
    assert all(abs(sum(r["r"]) - 1) < 1e-9 and len(r["r"]) == 3 for r in rows)
    before = mx.full_objective(data, spec, state)[0]
    new, accepted = moves.try_move(data, spec, state, "merge")
    after = mx.full_objective(data, spec, new)[0]
    assert after >= before - 1e-6 and (new.models[0].k == 3) == (0 in accepted)


def test_split_and_delete_proposals(spark, small):
    x, labels, data = small
    merged = np.where(labels == 2, 1, labels)
    spec, state = _state(spark, data, "nig_moves", merged, 2, k_max=4, min_clusters=1)
    grown = moves.propose_split(data, spec, state, seed=1)
    assert grown.models[0].k == 3 and len(grown.models[0].a) == 3
    assert sum(grown.models[0].mass) == pytest.approx(len(x))
    spec, state = _state(spark, data, "mfm_moves", labels, 3, min_clusters=2)
    less = moves.propose_delete(data, spec, state)
    assert less.models[0].k == 2 and sum(less.models[0].mass) == pytest.approx(len(x))
    assert all(abs(sum(r["r"]) - 1) < 1e-9 for r in less.resp.collect())


def test_save_and_load(spark, small, tmp_path):
    _, labels, data = small
    fitted = fit(data, "py", init=as_labels(spark, labels), k_max=3, max_iter=2)
    save_model(fitted, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"), data)
    a = report.predict(fitted).orderBy("sample_id").collect()
    assert a == report.predict(back).orderBy("sample_id").collect()
    assert back.models[0].a == fitted.models[0].a
    assert report.selected_by_majority(back, 0.1).count() == report.selected_by_majority(fitted, 0.1).count()


def test_schedules():
    assert linear_anneal(1, 0.2, 1.0, 60) == 0.2 and linear_anneal(60, 0.2, 1.0, 60) == pytest.approx(1.0)
    assert linear_anneal(61, 0.2, 1.0, 60) == 1.0
    assert two_phase_anneal(0, 30.0, 1.0, 100, 200) == (30.0, 1.0)
    assert two_phase_anneal(150, 30.0, 1.0, 100, 200) == (pytest.approx(15.5), 0.0)
    assert two_phase_anneal(201, 30.0, 1.0, 100, 200) == (1.0, 0.0)
    assert step_size(1) == pytest.approx(11 ** -0.7)
    assert [remap_concentration(c) for c in (0.01, 0.5, 3.0)] == [(0.5, True), (1.0, True), (3.0, False)]
    assert relative_changes([1.0, 2.0, 2.0], 2) == [pytest.approx(0.5), 0.0]


def test_unknown_parameters_are_refused():
    with pytest.raises(ValueError):
        FITS["dp"].params(lambda0=3)
    with pytest.raises(ValueError):
        FITS["py"].params(d=0.2, theta=-0.5)


def test_kmeans_memberships_are_one_hot(spark, small):
    _, _, data = small
    rows = init_kmeans(data, [Start(0, 3, 1)], n_init=1, max_iter=3).collect()
    assert all(sorted(r["r"]) == [0.0, 0.0, 1.0] for r in rows)


def test_history_of_moves_is_refused():
    with pytest.raises(ValueError):
        fit(None, "py_moves", history_path="unused")


def test_selected_by_sample_covers_zero_cells(spark):
    x, labels = planted(n=20, s=12, draws=15)
    fitted = fit(as_counts(spark, x), "mfm", init=as_labels(spark, labels), k_max=3, max_iter=1)
    zero = fitted.models[0].zero_f
    rows = report.selected_by_sample(fitted, zero / 2).where("sample_id is null").collect()
    seen = x[:, x.sum(0) > 0]
    assert len(rows) == (seen == 0).any(0).sum() > 0 and all(r["probability"] == pytest.approx(zero) for r in rows)
    assert report.selected_by_sample(fitted, zero).where("sample_id is null").count() == 0
