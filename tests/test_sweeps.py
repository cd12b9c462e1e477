"""Sparse joins give what whole matrices give, with and without slicing and broadcasting."""

import copy

import numpy as np
import pytest
from dense import Dense, floored_softmax

from planted import as_counts, as_labels, planted
from tallymix.operators import likelihood as lk
from tallymix.operators import objective as ob
from tallymix.operators import packed as pk
from tallymix.operators.cells import prepare
from tallymix.operators.initial import init_from_labels
from tallymix.plans import mixture as mx
from tallymix.plans.specs import FITS
from tallymix.workspace import Workspace

NAMES = [f"f{j:03d}" for j in range(30)]


def matrix(rows, key, value, names=NAMES):
    table = {r[key]: r[value] for r in rows}
    return np.array([table[n] for n in names])


def check(state, dense, model_id=0):
    m = state.models[model_id]
    resp = {r["sample_id"]: r["r"] for r in state.resp.where(f"model_id = {model_id}").collect()}
    got = np.array([resp[i] for i in sorted(resp)])
    np.testing.assert_allclose(got, dense.r, atol=1e-7)
    rows = state.params.where(f"model_id = {model_id}").collect()
    np.testing.assert_allclose(matrix(rows, "feature_id", "lam").T, dense.lam, rtol=1e-7)
    np.testing.assert_allclose(matrix(rows, "feature_id", "iota"), dense.iota, rtol=1e-7)
    np.testing.assert_allclose(m.a, dense.a, rtol=1e-9)
    if dense.spec.selection == "sample":
        cells = {(r["sample_id"], r["feature_id"]): r["f"] for r in state.cells.where(f"model_id = {model_id}").collect()}
        for i, j in zip(*np.nonzero(dense.x)):
            assert cells[(i, NAMES[j])] == pytest.approx(dense.f[i, j], abs=1e-7)
        zero = dense.f[dense.x == 0]
        np.testing.assert_allclose(zero, m.zero_f, atol=1e-10)
    else:
        f = matrix(rows, "feature_id", "f")
        np.testing.assert_allclose(f.T if f.ndim == 2 else f, dense.f, atol=1e-7)


@pytest.mark.parametrize("layout", ["small", "sliced"])
@pytest.mark.parametrize("name", ["dp", "dp_cluster", "py", "mfm", "nig", "ssl", "ssl_excess"])
def test_three_sweeps(spark, request, layout, name):
    x, _, data = request.getfixturevalue(layout)
    if layout == "sliced" and name in ("mfm", "ssl"):
        pytest.skip("same joins as the fits next to it")
    spec = FITS[name]
    p = spec.params(k_max=4)
    labels = np.arange(len(x)) % 4
    dense = Dense(x, spec, p, labels)
    state = mx.start_state(data, spec, init_from_labels(as_labels(spark, labels), 4), {0: p})
    for t in range(3):
        gated = name != "ssl_excess" or t > 0
        state = mx.sweep(data, spec, state, gated=gated)
        dense.sweep(gated=gated)
        want = dense.fast()
        if spec.objective == "weights":
            want -= dense.weights_kl() + dense.selection_kl()
        if spec.objective == "fast":
            assert state.models[0].elbo == pytest.approx(want, rel=1e-8)
        elif spec.objective == "weights":
            assert state.models[0].elbo == pytest.approx(want, rel=1e-8)
    check(state, dense)


@pytest.mark.parametrize("name", ["py_moves", "mfm_moves", "nig_moves"])
def test_full_objective(spark, small, name):
    x, _, data = small
    spec = FITS[name]
    p = spec.params(k_max=4)
    labels = np.arange(len(x)) % 4
    dense = Dense(x, spec, p, labels)
    state = mx.start_state(data, spec, init_from_labels(as_labels(spark, labels), 4), {0: p})
    for _ in range(2):
        state = mx.sweep(data, spec, state, beta=0.5)
        dense.sweep(beta=0.5)
    check(state, dense)
    assert mx.full_objective(data, spec, state)[0] == pytest.approx(dense.full(), rel=1e-8)


def test_models_of_different_size_share_jobs_without_touching_each_other(spark, small):
    x, _, data = small
    spec = FITS["dp"]
    params = {3: spec.params(k_max=2), 7: spec.params(k_max=5, nu=1.5, f0=0.6)}
    parts = [init_from_labels(as_labels(spark, np.arange(len(x)) % p["k_max"]), p["k_max"], i) for i, p in params.items()]
    state = mx.start_state(data, spec, parts[0].unionByName(parts[1]), params)
    dense = {i: Dense(x, spec, p, np.arange(len(x)) % p["k_max"]) for i, p in params.items()}
    for _ in range(2):
        state = mx.sweep(data, spec, state)
        for m in dense.values():
            m.sweep()
    for i, m in dense.items():
        check(state, m, i)


def test_density_rule_matches_a_series(spark):
    rng = np.random.default_rng(0)
    energy, beta, s = rng.uniform(0, 300, (6, 4)), 3.0, 0.4
    got = lk.density_rows(energy, beta, s)
    for row, out in zip(energy, got):
        h = (row - row.min()) / (row - row.min()).max()
        m = np.diag(-beta * (1 - s) * h) - beta * s * lk.ring(4)
        e, term = np.eye(4), np.eye(4)
        for i in range(1, 80):
            term = term @ m / i
            e = e + term
        np.testing.assert_allclose(out, np.diag(e) / np.trace(e), atol=1e-9)


def test_density_round_blends_for_the_profiles_only(spark, small):
    x, _, data = small
    spec = FITS["dp_density"]
    p = spec.params(k_max=3)
    labels = np.arange(len(x)) % 3
    dense = Dense(x, spec, p, labels)
    state = mx.start_state(data, spec, init_from_labels(as_labels(spark, labels), 3), {0: p})
    anchor = state.resp
    new = mx.sweep(data, spec, state, beta=30.0, density=0.5, anchor=anchor)
    dense.logs()
    r = lk.density_rows(-(dense.lp + dense.loglik()), 30.0, 0.5)
    blend = np.maximum(0.5 * r + 0.5 * dense.r, 1e-10)
    blend /= blend.sum(1, keepdims=True)
    resp = {q["sample_id"]: q["r"] for q in new.resp.collect()}
    np.testing.assert_allclose(np.array([resp[i] for i in sorted(resp)]), r, atol=1e-9)
    f = matrix(new.params.collect(), "feature_id", "f")
    lam = matrix(new.params.collect(), "feature_id", "lam").T
    np.testing.assert_allclose(lam, np.maximum(p["zeta"] + f * (blend.T @ x), 0.1), rtol=1e-8)
    dense.r, dense.f = r, f
    assert new.models[0].elbo == pytest.approx(dense.fast(), rel=1e-8)


def test_samples_and_features_without_cells_count(spark):
    x, _ = planted(n=20, s=12, draws=60)
    x[4], x[:, 5] = 0.0, 0.0
    names = [f"f{j:03d}" for j in range(12)]
    data = prepare(
        as_counts(spark, x), Workspace(spark), samples=as_labels(spark, np.zeros(20)),
        features=spark.createDataFrame([(n,) for n in names], "feature_id string"))
    assert (data.n_samples, data.n_features) == (20, 12)
    spec = FITS["mfm"]
    p = spec.params(k_max=3)
    dense = Dense(x, spec, p, np.arange(20) % 3)
    state = mx.start_state(data, spec, init_from_labels(as_labels(spark, np.arange(20) % 3), 3), {0: p})
    for _ in range(2):
        state = mx.sweep(data, spec, state)
        dense.sweep()
    resp = {r["sample_id"]: r["r"] for r in state.resp.collect()}
    np.testing.assert_allclose(np.array([resp[i] for i in range(20)]), dense.r, atol=1e-7)
    np.testing.assert_allclose(matrix(state.params.collect(), "feature_id", "lam", names).T, dense.lam, rtol=1e-7)


def test_pruning_follows_the_rule(spark, small):
    x, _, data = small
    spec = FITS["py"]
    p = spec.params(k_max=5, min_clusters=2, prune_threshold=0.05)
    labels = np.where(np.arange(len(x)) == 0, 4, np.arange(len(x)) % 3)  # group 3 empty, group 4 a single sample
    state = mx.start_state(data, spec, init_from_labels(as_labels(spark, labels), 5), {0: p})
    state = mx.sweep(data, spec, state)
    before = copy.deepcopy(state.models[0])
    new, changed = mx.prune(data, spec, state)
    keep = mx.kept_groups(mx.wt.means("py", before.a, before.b), before.mass, 0.05, 1.0, 2)
    assert changed == {0} and new.models[0].k == len(keep) < 5
    assert new.models[0].a == [before.a[k] for k in keep]
    old = {r["sample_id"]: np.array(r["r"])[keep] for r in state.resp.collect()}
    for r in new.resp.collect():
        np.testing.assert_allclose(r["r"], old[r["sample_id"]] / old[r["sample_id"]].sum(), atol=1e-12)


def test_kept_groups_floor_prefers_low_numbers_on_ties():
    assert mx.kept_groups([0.2, 0.2, 0.6], [1, 1, 1], 0.9, 0.5, 2) == [0, 2]
    assert floored_softmax(np.zeros((1, 2))).sum() == pytest.approx(1.0)


def test_memberships_run_as_generated_code(spark):
    """No function over arrays per sample; models of different size, floors and masses as stated."""
    rows = spark.createDataFrame(
        [(0, 1, 3, [-1.0, -2.0, -0.5], 0.5, 1.0, 2.0, -900.0), (1, 2, 2, [-0.1, -3.0], 1.0, 4.0, 1.0, None)],
        "model_id int, sample_id int, k_live int, elog_pi array<double>, beta double, ll0 double, ll1 double, ll2 double")
    out = lk.responsibilities(rows, 3, log_norm="log_norm")
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()
    plogp = ob.membership_parts(out, 3)
    assert "lambda" not in plogp._jdf.queryExecution().executedPlan().toString()
    got = {r["model_id"]: r for r in out.collect()}
    parts = {r["model_id"]: r for r in plogp.collect()}
    for i, logit in ((0, 0.5 * np.array([0.0, 0.0, -900.5])), (1, np.array([3.9, -2.0]))):
        e = np.exp(logit - logit.max())
        r = np.maximum(e / e.sum(), 1e-10)
        r = r / r.sum()
        assert got[i]["r"] == pytest.approx(list(r), rel=1e-12)
        assert got[i]["log_norm"] == pytest.approx(logit.max() + np.log(e.sum()))
        assert parts[i]["plogp"] == pytest.approx((r * np.log(r)).sum())


@pytest.fixture(scope="module")
def odd(spark):
    """Samples and features without cells, cells without a sample or a feature, samples of very different length."""
    x, _ = planted(n=60, s=30)
    x[7], x[:, 11], x[20:40, 5:] = 0.0, 0.0, 0.0
    rows = [(int(i), NAMES[j], float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    rows += [(None, "f003", 4.0), (None, "f004", 1.0), (61, None, 3.0), (12, None, 2.0), (None, None, 1.0)]
    return prepare(
        spark.createDataFrame(rows, "sample_id bigint, feature_id string, x double"), Workspace(spark),
        samples=as_labels(spark, np.zeros(60)), features=spark.createDataFrame([(n,) for n in NAMES], "feature_id string"))


@pytest.mark.parametrize("name", ["dp", "dp_cluster", "ssl", "ssl_excess"])
def test_a_sweep_in_one_pass_gives_what_the_joins_give(spark, odd, name, monkeypatch):
    monkeypatch.setattr(pk, "ROW_CELLS", 100)  # several rows and, with STEP_ROWS, several steps
    monkeypatch.setattr(pk, "STEP_ROWS", 2)
    odd.packed, spec = None, FITS[name]
    params = {3: spec.params(k_max=2), 7: spec.params(k_max=5, f0=0.6)}
    parts = [init_from_labels(odd.samples.selectExpr("sample_id", f"coalesce(sample_id % {p['k_max']}, 0) as label"), p["k_max"], i)
             for i, p in params.items()]
    joins = whole = mx.start_state(odd, spec, parts[0].unionByName(parts[1]), params)
    packed = pk.packed_cells(odd, 5, 2)
    assert packed.empty >= 1 and len(packed.ids) == 30 and packed.rows.count() > 3
    for t in range(3):
        joins = mx.sweep(odd, spec, joins, 0.5 + t / 4, gated=name != "ssl_excess" or t > 0)
        whole = mx.sweep(odd, spec, whole, 0.5 + t / 4, gated=name != "ssl_excess" or t > 0, packed=packed)
    assert whole.resp is None
    for i, m in joins.models.items():
        other = whole.models[i]
        assert other.mass == pytest.approx(m.mass, rel=1e-9) and other.plogp == pytest.approx(m.plogp, rel=1e-9)
        assert other.elbo == pytest.approx(m.elbo, rel=1e-9) and other.a == pytest.approx(m.a, rel=1e-9)
    order = ("model_id", "feature_id")
    for a, b in zip(joins.params.orderBy(*order).collect(), whole.params.orderBy(*order).collect(), strict=True):
        assert a[:3] == b[:3] and np.hstack([*b[3:]]) == pytest.approx(np.hstack([*a[3:]]), rel=1e-8)


def test_memberships_are_written_only_where_something_reads_them(spark, small, monkeypatch):
    x, labels, data = small
    spec, names, put = FITS["dp_thermal"], [], Workspace.put
    params = {0: spec.params(k_max=5, max_iter=22, prune_start=10), 1: spec.params(k_max=3, max_iter=12)}
    start = init_from_labels(as_labels(spark, np.arange(len(x)) % 5), 5).unionByName(
        init_from_labels(as_labels(spark, np.arange(len(x)) % 3), 3, 1))
    monkeypatch.setattr(Workspace, "put", lambda self, df, name, **k: names.append(name) or put(self, df, name, **k))
    whole = mx.fit_conjugate(data, spec, start, params)
    assert names.count("params") == 23 and names.count("resp") <= 8
    monkeypatch.setattr(mx, "packed_cells", lambda *a: None)
    joins = mx.fit_conjugate(data, spec, start, params)
    for i, m in joins.models.items():
        other = whole.models[i]
        assert (other.k, other.n_iter, len(other.history)) == (m.k, m.n_iter, len(m.history)) and other.mass == pytest.approx(m.mass)
        assert [h[1] for h in other.history] == pytest.approx([h[1] for h in m.history], rel=1e-9)
    order = ("model_id", "sample_id")
    for a, b in zip(joins.state.resp.orderBy(*order).collect(), whole.state.resp.orderBy(*order).collect(), strict=True):
        assert a[:2] == b[:2] and b["r"] == pytest.approx(a["r"], rel=1e-6, abs=1e-9)


def test_sums_of_samples_against_loops():
    rng = np.random.default_rng(1)
    for n, size in ((7, 3), (3, 400)):  # as a whole matrix and by cells
        x = rng.integers(0, 3, (n, size)) * (rng.random((n, size)) < 0.1 if size > 9 else 1.0)
        s, p = np.nonzero(x)
        counted, c, e = np.arange(n) != 1, rng.normal(size=(size, 4)), rng.normal(size=4)
        r = floored_softmax(0.7 * (e + x @ c))
        got = pk.sample_sums(s, p, x[s, p], counted, {5: c}, {5: e}, 0.7)[5]
        np.testing.assert_allclose(got[:size * 4].reshape(size, 4), (x * counted[:, None]).T @ r, atol=1e-9)
        np.testing.assert_allclose(got[size * 4:-1], r.sum(0))
        assert got[-1] == pytest.approx((r * np.log(r)).sum())


def test_too_many_sums_or_cut_samples_go_on_in_joins(small, sliced, monkeypatch):
    assert pk.packed_cells(sliced[2], 4, 1) is None
    monkeypatch.setattr(pk, "PASS_NUMBERS", 100)
    assert pk.packed_cells(small[2], 4, 1) is None


def test_what_makes_the_counts_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passes(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = spark.range(200).selectExpr("id % 20 as sample_id", "id % 7 as feature_id", "1D as x").groupBy(
        "sample_id", "feature_id").agg({"x": "sum"}).withColumnRenamed("sum(x)", "x")
    n = rows.count()
    data = prepare(rows.mapInPandas(passes, rows.schema), Workspace(spark))
    assert data.nnz == n and seen.value == n
