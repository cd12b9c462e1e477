import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymix.functions import special as sp
from tallymix.operators import selection as sl
from tallymix.operators import weights as wt


def value(spark, expr):
    return spark.range(1).select(F.expr(expr)).first()[0]


def test_digamma_known_values(spark):
    euler = 0.5772156649015329
    assert value(spark, sp.digamma("1D")) == pytest.approx(-euler, abs=1e-12)
    assert value(spark, sp.digamma("0.5D")) == pytest.approx(-euler - 2 * math.log(2), abs=1e-12)
    assert value(spark, sp.digamma("1e-10D")) == pytest.approx(-1e10 - euler, abs=1e-4)
    assert value(spark, sp.digamma("1e6D")) == pytest.approx(math.log(1e6) - 0.5e-6, abs=1e-11)


@pytest.mark.parametrize("x", [1e-8, 0.1, 0.5, 1.0, 2.0, 7.3, 100.0, 1e7])
def test_lgamma(spark, x):
    assert value(spark, sp.lgamma(sp.num(x))) == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-11)


@given(st.floats(1e-6, 1e8))
@settings(max_examples=200, deadline=None)
def test_array_versions(x):
    assert float(sp.lgamma_array(np.float64(x))) == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-10)
    step = sp.digamma_value(x + 1.0) - sp.digamma_value(x)
    assert step == pytest.approx(1.0 / x, rel=1e-6, abs=1e-9)


def test_beta_kl_is_zero_at_the_prior(spark):
    assert value(spark, sp.beta_kl("1.5D", "2D", "1.5D", "2D")) == pytest.approx(0.0, abs=1e-10)
    assert value(spark, sp.beta_kl("3D", "2D", "1D", "1D")) == pytest.approx(sp.beta_kl_value(3, 2, 1, 1), abs=1e-10)


def test_softmax_floor_and_short_arrays(spark):
    rows = spark.createDataFrame([(1, [0.0, -1000.0]), (2, [3.0, 3.0, 3.0])], "id int, l array<double>")
    out = {r["id"]: r for r in sp.with_softmax(rows, "l", "r", log_norm="n").collect()}
    assert out[1]["r"][1] == pytest.approx(1e-10, rel=1e-6) and sum(out[1]["r"]) == pytest.approx(1.0)
    assert out[2]["r"] == pytest.approx([1 / 3] * 3) and out[2]["n"] == pytest.approx(3 + math.log(3))


def test_hash_uniform_is_repeatable_and_spread(spark):
    u = spark.range(5000).selectExpr(f"{sp.hash_uniform('id', seed=3)} as u").toPandas()["u"]
    again = spark.range(5000).selectExpr(f"{sp.hash_uniform('id', seed=3)} as u").toPandas()["u"]
    assert (u == again).all() and 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02


@pytest.mark.parametrize("q", [0.0, 0.5, 0.731, 0.9, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=3000), np.full(500, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    want = np.quantile(values, q)
    assert sl.exact_quantile(df, "v", q) == pytest.approx(want, abs=1e-12)
    assert sl.exact_quantile(df, "v", q, slots=3) == pytest.approx(want, abs=1e-12)


def test_quantiles_of_several_keys(spark):
    rng = np.random.default_rng(2)
    values = {0: rng.normal(size=400), 1: np.repeat(2.5, 30), 5: np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "model_id int, g double")
    got = sl.exact_quantiles(df, "model_id", "g", {0: 0.83, 1: 0.5, 5: 0.9}, slots=16)
    assert got == pytest.approx({k: np.quantile(values[k], q) for k, q in ((0, 0.83), (1, 0.5), (5, 0.9))}, abs=1e-12)
    with pytest.raises(ValueError):
        sl.exact_quantiles(df, "model_id", "g", {3: 0.5})


@pytest.mark.parametrize("kind,p", [("dp", {"nu": 0.3}), ("py", {"d": 0.2, "theta": 0.7}), ("nig", {"sigma": 0.5, "alpha": 1.0}),
                                    ("mfm", {"delta": 1.0, "gamma": 2.0})])
def test_weight_tables_agree_with_the_driver_numbers(spark, kind, p):
    mass = [12.0, 0.5, 7.25, 3.0]
    df = spark.createDataFrame([(0, k, m) for k, m in enumerate(mass)], "model_id int, k int, mass double")
    a, b = wt.update(kind, mass, p)
    if kind == "mfm":
        table = wt.mfm_weights(df, **p)
        assert [r["phi"] for r in table.orderBy("k").collect()] == pytest.approx(a)
        elog, mean = wt.elog_dirichlet(table), wt.mean_weights(table, "dirichlet")
    else:
        table = {"dp": wt.dp_sticks, "py": wt.py_sticks, "nig": wt.nig_sticks}[kind](df, **p)
        rows = table.orderBy("k").collect()
        assert [r["a"] for r in rows] == pytest.approx(a) and [r["b"] for r in rows] == pytest.approx(b)
        elog = wt.elog_sticks(table)
        mean = wt.mean_weights(elog, "softmax") if kind == "nig" else wt.mean_weights(table, "sticks")
    logs = wt.elog(a, b)
    assert [r["elog_pi"] for r in elog.orderBy("k").collect()] == pytest.approx(logs)
    assert [r["weight"] for r in mean.orderBy("k").collect()] == pytest.approx(wt.means(kind, a, b, logs))


def test_py_needs_a_valid_concentration(spark):
    with pytest.raises(ValueError):
        wt.py_sticks(spark.createDataFrame([(0, 0, 1.0)], "model_id int, k int, mass double"), 0.2, -0.3)
