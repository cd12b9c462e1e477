"""Prediction, reports, moves, full fits, search and the stream."""

from __future__ import annotations

import time
from functools import lru_cache

from pyspark.sql import functions as F

from checks import sql as q
from checks.data import K, _session, prepared, read, start_labels, swept, workspace
from checks.first_order import FirstOrder
from checks.queries import _ARI, _UE_NORM, _silhouette_ctes, _sweeps, query, with_sql
from checks.recursive import WholeFit
from tallymix.operators import initial, metrics, report
from tallymix.operators import objective as ob
from tallymix.plans import base, moves, search, stochastic
from tallymix.plans.fit import fit
from tallymix.plans.mixture import Fit, prune
from tallymix.plans.specs import FITS, linear_anneal
from tallymix.sources import tables as src
from tallymix.streaming import stream


def _fit(spark, d, name: str, n: int = 2, per_sample: bool | None = None) -> Fit:
    spec = FITS[name] if per_sample is None else FITS[name].per_sample(per_sample)
    return Fit(prepared(spark, d), spec, swept(spark, d, name, n, per_sample))


# --- prediction ---------------------------------------------------------------------------


def _next(fit_name: str, per_sample: bool | None = None) -> q.Sweeps:
    s = _sweeps(fit_name, 2, per_sample)
    s.expectations()
    if s.selection == "sample":  # the column mean over all samples, zero cells included
        s.ctes.append("fm as materialized (select feature_id, (sum(f.f) + (max(n) - max(nnz_j))*max(z.f))/max(n) as f "
                      "from f2 f join ftr using (feature_id) cross join z2 z cross join dims group by 1)")
        s.ctes.append("ll2 as materialized (select sample_id, a.k, sum(x*(fm.f*a.e + (1-fm.f)*b.e)) as l from sb "
                      "join fm using (feature_id) join ea2 a using (feature_id) join eb2 b using (feature_id) group by 1, 2)")
    else:
        s.loglik()
    return s


_TOP = ("select sample_id, cast(k as int) as label from (select sample_id, k, row_number() over (partition by sample_id "
        "order by l + lp.e desc, k) as pos from ll2 join lp2 lp using (k)) where pos = 1")

for _name, _mode in (("dp", None), ("dp_cluster", None), ("ssl", None), ("py", None), ("mfm", None), ("nig", False)):
    query(f"predict_{_name}{'_shared' if _mode is False else ''}", _next(_name, _mode).select(_TOP))(
        lambda spark, d, n=_name, m=_mode: report.predict(_fit(spark, d, n, 2, m)).select("sample_id", "label"))


@query("membership", _next("dp").select(
    "select sample_id, round(ln(sum(exp(v - m))) + max(m), 5) as log_norm from (select *, max(v) over (partition by sample_id) as m "
    "from (select sample_id, l + lp.e as v from ll2 join lp2 lp using (k))) group by 1"))
def _(spark, d):
    return report.membership(_fit(spark, d, "dp")).selectExpr("sample_id", "round(log_norm, 5) as log_norm")


@query("hard_labels", _sweeps("mfm", 2).select(
    "select sample_id, cast(k as int) as label from (select sample_id, k, row_number() over (partition by sample_id order by r desc, k) as pos from r2) where pos = 1"))
def _(spark, d):
    return report.hard_labels(swept(spark, d, "mfm", 2).resp).select("sample_id", "label")


# --- reports ------------------------------------------------------------------------------

_MEAN = _next("mfm").ctes


@query("rank_features", with_sql(_MEAN, "select feature_id, round(f, 7) as mean_selection from fm"))
def _(spark, d):
    ranked = report.rank_features(report.mean_selection(_fit(spark, d, "mfm")))
    return ranked.withColumn("mean_selection", F.round("mean_selection", 7))


@query("selected_by_sample", _sweeps("mfm", 2).select("select sample_id, feature_id, round(f, 6) as probability from f2 where f > 0.5"))
def _(spark, d):
    out = report.selected_by_sample(_fit(spark, d, "mfm"))
    return out.selectExpr("sample_id", "feature_id", "round(probability, 6) as probability")


@query("selected_by_majority", _sweeps("mfm", 2).select(
    "select feature_id, round((count(*) filter (f.f > 0.5) + (max(n)-max(nnz_j))*max(case when z.f > 0.5 then 1 else 0 end))/max(n), 6) as share "
    "from f2 f join ftr using (feature_id) cross join z2 z cross join dims group by 1 having "
    "(count(*) filter (f.f > 0.5) + (max(n)-max(nnz_j))*max(case when z.f > 0.5 then 1 else 0 end))/max(n) > 0.1"))
def _(spark, d):
    return report.selected_by_majority(_fit(spark, d, "mfm"), 0.1).selectExpr("feature_id", "round(share, 6) as share")


@query("selected_by_cluster", _sweeps("dp_cluster", 1).select(
    "select cast(k as int) as k, feature_id, round(f, 7) as probability from f1 where f > 0.5"))
def _(spark, d):
    out = report.selected_by_cluster(_fit(spark, d, "dp_cluster", 1))
    return out.selectExpr("k", "feature_id", "round(probability, 7) as probability")


def _ssl_selected() -> q.Sweeps:
    s = _sweeps("ssl", 1)
    s.expectations()
    return s


@query("selected_ssl", _ssl_selected().select(
    "select feature_id, round(max(f.f), 7) as inclusion, round(sum(m.r_k/n*abs(a.e-b.e)), 7) as signal from f1 f join ea1 a using (feature_id) "
    "join eb1 b using (feature_id) join mass1 m using (k) cross join dims where f.f > 0.01 group by 1"))
def _(spark, d):
    out = report.selected_ssl(_fit(spark, d, "ssl", 1), 0.01)
    return out.selectExpr("feature_id", "round(inclusion, 7) as inclusion", "round(signal, 7) as signal")


_MEMBERS = "n5 as materialized (select k, count(*) filter (r > 0.5) as n_samples from r{0} group by 1)"
_SHARE = "pr as materialized (select k, feature_id, v/sum(v) over (partition by k) as profile from lam{0})"


@query("signatures_shared", with_sql(_sweeps("py", 2, False).ctes + [_MEMBERS.format(2), _SHARE.format(2)], """
  select cast(k as int) as k, feature_id, round(f, 6) as selection, round(profile, 8) as profile, n_samples
  from f2 join pr using (feature_id) join n5 using (k) where f > 0.2 and n_samples > 0"""))
def _(spark, d):
    return _rounded_signatures(report.signatures(_fit(spark, d, "py", 2, False), 0.2))


def _rounded_signatures(out):
    return out.selectExpr("k", "feature_id", "round(selection, 6) as selection", "round(profile, 8) as profile", "n_samples")


@query("signatures_per_cluster", with_sql(_sweeps("dp_cluster", 1).ctes + [_MEMBERS.format(1), _SHARE.format(1)], """
  select cast(k as int) as k, feature_id, round(f, 6) as selection, round(profile, 8) as profile, n_samples
  from f1 join pr using (k, feature_id) join n5 using (k) where f > 0.2"""))
def _(spark, d):
    return _rounded_signatures(report.signatures(_fit(spark, d, "dp_cluster", 1), 0.2))


@query("signatures_per_sample", with_sql(_sweeps("mfm", 2).ctes + [_MEMBERS.format(2), _SHARE.format(2)], """
  select cast(k as int) as k, feature_id, round(selection, 6) as selection, round(profile, 8) as profile, n_samples from (
    select r.k, f.feature_id, (sum(f.f) + (max(n_samples) - count(*))*max(z.f))/max(n_samples) as selection
    from f2 f join r2 r using (sample_id) join n5 on n5.k = r.k cross join z2 z where r.r > 0.5 group by 1, 2)
  join pr using (k, feature_id) join n5 using (k) where selection > 0.2"""))
def _(spark, d):
    return _rounded_signatures(report.signatures(_fit(spark, d, "mfm"), 0.2))


@query("signatures_excess", with_sql(_sweeps("ssl_excess", 2).ctes + [_MEMBERS.format(2)], """
  select cast(k as int) as k, feature_id, round(f, 6) as selection, round(v/sum(v) over (partition by k), 8) as profile, n_samples
  from f2 join lam2 using (feature_id) join n5 using (k) where f > 0.0005 and n_samples > 0"""))
def _(spark, d):
    return _rounded_signatures(report.signatures(_fit(spark, d, "ssl_excess"), 0.0005))


@query("cluster_profiles", with_sql(_sweeps("mfm", 2).ctes + [_SHARE.format(2)], """
  select cast(k as int) as k, feature_id, round(profile, 8) as profile, round(r_k, 6) as mass, round(a/sum(a) over (partition by feature_id), 8) as weight
  from pr join mass2 using (k) join w2 using (k)"""))
def _(spark, d):
    out = report.profiles(_fit(spark, d, "mfm"))
    return out.selectExpr("k", "feature_id", "round(profile, 8) as profile", "round(mass, 6) as mass", "round(weight, 8) as weight")


@query("mixing_weights", _sweeps("mfm", 2).select("select cast(k as int) as k, round(a/sum(a) over (), 8) as weight from w2"))
def _(spark, d):
    return report.mixing_weights(_fit(spark, d, "mfm")).selectExpr("k", "round(weight, 8) as weight")


@query("model_summary", _sweeps("ssl", 2).select(
    "select cast(max(n) as bigint) as n_samples, cast(max(s) as bigint) as n_features, cast(3 as int) as k, "
    "count(*) filter (f > 0.5) as n_selected, round(1 - count(*) filter (f > 0.5)/max(s), 8) as sparsity, round(max(theta), 9) as rate "
    "from f2 cross join dims cross join th2"))
def _(spark, d):
    out = report.model_summary(_fit(spark, d, "ssl"))
    return out.selectExpr("n_samples", "n_features", "k", "n_selected", "round(sparsity, 8) as sparsity", "round(rate, 9) as rate")


@query("top_features", _sweeps("ssl_excess", 1).select("select feature_id, round(f, 9) as f from f1 order by f1.f desc, feature_id limit 5"))
def _(spark, d):
    top = report.top_features(swept(spark, d, "ssl_excess", 1).params.select("feature_id", "f"), 5, "f")
    return top.withColumn("f", F.round("f", 9))


_USERS = _UE_NORM + [
    "pairs as materialized (select cast(sample_id % 3 as int) as a, cast(sample_id % 2 as int) as b, count(*) as n from sq group by 1, 2)",
    "tot as (select sum(n) as t from pairs)",
    "ent as (select (select -sum(n/t*ln(n/t)) from pairs, tot) as hab, (select -sum(n/t*ln(n/t)) from (select sum(n) as n from pairs group by a), tot) as ha, "
    "(select -sum(n/t*ln(n/t)) from (select sum(n) as n from pairs group by b), tot) as hb)",
]


@query("metrics_row", with_sql(_USERS + _silhouette_ctes("sqrt(greatest(s.sq + t.sq - 2*coalesce(dot, 0), 0))"), f"""
  select round(cast({_ARI} as double), 7) as ari, round((select (ha + hb - hab)/((ha + hb)/2) from ent), 7) as nmi,
    (select round(avg((b - a)/greatest(a, b)), 7) from sil) as silhouette, true as timed, cast(3 as int) as k_estimated"""))
def _(spark, d):
    data = prepared(spark, d, "user_event")
    started = time.time()
    labels, other = workspace(spark).put(start_labels(data), "labels"), start_labels(data, 2)
    row = metrics.metrics_row(
        metrics.ari(labels, other), metrics.nmi(labels, other), metrics.silhouette(data, labels), time.time() - started, 3)
    return row.selectExpr("round(ari, 7) as ari", "round(nmi, 7) as nmi", "round(silhouette, 7) as silhouette",
                          "elapsed > 0 as timed", "k_estimated")


# --- one mini-batch step over the whole table ---------------------------------------------


def _step_sql() -> list[str]:
    s = _sweeps("dp", 0)
    d, g = q.dg, q.lg
    step = stochastic.step_size(1)
    after = "coalesce(sum(r_k) over (order by k rows between 1 following and unbounded following), 0)"
    return s.ctes + [
        "tl as materialized (select feature_id, k, greatest(rx/(mass+1e-10) / (w/(mass+1e-10) + 1e-10) * 100 + 1, 1) as lam, "
        "colsum/n / (total/n + 1e-10) * 100 + 1 as iota from (select k, feature_id, sum(r*x) as rx from r0 join sb using (sample_id) group by 1, 2) "
        "join (select k, sum(r) as mass, sum(r*n_i) as w from r0 join smp using (sample_id) group by 1) using (k) join ftr using (feature_id) cross join dims)",
        "ta as materialized (select feature_id, k, lam, iota, lam/sum(lam) over (partition by k) as al, iota/sum(iota) over (partition by k) as be from tl)",
        "te as materialized (select *, greatest(0.5*al + 0.5*be, 1e-10) as ef from ta)",
        "ts as materialized (select k, sum(ef) as es from te group by 1)",
        f"tw as materialized (select k, el + coalesce(sum(er) over (order by k rows between unbounded preceding and 1 preceding), 0) as e from "
        f"(select k, least(greatest({d('2.0')} - {d('3.0')}, -20), 0) as el, least(greatest({d('1.0')} - {d('3.0')}, -20), 0) as er from ks))",
        f"tc as materialized (select sample_id, k, sum({g('x + ef')} - {g('ef')}) as l from sb join te using (feature_id) group by 1, 2)",
        f"tg as materialized (select sample_id, k, l + {g('es')} - {g('n_i + es')} + tw.e as l from tc join ts using (k) join tw using (k) join smp using (sample_id))",
        "tr as materialized (select sample_id, k, e/sum(e) over (partition by sample_id) as r, ln(sum(e) over (partition by sample_id)) + m as log_norm from "
        "(select *, exp(l - m) as e from (select *, max(l) over (partition by sample_id) as m from tg)))",
        "tm as materialized (select k, sum(r) as r_k from tr group by 1)",
        f"tk as materialized (select k, greatest({1 - step}*2.0 + {step}*(1 + r_k), 0.5) as rho, greatest({1 - step}*1.0 + {step}*(1.0 + {after}), 0.1) as tau from tm)",
        f"tq as materialized (select feature_id, k, sum(r*({d('(x + al)')} - {d('al')})) as gain from sb join ta using (feature_id) join tr using (sample_id, k) group by 1, 2)",
        f"tb as materialized (select feature_id, sum({d('(x + be)')} - {d('be')}) as gb from sb join (select * from ta where k = 0) using (feature_id) group by 1)",
        f"tn as materialized (select feature_id, k, case when r_k < 0.1 then lam else greatest({1 - step}*lam + {step}*(1 + 0.5*gain), 1) end as lam, "
        f"greatest({1 - step}*iota + {step}*(1 + 0.5*gb/n*n), 1) as iota from ta join tq using (feature_id, k) join tb using (feature_id) join tm using (k) cross join dims)",
        "tz as materialized (select feature_id, k, lam, iota, lam/sum(lam) over (partition by k) as al, iota/sum(iota) over (partition by k) as be from tn)",
        f"ty as materialized (select feature_id, k, sum(r*({g('x + al')} - {g('al')})) + ln(0.3) as yes, sum(r*({g('x + be')} - {g('be')})) + ln(0.7) as nope "
        "from sb join tz using (feature_id) join tr using (sample_id, k) group by 1, 2)",
        f"tp as materialized (select feature_id, k, case when r_k < 0.1 then 0.5 else {1 - step}*0.5 + {step}*(exp(yes - greatest(yes, nope)) / "
        "(exp(yes - greatest(yes, nope)) + exp(nope - greatest(yes, nope)) + 1e-10)) end as phi from ty join tm using (k))",
    ]


def _one_step(spark, d):
    data = prepared(spark, d)
    p = stochastic.stochastic_params(k_max=K, batch_size=data.n_samples, max_iter=1)
    fitted = stochastic.start_batch_fit(data, {0: p}, initial.init_from_labels(start_labels(data), K))
    params, models = stochastic.batch_step(data, fitted.params, fitted.models, data.n_samples, 1)
    return data, fitted, params, models


@query("stochastic_memberships", with_sql(_step_sql(), "select sample_id, k, round(r, 6) as r, round(log_norm, 5) as log_norm from tr"))
def _(spark, d):
    data = prepared(spark, d)
    p = stochastic.stochastic_params(k_max=K)
    fitted = stochastic.start_batch_fit(data, {0: p}, initial.init_from_labels(start_labels(data), K))
    rows = stochastic.batch_memberships(data, fitted.params, fitted.models)
    return rows.selectExpr("sample_id", "posexplode(r) as (k, v)", "log_norm").selectExpr(
        "sample_id", "k", "round(v, 6) as r", "round(log_norm, 5) as log_norm")


@query("stochastic_evidence", with_sql(_step_sql(), "select round(sum(log_norm), 3) as evidence from tr where k = 0"))
def _(spark, d):
    data = prepared(spark, d)
    p = stochastic.stochastic_params(k_max=K)
    fitted = stochastic.start_batch_fit(data, {0: p}, initial.init_from_labels(start_labels(data), K))
    rows = stochastic.batch_memberships(data, fitted.params, fitted.models)
    return ob.evidence(rows, "log_norm").selectExpr("round(evidence, 3) as evidence")


@query("stochastic_profiles", with_sql(_step_sql(), """
  select feature_id, k, round(lam, 6) as lam, round(iota, 6) as iota, round(phi, 6) as phi from tz join tp using (feature_id, k)"""))
def _(spark, d):
    _, _, params, _ = _one_step(spark, d)
    return params.selectExpr("feature_id", "posexplode(arrays_zip(lam, phi)) as (k, v)", "iota").selectExpr(
        "feature_id", "k", "round(v.lam, 6) as lam", "round(iota, 6) as iota", "round(v.phi, 6) as phi")


def _mass_and_weights(threshold: float) -> list[str]:
    """Mean weights after the step, and the groups that the safe pruning rule keeps of at least two."""
    return [
        "pw as materialized (select k, r_k, w/(sum(w) over () + 1e-10) as w from (select k, r_k, exp(ln(greatest(rho/(rho+tau), 1e-10)) + "
        "coalesce(sum(ln(greatest(1 - rho/(rho+tau), 1e-10))) over (order by k rows between unbounded preceding and 1 preceding), 0)) as w "
        "from tk join tm using (k)))",
        f"pk as materialized (select *, w > {threshold} and r_k > 2 as pass, row_number() over (order by w desc, k) as pos from pw)",
        "kept as materialized (select k as old, row_number() over (order by k) - 1 as k from pk where "
        "case when (select count(*) from pk where pass) < 2 then pos <= 2 else pass end)",
        "was as materialized (select feature_id, tz.k as old, lam, phi from tz join tp using (feature_id, k))",
    ]


def _after_burn_in(spark, d, **given):
    data, fitted, params, models = _one_step(spark, d)
    models[0].p.update(given)
    models[0].n_iter = models[0].p["burn_in"]
    return stochastic.BatchFit(data, models, params, stochastic.batch_memberships(data, fitted.params, fitted.models))


def _profile_rows(fitted):
    return fitted.params.selectExpr("feature_id", "posexplode(arrays_zip(lam, phi)) as (k, v)").selectExpr(
        "feature_id", "k", "round(v.lam, 6) as lam", "round(v.phi, 6) as phi")


@query("prune_safe", with_sql(_step_sql() + _mass_and_weights(0.3),
                              "select feature_id, k, round(lam, 6) as lam, round(phi, 6) as phi from was join kept using (old)"))
def _(spark, d):
    fitted = _after_burn_in(spark, d, prune_threshold=0.3)
    sizes = {0: ob.membership_parts(fitted.resp, K).first()["mass"]}
    return _profile_rows(stochastic.prune_safe(fitted, sizes))


@query("merge_weighted", with_sql(_step_sql() + _mass_and_weights(0.3) + [
    "dots as materialized (select a.old as i, b.old as j, sum(a.lam*b.lam) as dot from was a join was b using (feature_id) group by 1, 2)",
    "pair as materialized (select g.i, g.j from dots g join dots a on a.i = g.i and a.j = g.i join dots b on b.i = g.j and b.j = g.j "
    "where g.i < g.j and g.dot/sqrt(a.dot*b.dot) > 0.5 order by g.dot/sqrt(a.dot*b.dot) desc, g.i, g.j limit 1)",
    "joined as materialized (select k as old, coalesce((select i from pair where j = k), k) as head, w from pw)",
    "parts as materialized (select old, dense_rank() over (order by head) - 1 as k, w/sum(w) over (partition by head) as c from joined)",
], "select feature_id, k, round(sum(c*lam), 6) as lam, round(sum(c*phi), 6) as phi from was join parts using (old) group by 1, 2"))
def _(spark, d):
    return _profile_rows(stochastic.merge_weighted(_after_burn_in(spark, d), threshold=0.5))


# --- starts, moves and full fits (no SQL: hashes, k-means, many rounds) --------------------


@query("init_kmeans")
def _(spark, d):
    data = prepared(spark, d, "user_event")
    return initial.init_kmeans(data, [initial.Start(0, 3, 42)], n_init=3).selectExpr("sample_id", "array_position(r, 1D) - 1 as label")


@query("init_kmeans_raw")
def _(spark, d):
    data = prepared(spark, d, "user_event")
    out = initial.init_kmeans(data, [initial.Start(0, 3, 42)], n_init=1, log1p=False)
    return out.selectExpr("sample_id", "array_position(r, 1D) - 1 as label")


@query("init_random", with_sql([q.SUPPLIER_BRAND], f"""
  select model_id, sample_id, k, round(u / sum(u) over (partition by model_id, sample_id), 9) as r from (
    select model_id, sample_id, k, {q.draw('sample_id', 'seed', 'k')} as u
    from (select distinct sample_id from sb) cross join (values (0, 3, 1), (1, 5, 2)) as t(model_id, groups, seed),
    (select unnest(range(5)) as k) where k < groups)"""))
def _(spark, d):
    drawn = initial.init_random(prepared(spark, d).samples, [initial.Start(0, 3, 1), initial.Start(1, 5, 2)])
    return drawn.selectExpr("model_id", "sample_id", "posexplode(r) as (k, r)").withColumn("r", F.round("r", 9))


@query("init_noise", with_sql([q.SUPPLIER_BRAND], f"""
  select sample_id, k, round(u / sum(u) over (partition by sample_id), 9) as r from (
    select sample_id, k, case when sample_id % 3 = k then 1 else 0 end + 0.01 * {q.draw('sample_id', '0', 'k', seed=7)} as u
    from (select distinct sample_id from sb), (select unnest(range(3)) as k))"""))
def _(spark, d):
    start = initial.init_from_labels(start_labels(prepared(spark, d)), K)
    noisy = initial.add_noise(start, seed=7)
    return noisy.selectExpr("sample_id", "posexplode(r) as (k, r)").withColumn("r", F.round("r", 9))


@query("init_noisy_kmeans")
def _(spark, d):
    data = prepared(spark, d, "user_event")
    return initial.add_noise(initial.init_kmeans(data, [initial.Start(0, 3, 42)], n_init=3), seed=7)


def _move(kind: str, label: str):
    def run(spark, d):
        fitted = _fit(spark, d, "mfm_moves", 1)
        for m in fitted.models.values():
            m.p.update(k_max=K + 1)
        state, accepted = moves.try_move(fitted.data, fitted.spec, fitted.state, kind, seed=3)
        return spark.createDataFrame(
            [(label, i in accepted, m.k) for i, m in state.models.items()], "move string, accepted boolean, k int")

    query(f"move_{label}")(run)


_move("merge", "merge")
_move("merge_gated", "merge_gated")
_move("delete", "delete")
_move("split", "split")


def _kept_sql(s: q.Sweeps, p: dict, size: str, version: int) -> list[str]:
    """Groups that pass the weight and size tests, at least min_clusters of them, renumbered."""
    v = version
    before = "coalesce(sum(ln(greatest(1-a/(a+b), 1e-10))) over (order by k rows between unbounded preceding and 1 preceding), 0)"
    return s.ctes + [
        f"wt as materialized (select k, r_k, exp(ln(greatest(a/(a+b), 1e-10)) + {before}) as w from w{v} join mass{v} using (k))",
        f"ok as materialized (select *, w > {p['prune_threshold']} and r_k > {size} as pass, row_number() over (order by w desc, k) as pos from wt cross join dims)",
        f"kept as materialized (select k, row_number() over (order by k) - 1 as label from ok where "
        f"case when (select count(*) from ok where pass) < {p['min_clusters']} then pos <= {p['min_clusters']} else pass end)",
    ]


_TOP_R = ("select sample_id, cast(label as int) as label from (select sample_id, label, row_number() over (partition by sample_id "
          "order by r desc, label) as pos from r{0} join kept using (k)) where pos = 1")


@query("prune", with_sql(_kept_sql(_sweeps("dp", 2), FITS["dp"].params(k_max=K), "greatest(1, n/(5.0*3))", 2), _TOP_R.format(2)))
def _(spark, d):
    fitted = _fit(spark, d, "dp")
    state, _ = prune(fitted.data, fitted.spec, fitted.state)
    return report.hard_labels(state.resp).select("sample_id", "label")


# whole fits at their own default limits, to their own stop: pruning, freezing and averaging on the way
def _whole(name: str):
    spec = FITS[name]
    p = spec.params()
    sql = WholeFit(spec, p).select(
        "select sample_id, label, round(r, 4) as r, groups, rounds, converged, level, objective from (select sample_id, cast(k as int) as label, r, "
        "row_number() over (partition by sample_id order by r desc, k) as pos from r) cross join (select count(*) as groups from kept) "
        "cross join (select cast(max(a) filter (where id = 'iter') as int) as rounds, max(a) filter (where id = 'done') = 1 as converged, "
        "case when max(a) filter (where id = 'frozen') = 1 then round(max(a) filter (where id = 'level'), 5) end as level, "
        "round(arg_max(a, k) filter (where kind = 'his'), 1) as objective from fin) where pos = 1")

    def run(spark, d):
        data = prepared(spark, d, "doc_letter")
        out = fit(data, name, init=start_labels(data, p["k_max"]))
        m = out.models[0]
        level = "cast(null as double)" if m.baseline is None else f"round({m.baseline!r}D, 5)"
        labels = report.hard_labels(out.state.resp).select("sample_id", "label")
        return labels.join(out.state.resp, "sample_id").selectExpr(
            "sample_id", "cast(label as int) as label", "round(array_max(r), 4) as r", f"{m.k}L as groups", f"{m.n_iter} as rounds",
            f"{str(m.converged).lower()} as converged", f"{level} as level",
            f"round({m.history[-1][1]!r}D, 1) as objective")

    query(f"fit_{name}", sql)(run)


for _name in ("dp", "dp_cluster", "py", "mfm", "nig", "ssl", "ssl_excess", "dp_thermal"):
    _whole(_name)


# fits with moves: two annealed rounds in which no move is possible (the moves have queries of their own)
ROUNDS = {f: dict(anneal_iters=1, merge_every=2, n_restarts=1) for f in ("py_moves", "mfm_moves", "nig_moves")}


def _rounds(name: str, given: dict):
    spec, rounds = FITS[name], 2
    p = spec.params(k_max=K, min_clusters=K, max_iter=rounds, **given)
    s = q.Sweeps(p, spec.weights, spec.selection, spec.select_first, spec.start, K)
    for t in range(rounds):
        s.sweep(linear_anneal(t + 1, p["beta_start"], p["beta_end"], p["anneal_iters"]))

    def run(spark, d):
        data = prepared(spark, d)
        out = fit(data, name, init=start_labels(data), k_max=K, min_clusters=K, max_iter=rounds, **given)
        return out.state.resp.selectExpr("sample_id", "posexplode(r) as (k, v)").selectExpr("sample_id", "k", "round(v, 5) as r")

    query(f"fit_{name}", s.select(f"select sample_id, k, round(r, 5) as r from r{rounds}"))(run)


for _name, _given in ROUNDS.items():
    _rounds(_name, _given)


# whole fits from k-means, with pruning or moves
_SHORT_MOVES = dict(k_max=3, max_iter=2, anneal_iters=1, merge_every=2, min_clusters=2)
SHORT = {
    "dp": dict(k_max=4, max_iter=10), "mfm": dict(k_max=4, max_iter=5), "dp_density": dict(k_max=4, max_iter=6, tau1=3, tau2=5),
    "py_moves": _SHORT_MOVES,
}


def _full(name: str):
    def run(spark, d):
        out = fit(prepared(spark, d, "user_event"), name, n_init=1, n_restarts=1, kmeans_iter=3, **SHORT[name])
        return report.hard_labels(out.state.resp).select("sample_id", "label")

    query(f"fit_{name}_from_kmeans")(run)


for _name in SHORT:
    _full(_name)


@query("fit_restarts")
def _(spark, d):
    out = fit(prepared(spark, d, "user_event"), "dp", init="random", n_restarts=3, k_max=4, max_iter=10)
    return report.hard_labels(out.state.resp)


@query("fit_stochastic")
def _(spark, d):
    data = prepared(spark, d, "user_event")
    p = stochastic.stochastic_params(k_max=4, max_iter=3, batch_size=64)
    start = initial.add_noise(initial.init_kmeans(data, [initial.Start(0, 4, 5)], n_init=1, max_iter=3), seed=5)
    return stochastic.predict_stochastic(stochastic.fit_stochastic(data, {0: p}, start, seed=5)).select("sample_id", "label")


@lru_cache(maxsize=None)
def _first_order(app: str, d: str):
    """One whole first-order fit at its default rounds with its history, shared by the queries on it."""
    data = prepared(_session(), d)
    path = data.ws.path("base-history")
    return fit(data, "base", k=K, init=start_labels(data), history_path=path), path


def _base(spark, d):
    return _first_order(spark.sparkContext.applicationId, d)


_BASE = FirstOrder(K, 100, counts=q.SUPPLIER_BRAND.replace("sb as", "cnt as", 1))
_SPARSE = FirstOrder(K, 100)  # for the rows that hold no fit


@query("fit_base", _BASE.select(
    "select sample_id, k as label, round(r, 4) as r, round(log_norm, 2) as log_norm from "
    "(select *, row_number() over (partition by sample_id order by r desc, k) as pos from r1) where pos = 1"))
def _(spark, d):
    resp = _base(spark, d)[0].resp
    return report.hard_labels(resp).join(resp, ["model_id", "sample_id"]).selectExpr(
        "sample_id", "label", "round(array_max(r), 4) as r", "round(log_norm, 2) as log_norm")


@query("base_profiles", _BASE.select(
    "select g.id as feature_id, g.k, round(g.a, 4) as gamma, round(f.a, 4) as iota, round(1 + f.b, 4) as xi1, "
    "round(1 + n - f.b, 4) as xi2 from fin g join fin f on f.id = g.id and f.kind = 'ftr' cross join dim where g.kind = 'gam'"))
def _(spark, d):
    rows = _base(spark, d)[0].params.selectExpr("feature_id", "posexplode(gamma) as (k, gamma)", "iota", "xi1", "xi2")
    return rows.select("feature_id", "k", *[F.round(c, 4).alias(c) for c in ("gamma", "iota", "xi1", "xi2")])


@query("base_selection", _BASE.select(
    "select feature_id, round(avg(f), 5) as mean_selection from sel1 group by 1"))
def _(spark, d):
    ranked = report.rank_features(base.mean_selection(_base(spark, d)[0]))
    return ranked.withColumn("mean_selection", F.round("mean_selection", 5))


@query("base_cell_selection", _BASE.select("select sample_id, feature_id, round(f, 4) as selection from sel1"))
def _(spark, d):
    cells = base.cell_selection(_base(spark, d)[0])
    return cells.select("sample_id", "feature_id", F.round("selection", 4).alias("selection"))


@query("base_history", _BASE.select(
    "select iter, feature_id, selection, mass from (select t as iter, id as feature_id, round(avg(a), 4) as selection from his "
    "where kind = 'sel' group by 1, 2) join (select t as iter, round(sum(a), 2) as mass from his where kind = 'r' and k = 0 group by 1) "
    "using (iter)", every=10))
def _(spark, d):
    path = _base(spark, d)[1]
    cells = spark.read.parquet(f"{path}/cell_selection").groupBy("iter", "feature_id").agg(F.round(F.avg("f"), 4).alias("selection"))
    masses = spark.read.parquet(f"{path}/resp").groupBy("iter").agg(F.round(F.expr("sum(r[0])"), 2).alias("mass"))
    return cells.join(masses, "iter")


@query("base_first_selection", "with " + ",\n".join(_SPARSE._start()) +
       "\nselect sample_id, feature_id, round(f, 9) as selection from sel0")
def _(spark, d):
    data = prepared(spark, d, "doc_letter")
    first = base.start_selection(data, _base_tiles(spark, d), [0])
    return first.select("sample_id", "feature_id", F.round("selection", 9).alias("selection"))


@lru_cache(maxsize=None)
def _tiles_of(app: str, d: str):
    return base.make_tiles(prepared(_session(), d, "doc_letter"), 100, 8)


def _base_tiles(spark, d):
    return _tiles_of(spark.sparkContext.applicationId, d)


@query("base_tiles", "with " + ",\n".join(_SPARSE._start()) + "\nselect sample_id, feature_id, x from dx")
def _(spark, d):
    return base.cells_of(_base_tiles(spark, d))


@query("fit_stream")
def _(spark, d):
    """Events cut into files by time, streamed one file per micro-batch."""
    ws = workspace(spark)
    files, state, checkpoint = ws.path("events"), ws.path("state"), ws.path("stream-checkpoint")
    events = read(spark, d, "events").select("user_id", "event_type", "ts")
    events.repartitionByRange(3, "ts").write.parquet(files)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(files)
    p = stochastic.stochastic_params(k_max=3)
    stream.fit_stream(source, state, p, checkpoint, sample="user_id", feature="event_type").awaitTermination()
    last = stream.latest_before(spark, state, 1 << 30)
    params, _, _ = stream.load_state(spark, state, last)
    return params.selectExpr("feature_id", "size(lam) as k", "round(iota, 3) as iota")


# --- sinks --------------------------------------------------------------------------------


@query("save_and_load_model", _next("dp").select(_TOP))
def _(spark, d):
    fitted, path = _fit(spark, d, "dp"), workspace(spark).path("model")
    src.save_model(fitted, path)
    return report.predict(src.load_model(spark, path, fitted.data)).select("sample_id", "label")


@query("save_history")
def _(spark, d):
    path = workspace(spark).path("history")
    fit(prepared(spark, d, "user_event"), "dp", init="random", k_max=3, max_iter=10, history_path=path)
    return spark.read.parquet(f"{path}/resp").select("iter", "sample_id")


# --- search -------------------------------------------------------------------------------

# trials made of the given tables: one per supplier, scores from its lines
_TRIALS = """trials as materialized (
  select l_suppkey as trial_id, round(avg(l_discount)*10, 4) as ari, round(avg(l_tax)*10, 4) as nmi, count(*) % 7 as k_est
  from lineitem group by 1)"""


def _trials(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("trial_id")).agg(
        F.round(F.avg("l_discount") * 10, 4).alias("ari"), F.round(F.avg("l_tax") * 10, 4).alias("nmi"),
        (F.count("*") % 7).alias("k_est"))


@query("rank_trials", with_sql([_TRIALS], """
  select trial_id, ari, nmi, k_est, cast(row_number() over (order by ari desc, nmi desc, trial_id) as int) as rank
  from trials qualify rank <= 10"""))
def _(spark, d):
    return search.rank_trials(_trials(spark, d), 10)


@query("seed_average", """
  select l_linenumber as trial_id, round(avg(l_discount), 8) as mean_score, round(avg(l_quantity), 8) as mean_k, count(*) as n_seeds
  from lineitem group by 1""")
def _(spark, d):
    runs = read(spark, d, "lineitem").selectExpr("l_linenumber as trial_id", "l_discount as ari", "l_quantity as k_est")
    return search.seed_average(runs).selectExpr(
        "trial_id", "round(mean_score, 8) as mean_score", "round(mean_k, 8) as mean_k", "n_seeds")


@query("running_best", with_sql([_TRIALS], """
  select trial_id, ari, best_before, greatest(best_before, ari) as best, best_before is null or ari > best_before as is_best,
    round(ari - best_before, 6) as delta from (
    select *, max(ari) over (order by trial_id rows between unbounded preceding and 1 preceding) as best_before from trials)"""))
def _(spark, d):
    out = search.running_best(_trials(spark, d))
    return out.selectExpr("trial_id", "ari", "best_before", "best", "is_best", "round(delta, 6) as delta")


@query("save_trials", with_sql([_TRIALS], "select trial_id, ari, nmi, k_est from trials"))
def _(spark, d):
    path = workspace(spark).path("trials")
    src.save_trials(_trials(spark, d), path)
    return spark.read.schema("trial_id bigint, ari double, nmi double, k_est bigint").json(path)


def _user_truth(spark, d):
    """The event type each user has most often."""
    counts = prepared(spark, d, "user_event").cells
    return counts.groupBy("sample_id").agg(F.max_by("feature_id", F.struct("x", "feature_id")).alias("label"))


@query("search")
def _(spark, d):
    data = prepared(spark, d, "user_event")
    out = search.search(data, "dp", 3, seed=1, labels=_user_truth(spark, d), space={"k_max": (3, 5)}, init="random", max_iter=10)
    return out.trials.select("trial_id", "config", "ari", "nmi", "k_est", "error")


@query("search_without_labels")
def _(spark, d):
    data = prepared(spark, d, "user_event")
    configs = search.sample_configs(spark, "py", 3, seed=2, space={"k_max": (3, 4)})
    return search.run_trials(data, configs, "py", init="random", max_iter=5).select("trial_id", "config", "proxy", "k_est", "error")


@query("refit_best")
def _(spark, d):
    data = prepared(spark, d, "user_event")
    runs = search.refit_best(data, "nig", {"k_max": 3, "sigma": 0.4}, 11, _user_truth(spark, d), 2, init="random", max_iter=5)
    return runs.select("rank", "seed", "ari", "nmi", "k_est")
