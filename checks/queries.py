"""One query per operator, with SQL where one statement gives the same table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql as q
from checks.data import K, doc_token, prepared, read, start_labels, supplier_brand, swept, user_event, workspace
from tallymix.functions import special as sp
from tallymix.operators import likelihood as lk
from tallymix.operators import metrics as mt
from tallymix.operators import objective as ob
from tallymix.operators import prep
from tallymix.operators import profiles as pf
from tallymix.operators import selection as sl
from tallymix.operators import weights as wt
from tallymix.operators.initial import init_from_labels
from tallymix.plans import mixture as mx
from tallymix.plans.specs import FITS
from tallymix.sources import tables as src

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def with_sql(ctes: list[str], select: str) -> str:
    return q.statement(ctes, select)


SB, DT, UE = q.SUPPLIER_BRAND, q.DOC_TOKEN, q.USER_EVENT

# --- sources ----------------------------------------------------------------------------


@query("counts_from_events", with_sql([SB], "select * from sb"))
def _(spark, d):
    return supplier_brand(spark, d)


@query("counts_from_tokens", with_sql([DT], "select * from dt"))
def _(spark, d):
    return doc_token(spark, d)


@query("counts_from_events_weighted", """
  select user_id as sample_id, event_type as feature_id, round(cast(sum(value) as double), 4) as x
  from events group by 1, 2 having sum(value) <> 0""")
def _(spark, d):
    counts = src.counts_from_events(read(spark, d, "events"), "user_id", "event_type", "value")
    return counts.withColumn("x", F.round("x", 4))


def _wide(spark, d, row: str, sep: str) -> str:
    """The supplier table as wide text, zeros included: one column per brand."""
    wide = supplier_brand(spark, d).withColumnRenamed("sample_id", row).groupBy(row).pivot("feature_id").agg(F.first("x"))
    path = workspace(spark).path("wide")
    wide.na.fill(0.0).write.option("header", True).option("sep", sep).csv(path)
    return path


@query("read_counts_wide", with_sql([SB], "select * from sb"))
def _(spark, d):
    counts = src.read_counts(spark, _wide(spark, d, "sample_id", ","))
    return counts.withColumn("sample_id", F.col("sample_id").cast("bigint"))


@query("read_counts_features_in_rows", with_sql([SB], """
  select feature_id as sample_id, cast(sample_id as varchar) as feature_id, x from sb"""))
def _(spark, d):
    """Rows are features (suppliers), the header names the samples (brands)."""
    return src.read_counts(spark, _wide(spark, d, "feature", "\t"), "\t", features_in_rows=True)


def _csv(spark, df: DataFrame, name: str) -> str:
    path = workspace(spark).path(f"{name}-csv")
    df.write.option("header", True).csv(path)
    return path


@query("read_labels", "select cast(doc_id as varchar) as sample_id, lang as label from documents")
def _(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("Index"), F.col("lang").alias("Label"))
    return src.read_labels(spark, _csv(spark, docs, "labels"))


@query("read_feature_list", with_sql([SB], "select feature_id, sum(x) as score from sb group by 1"))
def _(spark, d):
    scores = supplier_brand(spark, d).groupBy("feature_id").agg(F.sum("x").alias("score"))
    return src.read_feature_list(spark, _csv(spark, scores, "features"))


@query("read_ordination", """
  select vec_id as id, round(cast(embedding[1] as double), 6) as mds1, round(cast(embedding[2] as double), 6) as mds2,
         label from embeddings""")
def _(spark, d):
    e = read(spark, d, "embeddings")
    flat = e.selectExpr("vec_id as id", "cast(embedding[0] as double) as mds1", "cast(embedding[1] as double) as mds2", "label")
    schema = "id bigint, mds1 double, mds2 double, label int"
    back = src.read_ordination(spark, _csv(spark, flat, "ordination"), schema)
    return back.withColumns({"mds1": F.round("mds1", 6), "mds2": F.round("mds2", 6)})


@query("tree_tips", """
  select c_custkey // 100 as tree, row_number() over (partition by c_custkey // 100 order by c_custkey) as tip_index,
         'taxon_' || cast(c_custkey as varchar) as tip from customer""")
def _(spark, d):
    """Every hundred customers as the leaves of one tree, then the leaf names back from the text."""
    names = F.concat(F.lit("taxon_"), F.col("c_custkey").cast("string"), F.lit(":0.1"))
    lines = read(spark, d, "customer").groupBy(F.expr("c_custkey div 100").alias("tree")).agg(
        F.sort_array(F.collect_list(F.struct("c_custkey", names.alias("name")))).alias("leaves")
    )
    lines = lines.select("tree", F.expr("concat('(', array_join(transform(leaves, v -> v.name), ','), ');')").alias("value"))
    return src.tip_rows(lines).withColumn("tip_index", F.col("tip_index").cast("bigint"))


@query("validate_counts", with_sql([DT], """
  select cast(count(*) as bigint) as cells, count(distinct sample_id) as samples, count(distinct feature_id) as features,
    cast(0 as bigint) as negative, cast(0 as bigint) as not_finite, cast(0 as bigint) as duplicates from dt"""))
def _(spark, d):
    return src.validate_counts(doc_token(spark, d))


# --- preparation ------------------------------------------------------------------------


@query("filter_features", with_sql([DT], """
  select * from dt where feature_id in (select feature_id from dt group by 1 having sum(x) >= 50)"""))
def _(spark, d):
    return prep.filter_features(doc_token(spark, d), 50)


@query("align_labels", """
  select c_custkey as sample_id, c_mktsegment as label from customer where c_custkey in (select o_custkey from orders)""")
def _(spark, d):
    counts = src.counts_from_events(read(spark, d, "orders"), "o_custkey", "o_orderpriority")
    labels = read(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("label"))
    return prep.align(counts, labels)


def _languages(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("label"))


@query("encode_labels", """
  select doc_id as sample_id, lang as label, cast(c as int) as label_id from documents join
    (select lang, dense_rank() over (order by min(doc_id)) - 1 as c from documents group by 1) using (lang)""")
def _(spark, d):
    return prep.encode_labels(_languages(spark, d), "sample_id")


@query("map_label", """
  select doc_id as sample_id, lang as label, cast(case lang when 'en' then 2 when 'de' then 4 else 0 end as int) as code
  from documents""")
def _(spark, d):
    return prep.map_label(_languages(spark, d), {"en": 2, "de": 4}, 0)


@query("log1p_counts", with_sql([SB], "select sample_id, feature_id, round(ln(1 + x), 9) as x from sb"))
def _(spark, d):
    return prep.log1p_counts(supplier_brand(spark, d)).withColumn("x", F.round("x", 9))


@query("library_sizes", with_sql([DT], "select sample_id, sum(x) as n_i from dt group by 1"))
def _(spark, d):
    return prep.library_sizes(doc_token(spark, d))


@query("sparsity", with_sql([DT], """
  select count(*) as nnz, count(distinct sample_id) as n_samples, count(distinct feature_id) as n_features,
    round(1 - count(*) / (cast(count(distinct sample_id) as double) * count(distinct feature_id)), 9) as sparsity from dt"""))
def _(spark, d):
    return prep.sparsity(doc_token(spark, d)).withColumn("sparsity", F.round("sparsity", 9))


@query("as_category", "select vec_id, cast(label as varchar) as label from embeddings")
def _(spark, d):
    return prep.as_category(read(spark, d, "embeddings").select("vec_id", "label"), ["label"])


_TIPS = [DT, "lang as (select doc_id as sample_id, lang from documents)",
         "a as (select distinct feature_id from dt join lang using (sample_id) where lang = 'de')",
         "b as (select distinct feature_id from dt join lang using (sample_id) where lang = 'fr')",
         "m as (select t.feature_id as tip, case when b.feature_id is not null then '*' when a.feature_id is not null then '+' "
         "else '' end as symbol from (select distinct feature_id from dt) t left join a using (feature_id) "
         "left join b using (feature_id))"]


def _annotated(spark, d):
    # one pass over the counts: both sets hold features only, so their marks are found per feature
    spoken = doc_token(spark, d).join(_languages(spark, d), "sample_id", "left")
    marks = spoken.groupBy(F.col("feature_id")).agg(
        F.expr("bool_or(label = 'de')").alias("de"), F.expr("bool_or(label = 'fr')").alias("fr"))
    marks = workspace(spark).put(marks, "tip-marks")  # one row per feature
    return prep.annotate_tips(marks.selectExpr("feature_id as tip"), marks.where("de"), marks.where("fr"))


@query("annotate_tips", with_sql(_TIPS, "select tip, symbol from m"))
def _(spark, d):
    return _annotated(spark, d)


@query("tip_colours", with_sql(_TIPS, """
  select symbol, colour, count(*) as n from (
    select symbol, case symbol when '+' then 'red' when '*' then 'blue' else 'black' end as colour from m) group by 1, 2"""))
def _(spark, d):
    return prep.tip_colours(_annotated(spark, d)).groupBy("symbol", "colour").agg(F.count("*").alias("n"))


@query("band_by_range", """
  select o_orderkey, case when o_orderkey between 5000 and 9000 then 'purple' when o_orderkey between 1001 and 6000 then 'green'
    when o_orderkey between 1 and 1000 then 'black' else 'none' end as band from orders""")
def _(spark, d):
    bands = [(1, 1000, "black"), (1001, 6000, "green"), (5000, 9000, "purple")]
    return prep.band_by_range(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", bands, "none")


@query("mask_cells", with_sql([DT], f"select * from dt where {q.draw('sample_id', 'feature_id', seed=1)} >= 0.15"))
def _(spark, d):
    return prep.mask_cells(doc_token(spark, d), 0.15, seed=1)


def _batch_sql(size: int, iteration: int, seed: int) -> str:
    return with_sql([
        f"places as materialized (select doc_id as sample_id, row_number() over (order by {q.draw('doc_id', seed=seed)}, doc_id) - 1 as place from documents)",
        f"first as materialized (select count(*) as n, floor(count(*) * {q.draw(chr(39) + 'batch' + chr(39), str(iteration), seed=seed)}) as f from places)",
    ], f"select sample_id from places cross join first where (place - f + n) % n < {size}")


@query("mini_batch", _batch_sql(256, 3, 42))
def _(spark, d):
    samples = read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"))
    return prep.mini_batch(prep.shuffled_places(samples, 42, workspace(spark)), samples.count(), 256, iteration=3, seed=42)


@query("shuffled_places", f"""
  select doc_id as sample_id, row_number() over (order by {q.draw('doc_id', seed=7)}, doc_id) - 1 as place from documents""")
def _(spark, d):
    samples = read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"))
    return prep.shuffled_places(samples, 7, workspace(spark))


# --- numeric building blocks ------------------------------------------------------------


@query("special_functions", f"""
  select p_partkey, round({q.dg('p_retailprice')}, 8) as psi_large, round({q.dg('(p_size / 7.0)')}, 8) as psi_small,
    round({q.lg('p_retailprice')}, 6) as lg_large, round({q.lg('p_size / 7.0')}, 8) as lg_small from part""")
def _(spark, d):
    return read(spark, d, "part").selectExpr(
        "p_partkey", f"round({sp.digamma('p_retailprice')}, 8) as psi_large", f"round({sp.digamma('p_size / 7D')}, 8) as psi_small",
        f"round({sp.lgamma('p_retailprice')}, 6) as lg_large", f"round({sp.lgamma('p_size / 7D')}, 8) as lg_small")


@query("softmax_rows", with_sql([SB], f"""
  select sample_id, k, round(g / sum(g) over (partition by sample_id), 9) as r, round(ln(s) + m, 9) as log_norm from (
    select *, greatest(e / s, {q.EPS}) as g from (
      select *, sum(e) over (partition by sample_id) as s from (
        select *, exp(x - m) as e from (
          select sample_id, row_number() over (partition by sample_id order by feature_id) - 1 as k, x,
            max(x) over (partition by sample_id) as m from sb))))"""))
def _(spark, d):
    rows = supplier_brand(spark, d).groupBy("sample_id").agg(  # at most one entry per brand
        F.sort_array(F.collect_list(F.struct("feature_id", "x"))).alias("c")
    ).selectExpr("sample_id", "transform(c, v -> v.x) as logit")
    soft = sp.with_softmax(rows, "logit", "r", log_norm="log_norm")
    long = soft.selectExpr("sample_id", "posexplode(r) as (k, v)", "log_norm")
    return long.selectExpr("sample_id", "cast(k as bigint) as k", "round(v, 9) as r", "round(log_norm, 9) as log_norm")


@query("sigmoid_clip", f"""
  select l_orderkey, l_linenumber, round({q.sigmoid('((l_discount - 0.05) * l_extendedprice)')}, 9) as p from lineitem""")
def _(spark, d):
    lines = read(spark, d, "lineitem")
    return lines.selectExpr(
        "l_orderkey", "l_linenumber", f"round({sp.sigmoid_clip('(l_discount - 0.05D) * l_extendedprice')}, 9) as p")


@query("hash_uniform", f"""
  select cast(floor({q.draw('l_orderkey', 'l_linenumber', seed=3)} * 10) as bigint) as tenth, count(*) as n from lineitem group by 1""")
def _(spark, d):
    u = sp.hash_uniform("l_orderkey", "l_linenumber", seed=3)
    drawn = read(spark, d, "lineitem").selectExpr(f"floor({u} * 10) as tenth")
    return drawn.groupBy("tenth").agg(F.count("*").alias("n"))


@query("beta_kl", f"""
  select p_partkey, round({q.beta_kl('p_size', 'p_retailprice', '1.5', '2.0')}, 6) as kl from part""")
def _(spark, d):
    parts = read(spark, d, "part").selectExpr("p_partkey", "cast(p_size as double) as a", "p_retailprice as b")
    return parts.selectExpr("p_partkey", f"round({sp.beta_kl('a', 'b', '1.5D', '2D')}, 6) as kl")


@query("dirichlet_kl", with_sql([SB], f"""
  select sample_id, round({q.lg('count(*)*0.5')} - count(*)*{q.lg('0.5')} - ({q.lg('max(t)')} - sum({q.lg('x')}))
    + sum((x - 0.5) * ({q.dg('x')} - {q.dg('t')})), 6) as kl
  from (select *, sum(x) over (partition by sample_id) as t from sb) group by 1"""))
def _(spark, d):
    return sp.dirichlet_kl(supplier_brand(spark, d), ["sample_id"], "x", 0.5).withColumn("kl", F.round("kl", 6))


# --- starting values --------------------------------------------------------------------


@query("init_from_labels", f"select doc_id as sample_id, k, case when doc_id % 4 = k then 1.0::double else 0.0::double end as r "
       "from documents, (select * from (values (0),(1),(2),(3)) t(k))")
def _(spark, d):
    labels = read(spark, d, "documents").selectExpr("doc_id as sample_id", "doc_id % 4 as label")
    return init_from_labels(labels, 4).selectExpr("sample_id", "posexplode(r) as (k, r)")


def _params(fit: str, **given) -> dict:
    spec = FITS[fit]
    return spec.params(k_max=K, **given)


def _sweeps(fit: str, n: int, per_sample: bool | None = None, beta: float = 1.0) -> q.Sweeps:
    """The SQL twin of ``checks.data.swept``."""
    spec = FITS[fit] if per_sample is None else FITS[fit].per_sample(per_sample)
    out = q.Sweeps(_params(fit), spec.weights, spec.selection, spec.select_first, spec.start, K)
    for i in range(n):
        out.sweep(beta, gated=fit != "ssl_excess" or i > 0)
    return out


def _long_params(state: mx.State, digits: int = 6) -> DataFrame:
    return state.params.selectExpr("feature_id", "posexplode(lam) as (k, lam)", "iota").selectExpr(
        "feature_id", "k", f"round(lam, {digits}) as lam", f"round(iota, {digits}) as iota")


def _params_sql(s: q.Sweeps, digits: int = 6) -> str:
    v = s.v
    return s.select(f"select feature_id, k, round(l.v, {digits}) as lam, round(i.v, {digits}) as iota "
                    f"from lam{v} l join iota{v} i using (feature_id)")


def _long_resp(state: mx.State, digits: int = 6) -> DataFrame:
    return state.resp.selectExpr("sample_id", "posexplode(r) as (k, v)").selectExpr("sample_id", "k", f"round(v, {digits}) as r")


def _resp_sql(s: q.Sweeps, digits: int = 6) -> str:
    return s.select(f"select sample_id, k, round(r, {digits}) as r from r{s.v}")


@query("starting_profiles_mean", _params_sql(_sweeps("dp", 0)))
def _(spark, d):
    return _long_params(swept(spark, d, "dp", 0))


@query("starting_profiles_sum", _params_sql(_sweeps("py_moves", 0)))
def _(spark, d):
    return _long_params(swept(spark, d, "py_moves", 0))


@query("starting_profiles_scaled", _sweeps("dp", 0).select("""
  select feature_id, k, round(greatest(rx/(mass+1e-10) / (w/(mass+1e-10) + 1e-10) * 100 + 1, 1), 6) as lam,
    round(colsum/n / (total/n + 1e-10) * 100 + 1, 6) as iota
  from (select k, feature_id, sum(r*x) as rx from r0 join sb using (sample_id) group by 1, 2)
  join (select k, sum(r) as mass, sum(r*n_i) as w from r0 join smp using (sample_id) group by 1) using (k)
  join ftr using (feature_id) cross join dims"""))
def _(spark, d):
    data = prepared(spark, d)
    resp = init_from_labels(start_labels(data), K)
    models = spark.createDataFrame([(0, K, 1.0, 1.0)], "model_id int, k_live int, zeta double, eta double")
    first = pf.starting_profiles(
        data.features, [0], pf.member_sums(data, resp, K, "all"), pf.membership_totals(data, resp, K), models, "scaled",
        data.n_samples, data.n_features, data.total)
    return first.selectExpr("feature_id", "posexplode(lam) as (k, lam)", "iota").selectExpr(
        "feature_id", "k", "round(lam, 6) as lam", "round(iota, 6) as iota")


# --- mixture weights --------------------------------------------------------------------

# groups of each region: its nations in key order, mass = number of customers
_MASS = """mass as materialized (
  select n_regionkey as model_id, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as k,
    cast(count(c_custkey) as double) as mass
  from nation left join customer on c_nationkey = n_nationkey group by n_regionkey, n_nationkey)"""
_AFTER = "coalesce(sum(mass) over (partition by model_id order by k rows between 1 following and unbounded following), 0)"
_GROUPS = "count(*) over (partition by model_id)"
_STICKS = f"w as materialized (select model_id, k, 1 + mass as a, 0.3 + {_AFTER} as b from mass)"


def _masses(spark, d):
    nations = read(spark, d, "nation").join(read(spark, d, "customer"), F.expr("c_nationkey = n_nationkey"), "left")
    sized = nations.groupBy("n_regionkey", "n_nationkey").agg(F.count("c_custkey").cast("double").alias("mass"))
    return sized.selectExpr(
        "n_regionkey as model_id", "row_number() over (partition by n_regionkey order by n_nationkey) - 1 as k", "mass")


def _weights_query(name: str, sql: str, build):
    def run(spark, d):
        out = build(_masses(spark, d))
        values = [c for c in out.columns if c not in ("model_id", "k")]
        return out.selectExpr("model_id", "cast(k as bigint) as k", *[f"round({c}, 8) as {c}" for c in values])

    query(name, sql)(run)


def _rounded(select: str, *values: str) -> str:
    return f"select model_id, k, {', '.join(f'round({v}, 8) as {v}' for v in values)} from ({select})"


_weights_query("dp_sticks", with_sql([_MASS, _STICKS], _rounded("select * from w", "a", "b")), lambda m: wt.dp_sticks(m, 0.3))
_weights_query("py_sticks", with_sql([_MASS], _rounded(
    f"select model_id, k, 1-0.2+mass as a, 0.7+(k+1)*0.2+{_AFTER} as b from mass", "a", "b")), lambda m: wt.py_sticks(m, 0.2, 0.7))
_weights_query("nig_sticks", with_sql([_MASS], _rounded(
    f"select model_id, k, 0.5+1.0/{_GROUPS}+mass as a, 0.5+1.0/{_GROUPS}+{_AFTER} as b from mass", "a", "b")),
    lambda m: wt.nig_sticks(m, 0.5, 1.0))
_weights_query("mfm_weights", with_sql([_MASS], _rounded(
    f"select model_id, k, 1+2.0/{_GROUPS}+mass as phi from mass", "phi")), lambda m: wt.mfm_weights(m, 1.0, 2.0))
_weights_query("mfm_weights_frozen", with_sql([_MASS], _rounded(
    "select model_id, k, 1+2.0/15+mass as phi from mass", "phi")), lambda m: wt.mfm_weights(m, 1.0, 2.0, frozen_k=15))
_weights_query("stochastic_sticks", with_sql([_MASS], _rounded(
    f"select model_id, k, greatest(0.9*2.0+0.1*(1+4.0*mass), 0.5) as rho, "
    f"greatest(0.9*0.5+0.1*(0.5+4.0*{_AFTER}), 0.1) as tau from mass", "rho", "tau")),
    lambda m: wt.stochastic_sticks(m.selectExpr("model_id", "k", "2D as rho", "0.5D as tau"), m, 0.5, 4.0, 0.2, True))

_ELOG = ("select model_id, k, t + coalesce(sum(l) over (partition by model_id order by k rows between unbounded preceding and 1 "
         "preceding), 0) as elog_pi from (select model_id, k, {0} as t, {1} as l from w)")
_T, _L = f"{q.dg('a')} - {q.dg('(a+b)')}", f"{q.dg('b')} - {q.dg('(a+b)')}"
_CLIPPED = [f"least(greatest({e}, -20), 0)" for e in (_T, _L)]
_weights_query("elog_sticks", with_sql([_MASS, _STICKS], _rounded(_ELOG.format(_T, _L), "elog_pi")),
               lambda m: wt.elog_sticks(wt.dp_sticks(m, 0.3)))
_weights_query("elog_sticks_clipped", with_sql([_MASS, _STICKS], _rounded(_ELOG.format(*_CLIPPED), "elog_pi")),
               lambda m: wt.elog_sticks(wt.dp_sticks(m, 0.3), clipped=True))
_PHI = f"w as materialized (select model_id, k, 1+2.0/{_GROUPS}+mass as phi from mass)"
_weights_query("elog_dirichlet", with_sql([_MASS, _PHI], _rounded(
    f"select model_id, k, {q.dg('phi')} - {q.dg('t')} as elog_pi from (select *, sum(phi) over (partition by model_id) as t from w)",
    "elog_pi")), lambda m: wt.elog_dirichlet(wt.mfm_weights(m, 1.0, 2.0)))
_PRODUCT = (f"select model_id, k, exp(ln(greatest(v, {q.EPS})) + coalesce(sum(ln(greatest(1-v, {q.EPS}))) over (partition by model_id "
            "order by k rows between unbounded preceding and 1 preceding), 0)) as weight from (select *, a/(a+b) as v from w)")
_weights_query("mean_weights_sticks", with_sql([_MASS, _STICKS], _rounded(_PRODUCT, "weight")),
               lambda m: wt.mean_weights(wt.dp_sticks(m, 0.3), "sticks"))
_weights_query("mean_weights_normalised", with_sql([_MASS, _STICKS], _rounded(
    f"select model_id, k, weight / (sum(weight) over (partition by model_id) + {q.EPS}) as weight from ({_PRODUCT})", "weight")),
    lambda m: wt.mean_weights(wt.dp_sticks(m, 0.3).withColumnsRenamed({"a": "rho", "b": "tau"}), "normalised"))
_weights_query("mean_weights_dirichlet", with_sql([_MASS, _PHI], _rounded(
    "select model_id, k, phi / sum(phi) over (partition by model_id) as weight from w", "weight")),
    lambda m: wt.mean_weights(wt.mfm_weights(m, 1.0, 2.0), "dirichlet"))
_weights_query("mean_weights_softmax", with_sql([_MASS, _STICKS], _rounded(
    f"select model_id, k, exp(elog_pi) / sum(exp(elog_pi)) over (partition by model_id) as weight from ({_ELOG.format(_T, _L)})",
    "weight")), lambda m: wt.mean_weights(wt.elog_sticks(wt.dp_sticks(m, 0.3)), "softmax"))


# --- likelihood and memberships ---------------------------------------------------------


def _with_logs(fit: str, n: int) -> q.Sweeps:
    s = _sweeps(fit, n)
    s.expectations()
    return s


def _with_ll(fit: str, n: int, gated: bool = True) -> q.Sweeps:
    s = _with_logs(fit, n)
    s.loglik(gated)
    return s


@query("elog_profiles", _with_logs("dp", 1).select(
    "select feature_id, k, round(a.e, 8) as ea, round(b.e, 8) as eb from ea1 a join eb1 b using (feature_id)"))
def _(spark, d):
    state = swept(spark, d, "dp", 1)
    logs = lk.elog_profiles(state.params, lk.profile_totals(state.params, K))
    return logs.selectExpr("feature_id", "posexplode(ea) as (k, e)", "eb").selectExpr(
        "feature_id", "k", "round(e, 8) as ea", "round(eb, 8) as eb")


def _ll_query(name: str, fit: str, n: int, gated: bool = True):
    def run(spark, d):
        data, state = prepared(spark, d), swept(spark, d, fit, n)
        ll = mx.log_likelihoods(data, FITS[fit], state, mx.models_table(data, state.models), gated)
        rows = ", ".join(f"struct({k} as k, round(ll{k}, 5) as ll)" for k in range(K))
        return ll.selectExpr("sample_id", f"inline(array({rows}))")

    query(name, _with_ll(fit, n, gated).select(f"select sample_id, k, round(l, 5) as ll from ll{n}"))(run)


_ll_query("loglik_shared", "dp", 1)
_ll_query("loglik_per_cluster", "dp_cluster", 1)
_ll_query("loglik_per_sample", "py", 1)
_ll_query("loglik_ssl", "ssl", 1)
_ll_query("loglik_ungated", "ssl_excess", 0, gated=False)


@query("responsibilities", _resp_sql(_sweeps("dp", 1)))
def _(spark, d):
    return _long_resp(swept(spark, d, "dp", 1))


@query("responsibilities_tempered", _resp_sql(_sweeps("dp_thermal", 1, beta=0.01)))
def _(spark, d):
    return _long_resp(swept(spark, d, "dp_thermal", 1, beta=0.01))


def _density_sql(beta: float, share: float, squarings: int = 12, terms: int = 16) -> str:
    """Diagonal of exp(M) by a power series of M / 2^squarings, squared again; M has the ring of groups beside its diagonal.

    M is shifted by its largest row sum, which cancels in the normalised diagonal.
    """
    s = _sweeps("dp_density", 0)
    s.expectations()
    s.loglik()
    off = f"-{beta}*{share}"
    ctes = s.ctes + [
        "h as materialized (select sample_id, k, case when top > 1e-10 then h / top else h end as h from (select *, max(h) over (partition by sample_id) as top "
        "from (select sample_id, k, -(l + lp.e) - min(-(l + lp.e)) over (partition by sample_id) as h from ll0 join lp0 lp using (k))))",
        f"mat as materialized (select a.sample_id, a.k as i, b.k as j, case when a.k = b.k then greatest(-{beta}*(1-{share})*a.h, -500) "
        f"else {off} end as v from h a join h b using (sample_id))",
        "shift as materialized (select sample_id, max(v) as c from (select sample_id, i, sum(case when i = j then v else abs(v) end) as v from mat group by 1, 2) group by 1)",
        f"x0 as materialized (select sample_id, i, j, (v - case when i = j then c else 0 end) / {2.0 ** squarings} as v from mat join shift using (sample_id))",
        "t0 as materialized (select sample_id, i, j, case when i = j then 1.0::double else 0.0::double end as v from x0)",
    ]
    for n in range(1, terms + 1):
        ctes.append(f"t{n} as materialized (select a.sample_id, a.i, b.j, sum(a.v*b.v)/{n} as v from t{n - 1} a join x0 b on a.sample_id = b.sample_id and a.j = b.i group by 1, 2, 3)")
    everything = " union all ".join(f"select * from t{n}" for n in range(terms + 1))
    ctes.append(f"q0 as materialized (select sample_id, i, j, sum(v) as v from ({everything}) group by 1, 2, 3)")
    for n in range(1, squarings + 1):
        ctes.append(f"q{n} as materialized (select a.sample_id, a.i, b.j, sum(a.v*b.v) as v from q{n - 1} a join q{n - 1} b on a.sample_id = b.sample_id and a.j = b.i group by 1, 2, 3)")
    return q.statement(ctes, f"""
      select sample_id, k, round(g / sum(g) over (partition by sample_id), 6) as r from (
        select sample_id, i as k, greatest(v / sum(v) over (partition by sample_id), {q.EPS}) as g from q{squarings} where i = j)""")


@query("responsibilities_density", _density_sql(30.0, 0.5))
def _(spark, d):
    data, state = prepared(spark, d), swept(spark, d, "dp_density", 0)
    resp = mx.memberships(data, FITS["dp_density"], state, 30.0, 0.5)
    return resp.selectExpr("sample_id", "posexplode(r) as (k, v)").selectExpr("sample_id", "k", "round(v, 6) as r")


@query("responsibilities_blend", _sweeps("dp", 1).select(f"""
  select sample_id, k, round(g / sum(g) over (partition by sample_id), 8) as r from (
    select a.sample_id, a.k, greatest(0.4*a.r + 0.6*b.r, {q.EPS}) as g from r1 a join r0 b using (sample_id, k))"""))
def _(spark, d):
    data = prepared(spark, d)
    start = init_from_labels(start_labels(data), K).withColumnRenamed("r", "r0")
    rows = swept(spark, d, "dp", 1).resp.join(start, ["model_id", "sample_id"])
    mixed = lk.blend(rows, "r", "r0", "0.6D", "b")
    return mixed.selectExpr("sample_id", "posexplode(b) as (k, v)").selectExpr("sample_id", "k", "round(v, 8) as r")


# --- selection, profiles, objectives: state after two sweeps of every fit ------------------


def _fit_queries(fit: str, label: str, per_sample: bool | None = None):
    """Memberships, profiles, selection and objective after two sweeps."""
    s = _sweeps(fit, 2, per_sample)
    spec = FITS[fit] if per_sample is None else FITS[fit].per_sample(per_sample)

    query(f"sweep_{label}_memberships", _resp_sql(s))(lambda spark, d: _long_resp(swept(spark, d, fit, 2, per_sample)))
    query(f"sweep_{label}_profiles", _params_sql(s, 5))(lambda spark, d: _long_params(swept(spark, d, fit, 2, per_sample), 5))

    def selection(spark, d):
        state = swept(spark, d, fit, 2, per_sample)
        if spec.selection == "sample":
            return state.cells.selectExpr("sample_id", "feature_id", "round(f, 6) as f")
        if spec.selection == "cluster":
            return state.params.selectExpr("feature_id", "posexplode(f) as (k, v)").selectExpr("feature_id", "k", "round(v, 6) as f")
        return state.params.selectExpr("feature_id", "round(f, 6) as f")

    keys = {"sample": "sample_id, feature_id", "cluster": "feature_id, k"}.get(spec.selection, "feature_id")
    query(f"sweep_{label}_selection", s.select(f"select {keys}, round(f, 6) as f from f2"))(selection)

    value = s.fast_objective()
    if spec.objective == "weights":
        value = f"{value} - {s.weights_kl()} - {s.selection_kl()}"
    elif spec.objective == "ssl":
        xi = f"least(greatest(f, {q.EPS}), 1 - {q.EPS})"
        value += (f" + (select sum(f*ln(theta) + (1-f)*ln(1-theta) - {xi}*ln({xi}) - (1-{xi})*ln(1-{xi})) from f2 cross join th2)"
                  " + (select (bt - 1)*ln(1-theta) from bt cross join th2)")

    def objective(spark, d):
        m = swept(spark, d, fit, 2, per_sample).models[0]
        return spark.createDataFrame([(round(m.elbo, 3),)], "objective double")

    query(f"sweep_{label}_objective", s.select(f"select round({value}, 3) as objective"))(objective)


_fit_queries("dp", "dp")
_fit_queries("dp_cluster", "dp_cluster")
_fit_queries("py", "py")
_fit_queries("py", "py_shared", per_sample=False)
_fit_queries("mfm", "mfm")
_fit_queries("nig", "nig")
_fit_queries("nig", "nig_shared", per_sample=False)
_fit_queries("ssl", "ssl")
_fit_queries("ssl_excess", "ssl_excess")


@query("cluster_sums", _sweeps("dp", 1).select("select feature_id, k, round(rx, 5) as rx from rx1"))
def _(spark, d):
    data = prepared(spark, d)
    sums = pf.cluster_sums(data, swept(spark, d, "dp", 1).resp, K)
    return sums.selectExpr("feature_id", "posexplode(rx) as (k, v)").selectExpr("feature_id", "k", "round(v, 5) as rx")


@query("xi_update", _sweeps("dp", 1).select(
    "select feature_id, round(1 + n*f, 6) as xi1, round(1 + n*(1-f), 6) as xi2 from f1 cross join dims"))
def _(spark, d):
    data, state = prepared(spark, d), swept(spark, d, "dp", 1)
    a, b = sl.xi_update("f", "1D", "1D", sp.num(data.n_samples))
    return state.params.selectExpr("feature_id", f"round({a}, 6) as xi1", f"round({b}, 6) as xi2")


@query("ssl_rate", with_sql([DT], """
  select sum_xi, round(bt, 6) as beta_theta, round((1+sum_xi)/(1+bt+s), 9) as theta from (
    select sum(xi) as sum_xi, count(*) as s, pow(count(*), 1.1)/ln(count(*)) as bt from (
      select feature_id, case when count(*) > 20 then 1.0::double else 0.0::double end as xi from dt group by 1))"""))
def _(spark, d):
    seen = doc_token(spark, d).groupBy("feature_id").agg(F.count("*").alias("n"))
    out = sl.ssl_rate_table(seen.selectExpr("if(n > 20, 1D, 0D) as xi"), "xi", 0.1)
    return out.selectExpr("sum_xi", "round(beta_theta, 6) as beta_theta", "round(theta, 9) as theta")


def _signal_sql() -> q.Sweeps:
    s = _with_logs("ssl_excess", 1)
    s.ctes.append("gg as materialized (select feature_id, sum(m.r_k/n*abs(a.e - b.e)) as g from ea1 a join eb1 b using (feature_id) "
                  "join mass1 m using (k) cross join dims group by 1)")
    return s


def _signal(spark, d) -> DataFrame:
    data, state = prepared(spark, d), swept(spark, d, "ssl_excess", 1)
    return mx._signal(state, mx.models_table(data, state.models))


@query("discriminative_signal", _signal_sql().select("select feature_id, round(g, 8) as g from gg"))
def _(spark, d):
    return _signal(spark, d).selectExpr("feature_id", "round(g, 8) as g")


@query("null_baseline", _signal_sql().select(
    "select feature_id, round(greatest(g - b, 0), 8) as excess from gg cross join (select quantile_cont(g, 0.9) as b from gg)"))
def _(spark, d):
    signal = _signal(spark, d)
    level = sl.exact_quantile(signal, "g", 0.9)
    return signal.selectExpr("feature_id", f"round(greatest(g - {sp.num(level)}, 0D), 8) as excess")


# --- objectives and structure -------------------------------------------------------------


@query("elbo_fast", _sweeps("dp", 2).select(f"select round({_sweeps('dp', 2).fast_objective()}, 3) as elbo"))
def _(spark, d):
    """The light objective from per-sample rows; selection of the round is the shared one."""
    data = prepared(spark, d)
    before, after = swept(spark, d, "dp", 1), swept(spark, d, "dp", 2)
    logs = lk.elog_profiles(before.params, lk.profile_totals(before.params, K)).join(
        after.params.select("model_id", "feature_id", "f"), ["model_id", "feature_id"])
    scores = logs.selectExpr("model_id", "feature_id", f"{lk.blended('shared')} as s").selectExpr(
        "model_id", "feature_id", *lk.unfold("s", "c", K))
    ll = data.with_features(data.cells, scores, K).groupBy("model_id", "sample_id").agg(*lk.weighted_sums(K))
    weights = mx.models_table(data, before.models).select("model_id", "elog_pi")
    rows = ll.join(after.resp, ["model_id", "sample_id"]).join(F.broadcast(weights), "model_id")
    return ob.elbo_fast(rows, K).selectExpr("round(elbo, 3) as elbo")


_GRAM = ("gram as materialized (select a.k as i, b.k as j, sum(a.v*b.v) as dot from lam1 a join lam1 b using (feature_id) group by 1, 2)",
         "cosine as materialized (select g.i, g.j, g.dot/sqrt(a.dot*b.dot) as cosine from gram g join gram a on a.i = g.i and a.j = g.i "
         "join gram b on b.i = g.j and b.j = g.j where g.i < g.j)")


@query("profile_similarity", with_sql(_sweeps("dp", 1).ctes + list(_GRAM), "select i, j, round(cosine, 8) as cosine from cosine"))
def _(spark, d):
    return ob.profile_similarity(swept(spark, d, "dp", 1).params, K).selectExpr("i", "j", "round(cosine, 8) as cosine")


@query("profile_sym_kl", with_sql(
    _sweeps("dp", 1).ctes + [f"p as materialized (select k, feature_id, greatest(v/(sum(v) over (partition by k) + {q.EPS}), {q.EPS}) as p from lam1)"],
    "select a.k as i, b.k as j, round(0.5*sum((a.p-b.p)*(ln(a.p)-ln(b.p))), 8) as sym_kl from p a join p b using (feature_id) "
    "where a.k < b.k group by 1, 2"))
def _(spark, d):
    return ob.profile_sym_kl(swept(spark, d, "dp", 1).params, K).selectExpr("i", "j", "round(sym_kl, 8) as sym_kl")


@query("repulsion", with_sql(_sweeps("dp", 1).ctes + list(_GRAM), "select round(-0.2*sum(cosine*cosine), 8) as repulsion from cosine"))
def _(spark, d):
    return ob.repulsion(swept(spark, d, "dp", 1).params, K, 0.2).selectExpr("round(repulsion, 8) as repulsion")


@query("integrated_likelihood", _sweeps("dp", 2).select(
    f"select round({_sweeps('dp', 2).fast_objective()} + (select p from ent2), 3) as icl"))
def _(spark, d):
    state = swept(spark, d, "dp", 2)
    plogp = ob.membership_parts(state.resp, K).select("plogp")
    return plogp.selectExpr(f"round({sp.num(state.models[0].elbo)} + plogp, 3) as icl")


@query("prune_groups", _sweeps("nig", 1).select("""
  select sample_id, dense_rank() over (order by k) - 1 as k, round(r / sum(r) over (partition by sample_id), 8) as r
  from r1 where k in (select k from (select k, r_k, row_number() over (order by r_k, k) as pos from mass1) where pos > 1)"""))
def _(spark, d):
    """The lightest group removed, memberships scaled to one again."""
    state = swept(spark, d, "nig", 1)
    masses = state.models[0].mass
    lightest = min(range(len(masses)), key=lambda k: (masses[k], k))
    kept = mx.select_groups(state, {0: [k for k in range(len(masses)) if k != lightest]})
    return kept.resp.selectExpr("sample_id", "posexplode(r) as (k, v)").selectExpr(
        "sample_id", "cast(k as bigint) as k", "round(v, 8) as r")


# --- agreement and quality ----------------------------------------------------------------


def _sources(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("label"))


_PAIRS = "pairs as materialized (select lang as a, source as b, count(*) as n from documents group by 1, 2)"
_C2 = "n*(n-1)/2.0"
_ARI = f"""(select (c - r*s/t) / ((r + s)/2 - r*s/t) from (
  select (select sum({_C2}) from pairs) as c,
    (select sum({_C2}) from (select a, sum(n) as n from pairs group by 1)) as r,
    (select sum({_C2}) from (select b, sum(n) as n from pairs group by 1)) as s,
    (select sum(n)*(sum(n)-1)/2.0 from pairs) as t))"""


@query("contingency", with_sql([_PAIRS], "select a, b, n from pairs"))
def _(spark, d):
    return mt.contingency(_languages(spark, d), _sources(spark, d))


@query("adjusted_rand", with_sql([_PAIRS], f"select round(cast({_ARI} as double), 9) as ari"))
def _(spark, d):
    return mt.ari(_languages(spark, d), _sources(spark, d)).selectExpr("round(ari, 9) as ari")


@query("mutual_information", with_sql([_PAIRS, "tot as (select sum(n) as t from pairs)"], """
  select round((ha + hb - hab) / ((ha + hb)/2), 9) as nmi from (
    select (select -sum(n/t*ln(n/t)) from pairs, tot) as hab,
      (select -sum(n/t*ln(n/t)) from (select sum(n) as n from pairs group by a), tot) as ha,
      (select -sum(n/t*ln(n/t)) from (select sum(n) as n from pairs group by b), tot) as hb)"""))
def _(spark, d):
    return mt.nmi(_languages(spark, d), _sources(spark, d)).selectExpr("round(nmi, 9) as nmi")


@query("confusion", with_sql([_PAIRS], """
  select a, b, cast(coalesce(n, 0) as bigint) as n, round(coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by a), 9) as share
  from (select distinct a from pairs) cross join (select distinct b from pairs) left join pairs using (a, b)"""))
def _(spark, d):
    return mt.confusion(_languages(spark, d), _sources(spark, d)).withColumn("share", F.round("share", 9))


def _vec_labels(spark, d):
    e = read(spark, d, "embeddings")
    return (e.selectExpr("vec_id as sample_id", "label"), e.selectExpr("vec_id as sample_id", "cast(vec_id % 7 as int) as label"))


@query("size_comparison", """
  select cast(i as int) as label, (select count(*) from embeddings where label = i) as n_true,
    (select count(*) from embeddings where vec_id % 7 = i) as n_predicted
  from (select unnest(range(0, (select greatest(max(label), max(vec_id % 7)) + 1 from embeddings))) as i)""")
def _(spark, d):
    return mt.size_comparison(*_vec_labels(spark, d))


@query("quality_proxy", _sweeps("mfm", 2).select("""
  select round(c, 8) as confidence, round(s, 8) as sharpness, round(b, 8) as balance, round((c+s+b)/3, 8) as quality from (
    select avg(peak) as c, 1 - avg(h)/ln(3.0) as s,
      (select least(greatest(1 - stddev_pop(m)*sqrt(3.0), 0), 1) from (select sum(r)/(select sum(r)+1e-10 from r2) as m from r2 group by k)) as b
    from (select sample_id, max(r) as peak, -sum(r*ln(r + 1e-10)) as h from r2 group by 1))"""))
def _(spark, d):
    out = mt.quality_proxy(swept(spark, d, "mfm", 2).resp, K)
    return out.selectExpr(*[f"round({c}, 8) as {c}" for c in ("confidence", "sharpness", "balance", "quality")])


@query("selection_scores", with_sql([DT, "lang as (select doc_id as sample_id, lang from documents)"], """
  select tp, fp, fn, tp/greatest(tp+fp, 1) as precision, tp/greatest(tp+fn, 1) as recall,
    round(2.0*(tp/greatest(tp+fp,1))*(tp/greatest(tp+fn,1))/greatest(tp/greatest(tp+fp,1) + tp/greatest(tp+fn,1), 1e-10), 9) as f1 from (
    select count(*) filter (f is not null and t is not null) as tp, count(*) filter (f is not null and t is null) as fp,
      count(*) filter (f is null and t is not null) as fn from
      (select distinct feature_id as f from dt join lang using (sample_id) where lang = 'de') full join
      (select distinct feature_id as t from dt join lang using (sample_id) where lang = 'fr') on f = t)"""))
def _(spark, d):
    spoken = doc_token(spark, d).join(_languages(spark, d), "sample_id")
    return mt.selection_scores(spoken.where("label = 'de'"), spoken.where("label = 'fr'")).withColumn("f1", F.round("f1", 9))


@query("verdict", with_sql([_PAIRS], f"""
  select round(cast(ari as double), 9) as ari, case when ari >= 0.8 then 'excellent' when ari >= 0.6 then 'good' when ari >= 0.4 then 'fair'
    else 'poor' end as verdict from (select {_ARI} as ari)"""))
def _(spark, d):
    return mt.verdict(mt.ari(_languages(spark, d), _sources(spark, d))).withColumn("ari", F.round("ari", 9))


def _agreement_sql() -> str:
    cols = {"priority": "o_orderpriority", "status": "o_orderstatus", "year": "cast(year(o_orderdate) as varchar)"}
    names, parts = list(cols), []
    for i, p in enumerate(names):
        for r in names[i + 1:]:
            ari = _ARI.replace("pairs", f"p_{p}_{r}")
            parts.append((f"p_{p}_{r} as materialized (select {cols[p]} as a, {cols[r]} as b, count(*) as n from orders group by 1, 2)",
                          f"select '{p}' as label_a, '{r}' as label_b, cast((select sum(n) from p_{p}_{r}) as bigint) as n, "
                          f"cast((select coalesce(sum(n), 0) from p_{p}_{r} where a = b) as bigint) as n_equal, round(cast({ari} as double), 9) as ari"))
    return with_sql([c for c, _ in parts], " union all ".join(s for _, s in parts))


@query("label_agreement", _agreement_sql())
def _(spark, d):
    labels = read(spark, d, "orders").selectExpr(
        "o_orderpriority as priority", "o_orderstatus as status", "cast(year(o_orderdate) as string) as year")
    return mt.label_agreement(labels, ["priority", "status", "year"]).selectExpr(
        "label_a", "label_b", "n", "n_equal", "round(ari, 9) as ari")


_UE_NORM = [UE, "l as materialized (select sample_id, feature_id, ln(1+x) as v from ue)",
            "lab as materialized (select distinct sample_id, cast(sample_id % 3 as int) as g from ue)",
            "sq as materialized (select sample_id, sum(v*v) as sq from l group by 1)"]


def _silhouette_ctes(distance: str) -> list[str]:
    return [
        "dots as materialized (select a.sample_id as i, b.sample_id as j, sum(a.v*b.v) as dot from l a join l b using (feature_id) group by 1, 2)",
        f"dist as materialized (select s.sample_id as i, t.sample_id as j, {distance} as d from sq s cross join sq t "
        "left join dots on dots.i = s.sample_id and dots.j = t.sample_id where s.sample_id <> t.sample_id)",
        "per as materialized (select i, a.g as own, b.g as g, avg(d) as m from dist join lab a on a.sample_id = i join lab b on b.sample_id = j group by 1, 2, 3)",
        "sil as (select i, max(case when own = g then m end) as a, min(case when own <> g then m end) as b from per group by 1)",
    ]


def _silhouette_sql(distance: str) -> str:
    return with_sql(_UE_NORM + _silhouette_ctes(distance), "select round(avg((b - a)/greatest(a, b)), 7) as silhouette from sil")


@query("silhouette_exact", _silhouette_sql("sqrt(greatest(s.sq + t.sq - 2*coalesce(dot, 0), 0))"))
def _(spark, d):
    data = prepared(spark, d, "user_event")
    return mt.silhouette(data, start_labels(data)).selectExpr("round(silhouette, 7) as silhouette")


@query("silhouette_squared", _silhouette_sql("greatest(s.sq + t.sq - 2*coalesce(dot, 0), 0)"))
def _(spark, d):
    data = prepared(spark, d, "user_event")
    return mt.silhouette_squared(data, start_labels(data)).selectExpr("round(silhouette, 7) as silhouette")


@query("project_2d")
def _(spark, d):
    return mt.project_2d(prepared(spark, d, "user_event"))


@query("library_sizes_by_user", with_sql([UE], "select sample_id, sum(x) as n_i from ue group by 1"))
def _(spark, d):
    return prep.library_sizes(user_event(spark, d))
