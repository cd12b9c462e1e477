"""A whole fit as one recursive SQL statement: a state keyed by round, from the start to the fit's own stop.

Each step of the recursion is one round: memberships, selection, profiles, background, weights, objective, pruning,
freezing, averaging and the stop rule. The state is one long table, ``st(t, kind, s, id, k, a, b, c, d)``:

    lam   id feature, k group        a profile, b selection of the group
    ftr   id feature                 a background, b selection, c sum of averaged selections
    cel   s sample, id feature       a selection, b count (fits with a selection per sample)
    w     k group                    a, b stick or Dirichlet parameters, c expected log weight, d mass
    r     s sample, k group          a membership
    his   k round                    a objective, b number of groups
    win   k number of the average    a inclusion rate
    ctl   id name                    a value: pruned, theta, zero, level, frozen, count, done, iter
"""

from __future__ import annotations

from checks.sql import EPS, beta_kl, dg, lg, sigmoid

LETTERS = """cnt as materialized (
  select sample_id, feature_id, cast(count(*) as double) as x from (
    select doc_id as sample_id, left(unnest(regexp_extract_all(lower(text), '[a-z]+')), 1) as feature_id from documents)
  group by 1, 2)"""

_ROW = "t, kind, s, id, k, a, b, c, d"


class WholeFit:
    """The statement for one conjugate fit over ``cnt``; groups start from ``sample_id % k_max``."""

    def __init__(self, spec, p: dict):
        self.spec, self.p, self.sel = spec, p, spec.selection

    # --- parts --------------------------------------------------------------------------

    def _weights(self, mass: str, live: str) -> str:
        """select k, a, b, r_k from a table of masses (k from 0, without gaps)."""
        p, kind = self.p, self.spec.weights
        after = "coalesce(sum(r_k) over (order by k rows between 1 following and unbounded following), 0)"
        a, b = {
            "dp": ("1.0 + r_k", f"{p['nu']} + {after}"),
            "py": (f"(1.0-{p['d']}) + r_k", f"{p['theta']} + (k+1)*{p['d']} + {after}"),
            "nig": (f"(1.0-{p['sigma']}) + {p['alpha']}/{live} + r_k", f"(1.0-{p['sigma']}) + {p['alpha']}/{live} + {after}"),
            "mfm": (f"{p['delta']} + {p['gamma']}/{live} + r_k", "0.0"),
        }[kind]
        return f"select k, {a} as a, {b} as b, r_k from {mass}"

    def _elog(self, table: str) -> str:
        """The table (k, a, b, r_k) with the expected log weights ``lp``."""
        if self.spec.weights == "mfm":
            return f"select k, a, b, r_k, {dg('a')} - {dg('tot')} as lp from (select *, sum(a) over () as tot from {table})"
        return (f"select k, a, b, r_k, el + coalesce(sum(er) over (order by k rows between unbounded preceding and 1 preceding), 0) as lp "
                f"from (select *, {dg('a')} - {dg('(a+b)')} as el, {dg('b')} - {dg('(a+b)')} as er from {table})")

    def _means(self, table: str) -> str:
        """select k, r_k, weight; ``old`` is the expected log weight that a NIG prior judges by."""
        kind = self.spec.weights
        if kind == "mfm":
            return f"select k, r_k, a / sum(a) over () as weight from {table}"
        if kind == "nig":
            return f"select k, r_k, exp(old - max(old) over ()) / sum(exp(old - top)) over () as weight from (select *, max(old) over () as top from {table})"
        before = "coalesce(sum(ln(greatest(1-a/(a+b), 1e-10))) over (order by k rows between unbounded preceding and 1 preceding), 0)"
        return f"select k, r_k, exp(ln(greatest(a/(a+b), 1e-10)) + {before}) as weight from {table}"

    def _kept(self, table: str, where: str) -> str:
        """select old_k, k: the groups that stay, numbered anew; all of them unless ``where``."""
        p = self.p
        size = f"greatest(1.0, n/(5.0*{p['k_max']}))" if self.spec.min_size == "adaptive" else "1.0"
        return (f"select k as old_k, row_number() over (order by k) - 1 as k from ("
                f"select k, pass, sum(case when pass then 1 else 0 end) over () as passed, row_number() over (order by weight desc, k) as pos, asked "
                f"from (select m.*, weight > {p['prune_threshold']} and r_k > {size} as pass, {where} as asked from ({self._means(table)}) m, c)) "
                f"where not asked or case when passed < {p['min_clusters']} then pos <= {p['min_clusters']} else pass end")

    def _start(self) -> list[str]:
        """The state before the first round, named ``begin``."""
        p, k = self.p, self.p["k_max"]
        z, e = p["zeta"], p["eta"]
        ctes = [
            f"ks as materialized (select unnest(range({k}))::int as k)",
            "dims as materialized (select cast(count(distinct sample_id) as double) as n, cast(count(distinct feature_id) as double) as s, "
            "sum(x) as total, cast(count(*) as double) as nnz from cnt)",
            "ftr as materialized (select feature_id, sum(x) as colsum from cnt group by 1)",
            f"smp as materialized (select sample_id, (sample_id % {k})::int as k, sum(x) as n_i from cnt group by 1, 2)",
            "mem as materialized (select ks.k, count(sample_id)::double as n_k, coalesce(sum(n_i), 0) as tot from ks left join smp using (k) group by 1)",
            "sx as materialized (select smp.k, feature_id, sum(x) as sx from smp join cnt using (sample_id) group by 1, 2)",
        ]
        prior = {"dp": f"1.0 as a, {p['nu']} as b", "py": f"1.0-{p['d']} as a, {p['theta']} + (k+1)*{p['d']} as b"}
        if self.spec.weights in prior:
            ctes.append(f"w0 as materialized (select k, {prior[self.spec.weights]}, n_k as r_k from mem)")
        else:
            ctes.append(f"m0 as materialized (select k, n_k as r_k from mem)")
            ctes.append(f"w0 as materialized ({self._weights('m0', str(float(k)))})")
        theta, f0 = "0.0", f"{p.get('f0', 0.3)}"
        if self.sel.startswith("ssl"):
            ctes.append(f"bt as materialized (select pow(greatest(s,2), {1 + p['kappa']})/ln(greatest(s,2)) as bt from dims)")
            theta = "(select 1.0/(1.0+bt) from bt)"
            f0 = f"{p['init_xi']}" if self.sel == "ssl" else f"greatest({theta}, 1e-3)"
        else:
            ctes.append("bt as materialized (select 0.0 as bt)")
        lam = f"greatest((coalesce(sx,0)/n_k + 0.5)/(tot/n_k + 0.5*s)*{z}*s, 0.1)"
        iota = f"greatest((colsum/n + 0.5)/(total/n + 0.5*s)*{e}*s, 0.1)"
        none = "null::double"
        rows = [
            f"select 0 as t, 'lam' as kind, null::bigint as s, f.feature_id as id, m.k as k, {lam} as a, {f0} as b, {none} as c, {none} as d "
            "from mem m cross join ftr f cross join dims left join sx on sx.k = m.k and sx.feature_id = f.feature_id",
            f"select 0, 'ftr', null, feature_id, null, {iota}, {f0}, 0.0, null from ftr, dims",
            f"select 0, 'w', null, null, k, a, b, lp, r_k from ({self._elog('w0')})",
            *[f"select 0, 'ctl', null, '{name}', null, {value}, null, null, null" for name, value in (
                ("pruned", "0.0"), ("theta", theta), ("zero", f0), ("level", "0.0"), ("frozen", "0.0"), ("count", "0.0"),
                ("done", "0.0"), ("iter", "0.0"))],
        ]
        if self.sel == "sample":
            rows.append(f"select 0, 'cel', sample_id, feature_id, null, {f0}, x, null, null from cnt")
        typed = ("t::int as t, kind::varchar as kind, s::bigint as s, id::varchar as id, k::int as k, a::double as a, "
                 "b::double as b, c::double as c, d::double as d")
        return ctes + [f"begin as materialized (select {typed} from (" + "\n  union all ".join(rows) + "))"]

    def _beta(self) -> str:
        p = self.p
        if self.spec.anneal != "thermal":
            return "1.0"
        b0, t1, t2 = p["beta0"], p["tau1"], p["tau2"]
        return (f"(case when t - 1 <= {t1} then {b0} when t - 1 <= {t2} then 1.0 + ({b0} - 1.0)*({t2} - (t - 1))/{float(t2 - t1)} else 1.0 end)")

    def _quantile(self, signal: str, theta: str) -> str:
        """Interpolated quantile of a signal (g) at the level the inclusion rate asks for."""
        q = f"least(greatest(1 - least(greatest(3*{theta}, 0.05), 0.4), 0.5), 0.9)"
        return (f"(select sum(case when i = floor(h) then g*(1-(h-floor(h))) when i = floor(h)+1 then g*(h-floor(h)) else 0 end) "
                f"from (select g, row_number() over (order by g) - 1 as i, (count(*) over () - 1)*{q} as h from {signal}))")

    def _round(self) -> list[str]:
        """One round from ``st``: the tables of the next state."""
        p, sel, x1, x2 = self.p, self.sel, self.p["xi_1"], self.p["xi_2"]
        ctl = ", ".join(f"max(a) filter (id = '{name}') as {name}" for name in
                        ("pruned", "theta", "zero", "level", "frozen", "count", "done"))
        burn = p.get("burn_in", 0)
        excess = sel == "ssl_excess"
        flags = f"t > {burn} as gated, t >= {burn + 10} as averaging" if excess else "true as gated, false as averaging"
        out = [
            f"ctl as materialized (select max(t) + 1 as t, {ctl.replace('filter (', 'filter (where ')} from st where kind = 'ctl' "
            f"having max(a) filter (where id = 'done') = 0 and max(t) < {p['max_iter']})",
            f"c as materialized (select *, {self._beta()} as beta, t > 1 as started, {flags} from ctl, dims, bt)",
            "lam as materialized (select id as feature_id, k, a as v, b as f from st where kind = 'lam')",
            "par as materialized (select id as feature_id, a as v, b as f, c as f_sum from st where kind = 'ftr')",
            "w as materialized (select k, a, b, c as lp, d as r_k from st where kind = 'w')",
            f"ea as materialized (select k, feature_id, f, {dg('v')} - {dg('tot')} as e from (select *, sum(v) over (partition by k) as tot from lam))",
            f"eb as materialized (select feature_id, f, f_sum, {dg('v')} - {dg('tot')} as e from (select *, sum(v) over () as tot from par))",
        ]
        if sel == "sample":
            out.append("cel as materialized (select s as sample_id, id as feature_id, a as f, b as x from st where kind = 'cel')")
            out.append("ll as materialized (select f.sample_id, a.k, sum(f.x*(f.f*a.e + (1-f.f)*b.e)) as l from cel f join ea a using (feature_id) "
                       "join eb b using (feature_id) group by 1, 2)")
        else:
            f = "a.f" if sel == "cluster" else "b.f"
            out.append(f"sc as materialized (select a.k, feature_id, case when gated then {f}*a.e + (1-{f})*b.e else a.e end as e "
                       "from ea a join eb b using (feature_id), c)")
            out.append("ll as materialized (select sample_id, sc.k, sum(x*e) as l from cnt join sc using (feature_id) group by 1, 2)")
        out += [
            f"r1 as materialized (select sample_id, k, g / sum(g) over (partition by sample_id) as r from ("
            f"select sample_id, k, greatest(e / sum(e) over (partition by sample_id), {EPS}) as g from ("
            f"select sample_id, k, exp(l - max(l) over (partition by sample_id)) as e from ("
            f"select sample_id, k, beta*(l + lp) as l from ll join w using (k), c))))",
            f"mass1 as materialized (select k, sum(r) as r_k, sum(r*ln(greatest(r, {EPS}))) as p from r1 group by 1)",
            "live as materialized (select count(*)::double as g from mass1)",
            f"w1 as materialized ({self._elog('(' + self._weights('mass1', '(select g from live)') + ')')})",
        ]
        if sel == "sample":
            a, b = f"case when started then {x1} + f.f else {x1} end", f"case when started then {x2} + 1 - f.f else {x2} end"
            out.append("own as materialized (select r.sample_id, a.feature_id, sum(r.r*a.e) as own from r1 r join ea a using (k) group by 1, 2)")
            odds = f"{dg('xa')} - {dg('xb')} + x*(own - be)"
            out.append(f"cel1 as materialized (select sample_id, feature_id, x, f as old, own, be, {sigmoid(odds)} as f from ("
                       f"select f.sample_id, f.feature_id, f.x, f.f, o.own, b.e as be, {a} as xa, {b} as xb from cel f "
                       f"join own o using (sample_id, feature_id) join eb b using (feature_id), c))")
            used = "f.f" if self.spec.select_first else "f.old"
            out.append(f"lam1 as materialized (select r.k, f.feature_id, greatest({p['zeta']} + sum(r.r*{used}*f.x), 0.1) as v, null::double as f "
                       f"from cel1 f join r1 r using (sample_id) group by 1, 2)")
            out.append(f"par1 as materialized (select feature_id, greatest({p['eta']} + sum((1-{used})*f.x), 0.1) as v, null::double as f, "
                       f"null::double as f_sum from cel1 f group by 1)")
            out.append("fit1 as materialized (select sum(x*(f*own + (1-f)*be)) as fit from cel1)")
            za, zb = f"(case when started then {x1} + zero else {x1} end)", f"(case when started then {x2} + 1 - zero else {x2} end)"
            out.append(f"zero1 as materialized (select {sigmoid(f'{dg(za)} - {dg(zb)}')} as zero from c)")
            one = lambda f: beta_kl(f"({x1}+{f})", f"({x2}+1-{f})", f"{x1}", f"{x2}")
            out.append(f"kl1 as materialized (select (select sum({one('f')}) from cel1) + (n*s - nnz)*{one('zero1.zero')} as kl from c, zero1)")
        else:
            out.append("rx as materialized (select r.k, cnt.feature_id, sum(r.r*cnt.x) as rx from r1 r join cnt using (sample_id) group by 1, 2)")
            if sel == "cluster":
                a, b = f"case when started then {x1} + n*f else {x1} end", f"case when started then {x2} + n*(1-f) else {x2} end"
                out.append(f"f1 as materialized (select k, feature_id, rx, e, be, {sigmoid(f'{dg('xa')} - {dg('xb')} + rx*(e - be)')} as f from ("
                           f"select a.k, feature_id, rx, a.e, b.e as be, {a.replace('*f', '*a.f').replace('-f', '-a.f')} as xa, "
                           f"{b.replace('-f', '-a.f')} as xb from ea a join rx using (k, feature_id) join eb b using (feature_id), c))")
                out.append(f"lam1 as materialized (select k, feature_id, greatest({p['zeta']} + f*rx, 0.1) as v, f from f1)")
                out.append(f"par1 as materialized (select feature_id, greatest({p['eta']} + sum((1-f)*rx), 0.1) as v, null::double as f, "
                           "null::double as f_sum from f1 group by 1)")
                out.append("fit1 as materialized (select sum(rx*(f*e + (1-f)*be)) as fit from f1)")
            else:
                if excess:
                    out.append("g1 as materialized (select a.feature_id, sum(m.r_k/n*abs(a.e - b.e)) as g from ea a join eb b using (feature_id) "
                               "join mass1 m using (k), c group by 1)")
                    out.append("g0 as materialized (select a.feature_id, sum(m.r_k/n*abs(a.e - b.e)) as g from ea a join eb b using (feature_id) "
                               "join w m using (k), c group by 1)")
                    out.append(f"lev as materialized (select case when frozen = 1 then level when averaging then {self._quantile('g0', 'theta')} "
                               f"else {self._quantile('g1', 'theta')} end as level, frozen = 1 or averaging as frozen from c)")
                    odds = f"ln({p['l1']}/{p['l0']}) + ({p['l0']}-{p['l1']})*greatest(g - lev.level, 0) + ln(theta/(1-theta))"
                    ema = f"case when lev.frozen then 1.0 else {p['xi_ema']} end"
                    new = f"least(greatest(({ema})*{sigmoid(odds)} + (1-({ema}))*b.f, {EPS}), 1-{EPS})"
                    out.append(f"f1 as materialized (select b.feature_id, b.e as be, f_sum, {new} as f from g1 join eb b using (feature_id), c, lev)")
                    out.append(f"lam1 as materialized (select k, feature_id, greatest({p['zeta']} + rx, 0.1) as v, null::double as f from rx)")
                    rest = "case when gated then (1-f1.f)*colsum else colsum end"
                else:
                    out.append("sig as materialized (select x.feature_id, sum(x.rx*a.e) - max(t.colsum*b.e) as s from rx x "
                               "join ea a on a.k = x.k and a.feature_id = x.feature_id join eb b on b.feature_id = x.feature_id "
                               "join ftr t on t.feature_id = x.feature_id group by 1)")
                    if sel == "ssl":
                        odds = (f"sig.s + ln({p['l1']}/{p['l0']}) + ({p['l0']}-{p['l1']})*greatest(sig.s, 0) + ln(theta/(1-theta))")
                    else:
                        odds = f"{dg('xa')} - {dg('xb')} + sig.s"
                    out.append(f"f1 as materialized (select feature_id, be, 0.0 as f_sum, {sigmoid(odds)} as f from ("
                               f"select feature_id, e as be, case when started then {x1} + n*f else {x1} end as xa, "
                               f"case when started then {x2} + n*(1-f) else {x2} end as xb from eb, c) join sig using (feature_id), c)")
                    out.append(f"lam1 as materialized (select k, feature_id, greatest({p['zeta']} + f*rx, 0.1) as v, null::double as f "
                               "from f1 join rx using (feature_id))")
                    rest = "(1-f1.f)*colsum"
                out.append(f"par1 as materialized (select f1.feature_id, greatest({p['eta']} + {rest}, 0.1) as v, f1.f, "
                           "case when averaging then f_sum + f1.f else f_sum end as f_sum from f1 join ftr using (feature_id), c)")
                out.append("fit1 as materialized (select sum(x.rx*(f1.f*a.e + (1-f1.f)*be)) as fit from rx x join f1 using (feature_id) "
                           "join ea a using (k, feature_id))")
        if sel.startswith("ssl"):
            out.append(f"xi1 as materialized (select least(greatest((1 + sum(f))/(1 + max(bt) + count(*)), {EPS}), 1-{EPS}) as theta, sum(f) as xi, "
                       "sum(-f*ln(f) - (1-f)*ln(1-f)) as entropy from f1, bt)")
        else:
            out.append("xi1 as materialized (select theta, 0.0 as xi, 0.0 as entropy from c)")
        return out

    def _terms(self, fit: str, w: str, masses: str, logs: str) -> str:
        """The fit's objective from a scalar fit, a table of weights, one of masses (k, r_k, p) and one of logs (k, lp)."""
        p, kind = self.p, self.spec.weights
        value = (f"{fit} + (select sum(m.r_k*l.lp) from {masses} m join {logs} l using (k)) - (select sum(p) from {masses})")
        if self.spec.objective == "weights":
            if kind == "mfm":
                de = f"({p['delta']} + {p['gamma']}/cnt_k)"
                kl = (f"(select max({lg(f'{de}*cnt_k')}) - max(cnt_k*{lg(de)}) - (max({lg('tot')}) - sum({lg('a')})) "
                      f"+ sum((a-{de})*({dg('a')} - {dg('tot')})) from (select a, sum(a) over () as tot, (count(*) over ())::double as cnt_k from {w}))")
            else:
                a0, b0 = ((f"(1.0-{p['sigma']})",) * 2 if kind == "nig" else (f"(1.0-{p['d']})", f"({p['theta']}+(k+1)*{p['d']})"))
                kl = f"(select sum({beta_kl('a', 'b', a0, b0)}) from {w})"
            value += f" - {kl} - (select kl from kl1)"
        elif self.spec.objective == "ssl":
            value += (" + (select xi*ln(theta) + (s - xi)*ln(1-theta) + entropy + (bt - 1)*ln(1-theta) from "
                      f"(select xi, entropy, xi1.theta, s, bt from xi1, c))")
        return f"({value})"

    def _prune(self) -> list[str]:
        """Pruning, the objective of scored rounds and the stop rule."""
        p, sel = self.p, self.sel
        start = p["prune_start"]
        window = f"t >= {start} and t % {p['prune_every']} = 0"
        if sel == "ssl_excess":
            window += " and gated and not averaging"
        out = [
            "judged as materialized (select w1.k, w1.a, w1.b, w1.r_k, w1.lp, w.lp as old from w1 join w using (k))",
            f"kept as materialized ({self._kept('judged', window)})",
            "cut as materialized (select (select count(*) from kept) < (select count(*) from w1) as cut from c)",
            "r2 as materialized (select sample_id, kept.k, case when cut then r / sum(r) over (partition by sample_id) else r end as r "
            "from r1 join kept on r1.k = old_k, cut)",
            f"mass2 as materialized (select k, sum(r) as r_k, sum(r*ln(greatest(r, {EPS}))) as p from r2 group by 1)",
        ]
        if self.spec.weights == "nig":
            again = self._weights("mass2", "(select count(*)::double from kept)")
            out.append(f"moved as materialized (select m.k, case when cut then m.a else w1.a end as a, case when cut then m.b else w1.b end as b, m.r_k "
                       f"from ({again}) m join kept using (k) join w1 on w1.k = old_k, cut)")
        else:
            out.append("moved as materialized (select kept.k, a, b, mass2.r_k from w1 join kept on w1.k = old_k join mass2 on mass2.k = kept.k)")
        out += [
            f"w2 as materialized ({self._elog('moved')})",
            "lam2 as materialized (select kept.k, feature_id, v, f from lam1 join kept on lam1.k = old_k)",
            f"ea2 as materialized (select k, feature_id, f, {dg('v')} - {dg('tot')} as e from (select *, sum(v) over (partition by k) as tot from lam2))",
            f"eb2 as materialized (select feature_id, f, {dg('v')} - {dg('tot')} as e from (select *, sum(v) over () as tot from par1))",
        ]
        if sel == "sample":
            fresh = ("select sum(x*r*(f.f*a.e + (1-f.f)*b.e)) from cel1 f join r2 using (sample_id) "
                     "join ea2 a on a.k = r2.k and a.feature_id = f.feature_id join eb2 b on b.feature_id = f.feature_id")
        else:
            f = "a.f" if sel == "cluster" else "b.f"
            fresh = (f"select sum(x*r*({f}*a.e + (1-{f})*b.e)) from cnt join r2 using (sample_id) "
                     "join ea2 a on a.k = r2.k and a.feature_id = cnt.feature_id join eb2 b on b.feature_id = cnt.feature_id")
        now, anew = self._terms("(select fit from fit1)", "w1", "mass1", "w"), self._terms(f"({fresh})", "w2", "mass2", "w2")
        out.append(f"score as materialized (select t as k, case when cut then {anew} else {now} end as a, (select count(*)::double from kept) as b "
                   "from c, cut where t % 10 = 0)")
        out.append("his as materialized (select k, a, b from st where kind = 'his' union all select * from score)")
        out.append("win as materialized (select k, a from st where kind = 'win' union all select (count + 1)::int, xi1.theta from c, xi1 where averaging)")
        if self.spec.stop == "rate":
            rule = ("count + 1 >= 10 and (count + 1) % 5 = 0 and (select count(*) from win) >= 20 and (select abs(new - old)/(abs(old) + 1e-12) from "
                    "(select avg(a) filter (where nth <= 10) as new, avg(a) filter (where nth between 11 and 20) as old from "
                    f"(select a, row_number() over (order by k desc) as nth from win))) < {p['tol']}")
            rule = f"averaging and {rule}"
        else:
            allowed = {"pruned": "(pruned = 1 or cut)", "after_start": f"t > {start}",
                       "after_anneal": f"(pruned = 1 or cut) and t > {p.get('tau2', 0)}"}[self.spec.stop]
            rule = (f"t % 10 = 0 and (select count(*) from his) >= 3 and {allowed} and (select max(change) from "
                    "(select abs(a - before)/(abs(a) + 1e-10) as change, row_number() over (order by k desc) as nth from "
                    f"(select k, a, lag(a) over (order by k) as before from his)) where nth <= 2) < {p['tol']}")
        out.append(f"stop as materialized (select case when {rule} then 1.0 else 0.0 end as done from c, cut)")
        return out

    def _next(self) -> str:
        """The rows of the next state."""
        level = ("lev.level", "lev.frozen::int::double") if self.sel == "ssl_excess" else ("level", "frozen")
        zero = "zero1.zero" if self.sel == "sample" else "c.zero"
        extra = (", lev" if self.sel == "ssl_excess" else "") + (", zero1" if self.sel == "sample" else "")
        named = {"pruned": "case when cut then 1.0 else pruned end", "theta": "xi1.theta", "zero": zero, "level": level[0], "frozen": level[1],
                 "count": "case when averaging then count + 1 else count end", "done": "stop.done", "iter": "t::double"}
        rows = [
            "select t, 'lam' as kind, null::bigint as s, feature_id as id, k::int as k, v as a, f as b, null::double as c, null::double as d from lam2, c",
            "select t, 'ftr', null, feature_id, null, v, par1.f, f_sum, null from par1, c",
            "select t, 'w', null, null, w2.k::int, a, w2.b, lp, r_k from w2, c",
            "select t, 'r', sample_id, null, r2.k::int, r, null, null, null from r2, c",
            "select t, 'his', null, null, his.k::int, his.a, his.b, null, null from his, c",
            "select t, 'win', null, null, win.k::int, win.a, null, null, null from win, c",
        ]
        if self.sel == "sample":
            rows.append("select t, 'cel', sample_id, feature_id, null, f, x, null, null from cel1, c")
        names, values = ", ".join(f"'{n}'" for n in named), ", ".join(f"({v})::double" for v in named.values())
        rows.append(f"select t, 'ctl', null, id, null, a, null, null, null from (select t, unnest([{names}]) as id, unnest([{values}]) as a "
                    f"from c, cut, xi1, stop{extra})")
        return "\n    union all ".join(rows)

    def select(self, body: str, counts: str = LETTERS) -> str:
        """``body`` over ``fin(t, ...)``, the last state, ``kept``, the groups its last pruning leaves, and ``r``, their
        memberships."""
        body_of_round = ",\n    ".join(self._round() + self._prune())
        last = [
            "fin as materialized (select st.* from st, (select max(t) as last from st) where t = last)",
            "c as materialized (select * from dims)",
            "before as materialized (select k, c as lp from st, (select max(t) as last from st) where t = last - 1 and kind = 'w')",
            # the last round's logs stay in use unless its pruning renewed them
            "judged as materialized (select k, a, b, d as r_k, c as lp, case when (select count(*) from before) = count(*) over () "
            "then before.lp else c end as old from (select * from fin where kind = 'w') left join before using (k))",
            f"kept as materialized ({self._kept('judged', 'true')})",
            "r as materialized (select s as sample_id, kept.k, a / sum(a) over (partition by s) as r from fin join kept on fin.k = old_k where kind = 'r')",
        ]
        ctes = [counts, *self._start(),
                f"st({_ROW}) as (\n  select * from begin\n  union all\n  (with {body_of_round}\n    {self._next()}))", *last]
        return "with recursive " + ",\n".join(ctes) + "\n" + body
