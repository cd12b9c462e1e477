"""ANSI SQL for the same results: count tables, closed forms and unrolled sweeps.

The SQL keeps everything in long form (one row per group and feature, or per group and
sample) and is written from the model's equations, independent of the library's
array layout. Sweeps start from ``sample_id % K`` as labels.
"""

from __future__ import annotations

EPS = "1e-10"

SUPPLIER_BRAND = """sb as materialized (
  select l_suppkey as sample_id, p_brand as feature_id, cast(count(*) as double) as x
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""

DOC_TOKEN = """dt as materialized (
  select sample_id, feature_id, cast(count(*) as double) as x from (
    select doc_id as sample_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as feature_id from documents)
  group by 1, 2)"""

USER_EVENT = """ue as materialized (
  select user_id as sample_id, event_type as feature_id, cast(count(*) as double) as x from events group by 1, 2)"""


def dg(x: str) -> str:
    """digamma: eight recurrence steps, then the asymptotic series."""
    y = f"({x} + 8)"
    steps = " + ".join(f"1.0/({x} + {i})" for i in range(8))
    return (
        f"(ln({y}) - 0.5/{y} - 1.0/(12*pow({y},2)) + 1.0/(120*pow({y},4)) - 1.0/(252*pow({y},6))"
        f" + 1.0/(240*pow({y},8)) - 1.0/(132*pow({y},10)) - ({steps}))"
    )


def lg(x: str) -> str:
    return f"lgamma(cast({x} as double))"


def beta_kl(a: str, b: str, a0: str, b0: str) -> str:
    return (
        f"({lg(f'({a0})+({b0})')} - {lg(a0)} - {lg(b0)} - {lg(f'({a})+({b})')} + {lg(a)} + {lg(b)}"
        f" + (({a})-({a0}))*({dg(f'({a})')} - {dg(f'(({a})+({b}))')})"
        f" + (({b})-({b0}))*({dg(f'({b})')} - {dg(f'(({a})+({b}))')}))"
    )


def sigmoid(x: str) -> str:
    return f"least(greatest(1.0/(1.0+exp(-least(greatest({x}, -500), 500))), {EPS}), 1.0 - {EPS})"


def draw(*keys: str, seed: int = 0) -> str:
    """A number in [0, 1) from the first 13 hexadecimal digits of the md5 of the keys."""
    return f"(cast('0x' || substr(md5(concat_ws('|', {', '.join(keys)}, '{seed}')), 1, 13) as bigint) / 4503599627370496.0)"


def statement(ctes: list[str], select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


class Sweeps:
    """CTEs of a conjugate fit on the supplier table: start state (version 0) and sweeps."""

    def __init__(self, p: dict, weights: str, selection: str, select_first: bool = True, start: str = "mean", k: int = 3):
        self.p, self.weights, self.selection, self.first, self.k = p, weights, selection, select_first, k
        self.v = 0
        groups = ", ".join(f"({i})" for i in range(k))
        self.ctes = [
            SUPPLIER_BRAND,
            f"ks as (select * from (values {groups}) as t(k))",
            "dims as materialized (select cast(count(distinct sample_id) as double) as n, "
            "cast(count(distinct feature_id) as double) as s, sum(x) as total, cast(count(*) as double) as nnz from sb)",
            "smp as materialized (select sample_id, sum(x) as n_i from sb group by 1)",
            "ftr as materialized (select feature_id, sum(x) as colsum, cast(count(*) as double) as nnz_j from sb group by 1)",
            f"r0 as materialized (select sample_id, k, case when sample_id % {k} = k then 1.0 else 0.0 end as r from smp, ks)",
            "mem as materialized (select k, cast(count(*) as double) as n_k, sum(n_i) as tot, sum(r) as mass "
            "from r0 join smp using (sample_id) where r > 0.1 group by 1)",
            "sx as materialized (select k, feature_id, sum(x) as sx, sum(r*x) as rx from r0 join sb using (sample_id) "
            "where r > 0.1 group by 1, 2)",
        ]
        z, e = p["zeta"], p["eta"]
        if start == "mean":
            lam = f"greatest((coalesce(sx,0)/n_k + 0.5)/(tot/n_k + 0.5*s)*{z}*s, 0.1)"
            iota = f"greatest((colsum/n + 0.5)/(total/n + 0.5*s)*{e}*s, 0.1)"
        else:
            lam, iota = f"greatest({z} + coalesce(rx,0), 0.1)", f"greatest({e} + colsum/n + 0.5, 0.1)"
        self.ctes += [
            f"lam0 as materialized (select m.k, f.feature_id, {lam} as v from mem m cross join ftr f cross join dims "
            "left join sx on sx.k = m.k and sx.feature_id = f.feature_id)",
            f"iota0 as materialized (select feature_id, {iota} as v from ftr, dims)",
        ]
        mass = "select k, mass as r_k from mem"
        self.ctes.append(f"mass0 as materialized ({mass})")
        if weights == "dp":
            self.ctes.append(f"w0 as materialized (select k, 1.0 as a, {p['nu']} as b from ks)")
        elif weights == "py":
            self.ctes.append(f"w0 as materialized (select k, 1.0-{p['d']} as a, {p['theta']}+(k+1)*{p['d']} as b from ks)")
        else:
            self._weights(0)
        f0 = p["f0"]
        if selection == "shared":
            self.ctes.append(f"f0 as materialized (select feature_id, {f0} as f from ftr)")
        elif selection == "cluster":
            self.ctes.append(f"f0 as materialized (select k, feature_id, {f0} as f from ftr, ks)")
        elif selection == "sample":
            self.ctes.append(f"f0 as materialized (select sample_id, feature_id, x, {f0} as f from sb)")
            self.ctes.append(f"z0 as materialized (select {f0} as f)")
        else:
            kappa = p["kappa"]
            self.ctes.append(f"bt as materialized (select pow(greatest(s,2), {1 + kappa})/ln(greatest(s,2)) as bt from dims)")
            xi = f"{p['init_xi']}" if selection == "ssl" else "greatest(1.0/(1.0+bt), 1e-3)"
            self.ctes.append(f"f0 as materialized (select feature_id, {xi} as f from ftr, bt)")
            self.ctes.append("th0 as materialized (select 1.0/(1.0+bt) as theta from bt)")

    def _weights(self, v: int) -> None:
        p, w = self.p, self.weights
        after = "coalesce(sum(r_k) over (order by k rows between 1 following and unbounded following), 0)"
        g = f"{self.k}"
        body = {
            "dp": f"1.0 + r_k as a, {p['nu']} + {after} as b",
            "py": f"(1.0-{p['d']}) + r_k as a, {p['theta']} + (k+1)*{p['d']} + {after} as b",
            "nig": f"(1.0-{p['sigma']}) + {p['alpha']}/{g} + r_k as a, (1.0-{p['sigma']}) + {p['alpha']}/{g} + {after} as b",
            "mfm": f"{p['delta']} + {p['gamma']}/{g} + r_k as a, 0.0 as b",
        }[w]
        self.ctes.append(f"w{v} as materialized (select k, {body} from mass{v})")

    def expectations(self) -> None:
        """Expected logs of the current version: ea, eb, lp."""
        v = self.v
        self.ctes += [
            f"ea{v} as materialized (select k, feature_id, {dg('v')} - {dg('tot')} as e from "
            f"(select *, sum(v) over (partition by k) as tot from lam{v}))",
            f"eb{v} as materialized (select feature_id, {dg('v')} - {dg('tot')} as e from "
            f"(select *, sum(v) over () as tot from iota{v}))",
        ]
        if self.weights == "mfm":
            self.ctes.append(f"lp{v} as materialized (select k, {dg('a')} - {dg('tot')} as e from "
                             f"(select *, sum(a) over () as tot from w{v}))")
        else:
            self.ctes.append(
                f"lp{v} as materialized (select k, el + coalesce(sum(er) over (order by k rows between unbounded preceding "
                f"and 1 preceding), 0) as e from (select k, {dg('a')} - {dg('(a+b)')} as el, {dg('b')} - {dg('(a+b)')} as er from w{v}))")

    def loglik(self, gated: bool = True) -> None:
        """Expected log-likelihood ll of the current version."""
        v = self.v
        if self.selection == "sample":
            body = (f"select f.sample_id, a.k, sum(f.x*(f.f*a.e + (1-f.f)*b.e)) as l from f{v} f join ea{v} a using (feature_id) "
                    f"join eb{v} b using (feature_id) group by 1, 2")
        else:
            on = "f.feature_id = a.feature_id" + (" and f.k = a.k" if self.selection == "cluster" else "")
            c = "f.f*a.e + (1-f.f)*b.e" if gated else "a.e"
            body = (f"select sb.sample_id, a.k, sum(sb.x*({c})) as l from sb join ea{v} a on a.feature_id = sb.feature_id "
                    f"join eb{v} b on b.feature_id = sb.feature_id join f{v} f on {on} group by 1, 2")
        self.ctes.append(f"ll{v} as materialized ({body})")

    def memberships(self, beta: float = 1.0) -> None:
        v, n = self.v, self.v + 1
        self.ctes.append(
            f"r{n} as materialized (select sample_id, k, g / sum(g) over (partition by sample_id) as r from ("
            f"select sample_id, k, greatest(e / sum(e) over (partition by sample_id), {EPS}) as g from ("
            f"select sample_id, k, exp(l - max(l) over (partition by sample_id)) as e from ("
            f"select sample_id, k, {beta}*(l + lp.e) as l from ll{v} join lp{v} lp using (k)))))")

    def sweep(self, beta: float = 1.0, gated: bool = True) -> Sweeps:
        """Append one sweep; the new tables carry the next version number."""
        v, n, p = self.v, self.v + 1, self.p
        self.expectations()
        self.loglik(gated)
        self.memberships(beta)
        started = v > 0
        add = self.ctes.append
        add(f"mass{n} as materialized (select k, sum(r) as r_k from r{n} group by 1)")
        add(f"rx{n} as materialized (select r.k, sb.feature_id, sum(r.r*sb.x) as rx from r{n} r join sb using (sample_id) group by 1, 2)")
        x1, x2 = p["xi_1"], p["xi_2"]
        used = n if self.first else v
        if self.selection == "sample":
            a, b = (f"({x1} + f.f)", f"({x2} + 1 - f.f)") if started else (f"{x1}", f"{x2}")
            add(f"own{n} as materialized (select r.sample_id, a.feature_id, sum(r.r*a.e) as own from r{n} r "
                f"join ea{v} a using (k) group by 1, 2)")
            odds = f"{dg(a)} - {dg(b)} + f.x*(o.own - b.e)"
            add(f"f{n} as materialized (select f.sample_id, f.feature_id, f.x, {sigmoid(odds)} as f from f{v} f "
                f"join own{n} o using (sample_id, feature_id) join eb{v} b using (feature_id))")
            za, zb = (f"({x1} + f)", f"({x2} + 1 - f)") if started else (f"{x1}", f"{x2}")
            add(f"z{n} as materialized (select {sigmoid(f'{dg(za)} - {dg(zb)}')} as f from z{v})")
            add(f"lam{n} as materialized (select r.k, f.feature_id, greatest({p['zeta']} + sum(r.r*f.f*f.x), 0.1) as v "
                f"from f{used} f join r{n} r using (sample_id) group by 1, 2)")
            add(f"iota{n} as materialized (select feature_id, greatest({p['eta']} + sum((1-f)*x), 0.1) as v from f{used} group by 1)")
            add(f"fit{n} as materialized (select sum(f.x*(f.f*o.own + (1-f.f)*b.e)) as fit from f{n} f "
                f"join own{n} o using (sample_id, feature_id) join eb{v} b using (feature_id))")
        else:
            sig = (f"sig{n} as materialized (select x.feature_id, sum(x.rx*a.e) - max(t.colsum*b.e) as s from rx{n} x "
                   f"join ea{v} a on a.k = x.k and a.feature_id = x.feature_id join eb{v} b on b.feature_id = x.feature_id "
                   f"join ftr t on t.feature_id = x.feature_id group by 1)")
            add(sig)
            if self.selection == "cluster":
                a, b = (f"({x1} + n*f.f)", f"({x2} + n*(1-f.f))") if started else (f"{x1}", f"{x2}")
                odds = f"{dg(a)} - {dg(b)} + x.rx*(a.e - b.e)"
                add(f"f{n} as materialized (select f.k, f.feature_id, {sigmoid(odds)} as f from f{v} f join rx{n} x using (k, feature_id) "
                    f"join ea{v} a using (k, feature_id) join eb{v} b using (feature_id) cross join dims)")
                add(f"lam{n} as materialized (select k, feature_id, greatest({p['zeta']} + f*rx, 0.1) as v from f{used} join rx{n} using (k, feature_id))")
                add(f"iota{n} as materialized (select feature_id, greatest({p['eta']} + sum((1-f)*rx), 0.1) as v "
                    f"from f{used} join rx{n} using (k, feature_id) group by 1)")
                add(f"fit{n} as materialized (select sum(x.rx*(f.f*a.e + (1-f.f)*b.e)) as fit from rx{n} x join f{n} f using (k, feature_id) "
                    f"join ea{v} a using (k, feature_id) join eb{v} b using (feature_id))")
            else:
                if self.selection == "shared":
                    a, b = (f"({x1} + n*f.f)", f"({x2} + n*(1-f.f))") if started else (f"{x1}", f"{x2}")
                    body = (f"select f.feature_id, {sigmoid(f'{dg(a)} - {dg(b)} + s.s')} as f from f{v} f "
                            f"join sig{n} s using (feature_id) cross join dims")
                elif self.selection == "ssl":
                    odds = (f"s.s + ln({p['l1']}/{p['l0']}) + ({p['l0']}-{p['l1']})*greatest(s.s, 0) + ln(theta/(1-theta))")
                    body = f"select feature_id, {sigmoid(odds)} as f from sig{n} s cross join th{v}"
                else:
                    add(f"g{n} as materialized (select a.feature_id, sum(m.r_k/n*abs(a.e - b.e)) as g from ea{v} a "
                        f"join eb{v} b using (feature_id) join mass{n} m using (k) cross join dims group by 1)")
                    q = "least(greatest(1 - least(greatest(3*theta, 0.05), 0.4), 0.5), 0.9)"
                    add(f"pos{n} as materialized (select (count(*)-1)*max({q}) as h from g{n} cross join th{v})")
                    add(f"base{n} as materialized (select sum(case when i = floor(h) then g*(1-(h-floor(h))) else 0 end) + "
                        f"sum(case when i = floor(h)+1 then g*(h-floor(h)) else 0 end) as base from "
                        f"(select g, row_number() over (order by g) - 1 as i from g{n}) cross join pos{n})")
                    odds = (f"ln({p['l1']}/{p['l0']}) + ({p['l0']}-{p['l1']})*greatest(g - base, 0) + ln(theta/(1-theta))")
                    ema = p["xi_ema"]
                    body = (f"select feature_id, least(greatest({ema}*{sigmoid(odds)} + (1-{ema})*f.f, {EPS}), 1-{EPS}) as f "
                            f"from g{n} join f{v} f using (feature_id) cross join base{n} cross join th{v}")
                add(f"f{n} as materialized ({body})")
                gate = "1.0" if self.selection == "ssl_excess" else "f"
                rest = "colsum" if self.selection == "ssl_excess" and not gated else "(1-f)*colsum"
                add(f"lam{n} as materialized (select k, feature_id, greatest({p['zeta']} + {gate}*rx, 0.1) as v from f{used} join rx{n} using (feature_id))")
                add(f"iota{n} as materialized (select feature_id, greatest({p['eta']} + {rest}, 0.1) as v from f{used} join ftr using (feature_id))")
                add(f"fit{n} as materialized (select sum(x.rx*(f.f*a.e + (1-f.f)*b.e)) as fit from rx{n} x join f{n} f using (feature_id) "
                    f"join ea{v} a using (k, feature_id) join eb{v} b using (feature_id))")
                if self.selection.startswith("ssl"):
                    add(f"th{n} as materialized (select (1 + sum(f))/(1 + max(bt) + count(*)) as theta from f{n} cross join bt)")
        self._weights(n)
        add(f"ent{n} as materialized (select sum(r*ln(greatest(r, {EPS}))) as p from r{n})")
        self.v = n
        return self

    def fast_objective(self) -> str:
        """Scalar subquery: sum r (elog_pi + ll) - sum r ln r with the logs of the sweep's start."""
        n = self.v
        return (f"((select fit from fit{n}) + (select sum(m.r_k*lp.e) from mass{n} m join lp{n-1} lp using (k)) - (select p from ent{n}))")

    def weights_kl(self) -> str:
        n, p = self.v, self.p
        if self.weights == "mfm":
            de = f"({p['delta']} + {p['gamma']}/{self.k})"
            return (f"(select {lg(f'{de}*{self.k}')} - {self.k}*{lg(de)} - ({lg('max(tot)')} - sum({lg('a')})) "
                    f"+ sum((a-{de})*({dg('a')} - {dg('tot')})) from (select a, sum(a) over () as tot from w{n}))")
        if self.weights == "nig":
            a0 = b0 = f"(1.0-{p['sigma']})"
        else:
            a0, b0 = f"(1.0-{p['d']})", f"({p['theta']}+(k+1)*{p['d']})"
        return f"(select sum({beta_kl('a', 'b', a0, b0)}) from w{n})"

    def selection_kl(self) -> str:
        n, x1, x2 = self.v, self.p["xi_1"], self.p["xi_2"]
        if self.selection == "sample":
            one = beta_kl(f"({x1}+f)", f"({x2}+1-f)", f"{x1}", f"{x2}")
            return f"((select sum({one}) from f{n}) + (select (n*s - nnz)*{one} from z{n} cross join dims))"
        one = beta_kl(f"({x1}+n*f)", f"({x2}+n*(1-f))", f"{x1}", f"{x2}")
        return f"(select sum({one}) from f{n} cross join dims)"

    def select(self, body: str) -> str:
        return statement(self.ctes, body)
