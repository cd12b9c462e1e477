"""The first-order fit as one recursive SQL statement over the dense table, zero cells included.

State rows ``st(t, kind, s, id, k, a, b)`` after round t:

    sel  s sample, id feature     a selection
    r    s sample, k group        a membership, b log normaliser
    gam  id feature, k group      a concentration
    ftr  id feature               a background concentration, b sum of the selection
"""

from __future__ import annotations

from checks.recursive import LETTERS
from checks.sql import dg, draw, lg

_WORD = 1 << 32


def _code(*keys: str, seed: int) -> str:
    return f"cast(floor({draw(*keys, seed=seed)} * {_WORD}) as bigint)"


def _hashed(h: str, table: str, keep: str) -> str:
    """The table with ``h`` replaced by two rounds of the integer hash."""
    step = f"(xor({h} >> 16, {h}) * {0x45D9F3B}) % {_WORD}"
    once = f"select {keep}, {step} as {h} from {table}"
    twice = f"select {keep}, {step} as {h} from ({once})"
    return f"select {keep}, xor({h} >> 16, {h}) / {_WORD}.0 as {h} from ({twice})"


class FirstOrder:
    """The statement for ``cnt``; groups start from ``sample_id % k``."""

    def __init__(self, k: int, max_iter: int, seed: int = 42, counts: str = LETTERS):
        self.k, self.max_iter, self.seed, self.counts = k, max_iter, seed, counts

    def _start(self) -> list[str]:
        k = self.k
        pairs = "select sample_id, feature_id, which, (cs + cf) % {0} as h from sc, fc".format(_WORD)
        return [
            self.counts,
            f"ks as materialized (select unnest(range({k}))::int as k)",
            "smp as materialized (select sample_id, sum(x) as n_i from cnt group by 1)",
            "ftr as materialized (select distinct feature_id from cnt)",
            f"dx as materialized (select sample_id, feature_id, coalesce(x, 0.0) as x, n_i, {dg('1.0')} - {dg('(n_i + 1)')} as d "
            "from smp cross join ftr left join cnt using (sample_id, feature_id))",
            f"sc as materialized (select sample_id, {_code('0', 'sample_id', seed=self.seed)} as cs from smp)",
            f"fc as materialized (select feature_id, which, {_code('feature_id', 'which', seed=self.seed)} as cf "
            "from ftr, (select unnest(range(2)) as which))",
            f"uv as materialized ({_hashed('h', f'({pairs})', 'sample_id, feature_id, which')})",
            "sel0 as materialized (select sample_id, feature_id, max(h) filter (where which = 0) / greatest(sum(h), 1e-300) as f "
            "from uv group by 1, 2)",
        ]

    def _begin(self) -> str:
        k = self.k
        rows = [
            "select 0 as t, 'sel' as kind, sample_id::bigint as s, feature_id::varchar as id, null::int as k, f as a, null::double as b from sel0",
            f"select 0, 'r', sample_id, null, ks.k, case when sample_id % {k} = ks.k then 1.0 else 0.0 end, null from smp, ks",
            "select 0, 'gam', null, feature_id, ks.k, 1.0, null from ftr, ks",
            "select 0, 'ftr', null, feature_id, null, 1.0, sum(f) from sel0 group by feature_id",
        ]
        return "begin as materialized (select t::int as t, kind, s, id, k, a::double as a, b::double as b from (" + "\n  union all ".join(rows) + "))"

    def _expectation(self, table: str) -> list[str]:
        """Memberships ``r1`` and selection ``sel1`` from the state in ``table``."""
        half = "({0} * ({1} - {2} - ln({0})))"
        odds = lambda x: f"case when {x} > 709.782712893384 then 1.0 else exp({x}) end"
        return [
            f"sel as materialized (select s as sample_id, id as feature_id, a as f from {table} where kind = 'sel')",
            f"r as materialized (select s as sample_id, k, a as r from {table} where kind = 'r')",
            f"par as materialized (select id as feature_id, a as i, b as f_sum, sum(a) over () as tot, a / sum(a) over () as mb from {table} where kind = 'ftr')",
            f"gam as materialized (select id as feature_id, k, tot, a as g, a / tot as m from "
            f"(select *, sum(a) over (partition by k) as tot from {table} where kind = 'gam'))",
            f"sk as materialized (select feature_id, k, m, {half.format('m', dg('g'), dg('tot'))} as a from gam)",
            f"sb as materialized (select feature_id, mb, {half.format('mb', dg('i'), dg('tot'))} as a, f_sum from par)",
            "dim as materialized (select count(*)::double as n from smp)",
            "mass as materialized (select k, sum(r) + 10 * 2.220446049250313e-16 as mass from r group by 1)",
            f"stick as materialized (select k, 1.0 + mass as a, 1.0/{self.k} + coalesce(sum(mass) over "
            "(order by k rows between 1 following and unbounded following), 0) as b from mass)",
            f"lp as materialized (select k, ea + coalesce(sum(eb) over (order by k rows between unbounded preceding and 1 preceding), 0) as lp "
            f"from (select k, {dg('a')} - {dg('(a+b)')} as ea, {dg('b')} - {dg('(a+b)')} as eb from stick))",
            f"gain as materialized (select sample_id, feature_id, k, m, d, x, case when x > 0 then {dg('(x+m)')} - {dg('m')} else 0 end as ps, "
            f"d*a + case when x > 0 then {lg('x+m')} - {lg('m')} + a*({dg('(x+m)')} - {dg('m')}) else 0 end as part "
            "from dx join sk using (feature_id))",
            f"back as materialized (select sample_id, feature_id, mb, d, case when x > 0 then {dg('(x+mb)')} - {dg('mb')} else 0 end as ps, "
            f"d*a + case when x > 0 then {lg('x+mb')} - {lg('mb')} + a*({dg('(x+mb)')} - {dg('mb')}) else 0 end as part, "
            f"{dg('(1.0+f_sum)')} - {dg('(2.0+n)')} as p1, {dg('(1.0+n-f_sum)')} - {dg('(2.0+n)')} as p2 "
            "from dx join sb using (feature_id), dim)",
            f"ll as materialized (select sample_id, k, sum(f*part) - sum(f)*max({lg('n_i+1')}) + max(lp) as l from gain join sel using (sample_id, feature_id) "
            "join smp using (sample_id) join lp using (k) group by 1, 2)",
            "r1 as materialized (select sample_id, k, exp(l - top) / tot as r, top + ln(tot) as log_norm from "
            "(select *, sum(exp(l - top)) over (partition by sample_id) as tot from (select *, max(l) over (partition by sample_id) as top from ll)))",
            "yes as materialized (select sample_id, feature_id, sum(r*part) as yes from gain join r using (sample_id, k) group by 1, 2)",
            f"sel1 as materialized (select sample_id, feature_id, (yes + 1e-6) / (yes + no + 1e-6) as f, d, mb, ps from ("
            f"select sample_id, feature_id, d, mb, ps, {odds('(yes + p1)')} as yes, {odds('(part + p2)')} as no from yes join back using (sample_id, feature_id)))",
        ]

    def _round(self) -> list[str]:
        return [
            f"now as materialized (select max(t) + 1 as t from st having max(t) < {self.max_iter})",
            *self._expectation("st"),
            "gam1 as materialized (select feature_id, k, greatest(1.0 + max(m) * sum(r1.r * f * (gain.d + gain.ps)), 1e-10) as g "
            "from gain join r1 using (sample_id, k) join sel1 using (sample_id, feature_id) group by 1, 2)",
            "par1 as materialized (select feature_id, greatest(1.0 + max(mb) * sum((1 - f) * (d + ps)), 1e-10) as i, sum(f) as f_sum "
            "from sel1 group by 1)",
        ]

    def select(self, body: str, every: int | None = None) -> str:
        """``body`` over ``fin``, the state after the last round, ``r1`` and ``sel1``, which follow from it; with ``every``
        also over ``his``, the state rows of every so many rounds."""
        kept = f"t % {every} = 0" if every else "false"
        inner = ",\n    ".join(self._round())
        rows = ("select t, 'sel' as kind, sample_id as s, feature_id as id, null::int as k, f as a, null::double as b from sel1, now\n"
                "    union all select t, 'r', sample_id, null, k, r, log_norm from r1, now\n"
                "    union all select t, 'gam', null, feature_id, k, g, null from gam1, now\n"
                "    union all select t, 'ftr', null, feature_id, null, i, f_sum from par1, now")
        ctes = [*self._start(), self._begin(),
                f"st(t, kind, s, id, k, a, b) as (\n  select * from begin\n  union all\n  (with {inner}\n    {rows}))",
                f"fin as materialized (select * from st where t = {self.max_iter})",
                f"his as (select * from st where {kept} and t > 0)",
                *self._expectation("fin")]
        return "with recursive " + ",\n".join(ctes) + "\n" + body
