"""Registered graph queries: degree, components, cycles, impact set, waves, risk."""

from __future__ import annotations

from codeweave.operators import graph as G
from codeweave.plans import fixtures as X
from codeweave.plans.registry import register

IMPACT_TARGET = "mod.7"

_E = X.oracle_with(X.SQL_MODULE_EDGES, recursive=True).rstrip() + """,
e as (select distinct source as a, target as b from module_edges),
nodes as (select a as node from e union select b from e)
"""

_SCC = _E.rstrip() + """,
reach(a, b) as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a),
on_cycle as (select r1.a as node, min(r1.b) as scc, count(distinct r1.b)::bigint as scc_size
             from reach r1 join reach r2 on r1.a = r2.b and r1.b = r2.a group by r1.a),
scc_all as (select n.node, coalesce(c.scc, n.node) as scc, coalesce(c.scc_size, 1)::bigint as scc_size
            from nodes n left join on_cycle c using (node))
"""


@register("degree", X.oracle_with(X.SQL_MODULE_EDGES) + """,
sides as (select source as node, 0 as i, 1 as o, 0.0::double as iw, weight::double as ow from module_edges
          union all select target, 1, 0, weight::double, 0.0 from module_edges)
select node, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree, sum(iw) as in_weight,
       sum(ow) as out_weight, (sum(i) + sum(o))::bigint as degree
from sides group by node""")
def q_degree(spark, d):
    return G.degree(X.module_edges(spark, d))


@register("components", X.oracle_with(X.SQL_TRADE_EDGES, recursive=True) + """,
e as (select distinct source as a, target as b from trade_edges),
u as (select a, b from e union select b, a from e),
reach(a, b) as (select a, a from u union select r.a, u.b from reach r join u on r.b = u.a),
comp as (select a as node, min(b) as component from reach group by a)
select node, component, (count(*) over (partition by component))::bigint as component_size from comp""")
def q_components(spark, d):
    return G.connected_components(X.trade_edges(spark, d))


@register("module_components", _E + """,
u as (select a, b from e union select b, a from e),
lab(node, label, it) as (select node, node, 0 from nodes
   union all select u.b, min(l.label), max(l.it) + 1 from lab l join u on l.node = u.a where l.it < 64 group by u.b),
comp as (select node, min(label) as component from lab group by node)
select node, component, (count(*) over (partition by component))::bigint as component_size from comp""")
def q_module_components(spark, d):
    # weakly connected components of the whole module graph; the oracle is a
    # depth-bounded (64) min-label recursion, exact while the diameter is below it
    return G.connected_components(X.module_edges(spark, d))


@register("cycles_nodes", _SCC + """
select s.node, s.scc, s.scc_size, exists (select 1 from e where e.a = s.node and e.b = s.node) as self_loop
from scc_all s
where s.scc_size > 1 or exists (select 1 from e where e.a = s.node and e.b = s.node)""")
def q_cycles_nodes(spark, d):
    return G.cycle_nodes(X.module_edges(spark, d))


@register("cycles_short", _E + """
select a as node_a, b as node_b, 1 as length from e where a = b
union all
select e1.a, e1.b, 2 from e e1 where e1.a < e1.b
  and exists (select 1 from e e2 where e2.a = e1.b and e2.b = e1.a)""")
def q_cycles_short(spark, d):
    return G.short_cycles(X.module_edges(spark, d))


@register("impact_set", _E + f""",
walk(node, hop) as (select '{IMPACT_TARGET}', 0
                    union select e.a, w.hop + 1 from walk w join e on e.b = w.node where w.hop < 64)
select node as module, min(hop)::int as hop from walk where node <> '{IMPACT_TARGET}' group by node""")
def q_impact_set(spark, d):
    return G.impact_set(X.module_edges(spark, d), IMPACT_TARGET)


@register("migration_waves", _SCC + """,
ce as (select distinct sa.scc as a, sb.scc as b from e
       join scc_all sa on e.a = sa.node join scc_all sb on e.b = sb.node where sa.scc <> sb.scc),
paths(start, cur, len) as (select distinct scc, scc, 0 from scc_all
                           union select p.start, ce.b, p.len + 1 from paths p join ce on ce.a = p.cur),
waves as (select start as scc, max(len) as wave from paths group by start)
select s.node as module, s.scc, w.wave::int as wave from scc_all s join waves w using (scc)""")
def q_migration_waves(spark, d):
    return G.migration_waves(X.module_edges(spark, d))


@register("risk_rank", _SCC + """,
fo as (select source as module, count(distinct target)::bigint as fan_out, sum(weight)::double as ow
       from module_edges group by 1),
fi as (select target as module, count(distinct source)::bigint as fan_in, sum(weight)::double as iw
       from module_edges group by 1),
m as (select s.node as module, coalesce(fi.fan_in, 0)::bigint as fan_in, coalesce(fo.fan_out, 0)::bigint as fan_out,
             coalesce(iw, 0) + coalesce(ow, 0) as strength, s.scc_size
      from scc_all s left join fo on fo.module = s.node left join fi on fi.module = s.node)
select *, (fan_in + 1) * (fan_out + 1) * scc_size as risk_score from m
order by risk_score desc, strength desc, module limit 20""")
def q_risk_rank(spark, d):
    return G.risk_rank(X.module_edges(spark, d), k=20)


_DIALOGUE = X.oracle_with(X.SQL_DIALOGUE_EDGES, recursive=True).rstrip() + """,
e as (select distinct source as a, target as b from dialogue_edges),
nodes as (select a as node from e union select b from e),
""" + _SCC[_SCC.index("reach(a, b)"):]


@register("cycles_list", _DIALOGUE + """,
inner_e as (select e.a, e.b, x.scc from e join scc_all x on x.node = e.a join scc_all y on y.node = e.b where x.scc = y.scc),
p(scc, s, v, path, len) as (
  select scc, a, b, [a], 1 from inner_e where b >= a
  union all
  select p.scc, p.s, i.b, list_append(p.path, p.v), p.len + 1 from p join inner_e i on i.a = p.v
  where p.v <> p.s and p.len < 6 and (i.b = p.s or (i.b > p.s and not list_contains(p.path, i.b)))),
c as (select scc, path, len from p where v = s),
m as (select scc, min(len) as len from c group by scc)
select scc, len::int as length, min(path) as cycle from c join m using (scc, len) group by scc, len""")
def q_cycles_list(spark, d):
    return G.shortest_cycles(X.dialogue_edges(spark, d))


@register("waves_deep", _DIALOGUE + """,
ce as (select distinct sa.scc as a, sb.scc as b from e
       join scc_all sa on e.a = sa.node join scc_all sb on e.b = sb.node where sa.scc <> sb.scc),
paths(start, cur, len) as (select distinct scc, scc, 0 from scc_all
                           union select p.start, ce.b, p.len + 1 from paths p join ce on ce.a = p.cur),
waves as (select start as scc, max(len) as wave from paths group by start)
select s.node as module, s.scc, w.wave::int as wave from scc_all s join waves w using (scc)""")
def q_waves_deep(spark, d):
    return G.migration_waves(X.dialogue_edges(spark, d))


@register("impact_deep", _DIALOGUE + """,
walk(node, hop) as (select 'c0.0', 0 union select e.a, w.hop + 1 from walk w join e on e.b = w.node where w.hop < 64)
select node as module, min(hop)::int as hop from walk where node <> 'c0.0' group by node""")
def q_impact_deep(spark, d):
    return G.impact_set(X.dialogue_edges(spark, d), "c0.0")


@register("components_many", X.oracle_with(X.SQL_DIALOGUE_STEPS, recursive=True) + """,
u as (select source as a, target as b from dialogue_steps union select target, source from dialogue_steps),
reach(a, b) as (select a, a from u union select r.a, u.b from reach r join u on r.b = u.a),
comp as (select a as node, min(b) as component from reach group by a)
select node, component, (count(*) over (partition by component))::bigint as component_size from comp""")
def q_components_many(spark, d):
    return G.connected_components(X.dialogue_steps(spark, d))


@register("reach_estimate")
def q_reach_estimate(spark, d):
    return G.reach_sizes(X.module_edges(spark, d))
