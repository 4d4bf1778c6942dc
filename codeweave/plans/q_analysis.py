"""Registered analysis queries (dependency questions, layers, inventory, call graph)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweave.operators import analysis as A
from codeweave.plans import fixtures as X
from codeweave.plans.registry import register

MODULE = "widget"
DEPENDENTS_OF = "supplier#00000001"

_REL = X.oracle_with(X.SQL_RELATIONSHIPS)


@register("find_dependencies", _REL + f"""
select source as "from", target as "to", description as "type", weight
from relationships
where regexp_matches(source, '{MODULE}', 'i') and regexp_matches(description, 'import|depend', 'i')""")
def q_find_dependencies(spark, d):
    return A.find_dependencies(X.relationships(spark, d), MODULE)


@register("find_dependents", _REL + f"""
select source as "from", target as "to", description as "type", weight
from relationships
where regexp_matches(target, '{DEPENDENTS_OF}', 'i') and regexp_matches(description, 'import|depend', 'i')""")
def q_find_dependents(spark, d):
    return A.find_dependents(X.relationships(spark, d), DEPENDENTS_OF)


_LAYERS_SQL = """
deg as (select target as module, count(*)::bigint as in_degree from relationships group by 1),
ranked as (select module, in_degree, row_number() over (order by in_degree, module) - 1 as i,
                  count(*) over () as n from deg),
layers as (
 select 'leaf_modules' as layer, module, in_degree, i from ranked where i < 5
 union all select 'intermediate_modules', module, in_degree, i from ranked where i >= 5 and i < 15
 union all select 'top_modules', module, in_degree, i from ranked where i >= n - 5)
"""


@register("dependency_layers", _REL.rstrip() + "," + _LAYERS_SQL + """
select layer, (row_number() over (partition by layer order by i) - 1)::int as pos, module, in_degree
from layers""")
def q_dependency_layers(spark, d):
    return A.dependency_layers(X.relationships(spark, d))


@register("root_modules", X.oracle_with(X.SQL_RELATIONSHIPS, X.SQL_ENTITIES) + """
select title as module, 0::bigint as in_degree from entities
where title not in (select target from relationships where target is not null)""")
def q_root_modules(spark, d):
    return A.root_modules(X.relationships(spark, d), X.entities(spark, d))


@register("dependency_report", _REL.rstrip() + "," + _LAYERS_SQL + f"""
select 'dependencies' as section, source as "from", target as "to", description as "type", weight,
       null::varchar as module, null::bigint as in_degree, null::int as pos
from relationships
where regexp_matches(source, '{MODULE}', 'i') and regexp_matches(description, 'import|depend', 'i')
union all
select 'dependents', source, target, description, weight, null, null, null
from relationships
where regexp_matches(target, 'database', 'i') and regexp_matches(description, 'import|depend', 'i')
union all
select layer, null, null, null, null, module, in_degree,
       (row_number() over (partition by layer order by i) - 1)::int
from layers""")
def q_dependency_report(spark, d):
    return A.dependency_report(X.relationships(spark, d), MODULE, "database")


@register("library_inventory", X.oracle_with(X.SQL_METADATA) + """
select library_name,
  array_to_string(list_sort(list_distinct(list(library_version))), ',') as versions,
  count(distinct library_version)::bigint as n_versions,
  count(distinct file_path)::bigint as n_files,
  count(*) filter (where len(vulnerabilities) > 0)::bigint as n_vulnerable_files,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(vulnerabilities)))), ','), '') as vulnerabilities,
  count(distinct library_version) > 1 as version_conflict
from metadata group by library_name""")
def q_library_inventory(spark, d):
    return A.library_inventory(X.metadata(spark, d))


@register("call_graph", X.oracle_with(X.SQL_METADATA) + """,
ex as (select file_path, method_name, unnest(callees) as other from metadata),
known as (select distinct method_name as m from metadata)
select other as caller, method_name as callee, count(*)::bigint as n_sites,
       bool_and(k.m is not null) as resolved
from ex left join known k on ex.other = k.m
group by 1, 2""")
def q_call_graph(spark, d):
    return A.call_graph(X.metadata(spark, d))


@register("library_versions", X.oracle_with(X.SQL_LIBRARY_USES) + """,
k as (select *, v0 * 1000000000 + v1 * 1000000 + v2 * 10000 + rel * 100 + rc as key from library_uses),
t as (select library_name, max(key) as top, count(distinct key)::bigint as n_versions, count(distinct v0) as n_first, bool_or(deprecated) as deprecated,
             max(low) as low, min(high) as high from k group by 1)
select library_name, max(case when key = top then version end) as newest, any_value(n_versions) as n_versions,
       (count(distinct file_path) filter (where key < top))::bigint as n_outdated, any_value(t.deprecated) as deprecated,
       any_value(n_first > 1 or t.low >= t.high) as conflicting
from k join t using (library_name) group by library_name""")
def q_library_versions(spark, d):
    return A.library_versions(X.library_uses(spark, d))
