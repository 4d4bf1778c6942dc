"""Registered index-construction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweave.operators import communities as CM
from codeweave.operators import delta_graph as DG
from codeweave.operators import imports as IM
from codeweave.operators import indexing as IX
from codeweave.plans import fixtures as X
from codeweave.plans.registry import register
from codeweave.session import cut_lineage

CHUNK_SIZE, CHUNK_OVERLAP = 1200, 100
_TOKS_SQL = r"regexp_extract_all(text, '[^ \t\n\r\f]+[ \t\n\r\f]*')"


@register("chunk_text", f"""
with t as (select doc_id, {_TOKS_SQL} as toks from documents),
n as (select doc_id, toks, len(toks) as n from t where len(toks) > 0),
s as (select doc_id, toks, unnest(generate_series(0, greatest(n - {CHUNK_OVERLAP} - 1, 0),
                                                   {CHUNK_SIZE - CHUNK_OVERLAP})) as start_token from n)
select doc_id, (row_number() over (partition by doc_id order by start_token) - 1)::int as chunk_index,
       start_token::int as start_token,
       len(list_slice(toks, start_token + 1, start_token + {CHUNK_SIZE}))::int as n_tokens,
       md5(regexp_replace(array_to_string(list_slice(toks, start_token + 1, start_token + {CHUNK_SIZE}), ''), '[ \\t\\n\\r\\f]+$', '')) as chunk_md5
from s""")
def q_chunk_text(spark, d):
    c = IX.chunk_text(X.table(spark, d, "documents"), "text", "doc_id", CHUNK_SIZE, CHUNK_OVERLAP)
    return c.select("doc_id", "chunk_index", "start_token", "n_tokens", F.md5("text").alias("chunk_md5"))


_MENTIONS_BODY = """,
mentions as (
 select file_path, file_path as name, 'module' as type from metadata
 union all select file_path, package, 'package' from metadata where package is not null and package <> ''
 union all select file_path, unnest(imports), 'dependency' from metadata
 union all select file_path, unnest(classes), 'class' from metadata
 union all select file_path, method_name, 'function' from metadata),
ents as (select upper(trim(name)) as title, type, count(distinct file_path)::bigint as frequency
         from mentions where name is not null and trim(name) <> '' group by 1, 2)
"""
_MENTIONS_SQL = X.oracle_with(X.SQL_METADATA) + _MENTIONS_BODY
_RELATIONS_BODY = """,
rel as (
 select file_path, file_path as s, unnest(imports) as t, 'IMPORTS' as type from metadata
 union all select file_path, file_path, unnest(classes), 'USES' from metadata
 union all select file_path, file_path, package, 'DEPENDS_ON' from metadata where package is not null and package <> ''
 union all select file_path, unnest(callees), method_name, 'CALLS' from metadata),
m as (select upper(trim(s)) as source, upper(trim(t)) as target, type, count(*)::bigint as weight,
             count(distinct file_path)::bigint as n_files from rel group by 1, 2, 3),
rels as (select * from m where source in (select title from ents) and target in (select title from ents))
"""


@register("entities_structural", _MENTIONS_SQL + "select * from ents")
def q_entities_structural(spark, d):
    return IX.structural_entities(X.metadata(spark, d))


@register("relationships_structural", _MENTIONS_SQL.rstrip() + _RELATIONS_BODY + "select * from rels")
def q_relationships_structural(spark, d):
    return IX.structural_relationships(X.metadata(spark, d))


@register("href_edges", """
with l as (select url as source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as target from pages)
select source, target, count(*)::bigint as weight from l where target <> '' group by 1, 2""")
def q_href_edges(spark, d):
    return IX.href_edges(X.table(spark, d, "pages"))


@register("import_edges", """
with c as (select doc_id, 'f' || doc_id || '.py' as file_path,
            'import ' || source || '.' || lang || chr(10) || 'from pkg' || n_chars || ' import x' || chr(10)
            || text || chr(10) || '#include <' || lang || '.h>' || chr(10) || 'x = require("' || source || '")' as code from documents),
e as (select file_path, unnest(list_distinct(list_concat(
        regexp_extract_all(code, '(?m)^\\s*import\\s+([\\w.]+)', 1), regexp_extract_all(code, '(?m)^\\s*from\\s+([\\w.]+)\\s+import\\b', 1),
        regexp_extract_all(code, 'require\\(\\s*[''"]([^''"]+)[''"]\\s*\\)', 1), regexp_extract_all(code, '(?m)^\\s*#include\\s*[<"]([^>"]+)[>"]', 1)))) as target from c)
select file_path as source, target, 'IMPORTS' as type from e""")
def q_import_edges(spark, d):
    nl = F.lit("\n")
    code = F.concat(F.lit("import "), "source", F.lit("."), "lang", nl, F.lit("from pkg"), F.col("n_chars").cast("string"), F.lit(" import x"), nl,
                    "text", nl, F.lit("#include <"), "lang", F.lit(".h>"), nl, F.lit('x = require("'), "source", F.lit('")'))
    docs = X.table(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"), code.alias("code"))
    return IX.import_edges(docs)


@register("import_resolution", X.oracle_with(X.SQL_PYTHON_IMPORTS) + """
select pi.path as source, 'python' as language, pi.name, t.path as target from pi left join pf t
 on case when pi.name like '.%' then t.path = regexp_replace(pi.path, '[^/]*$', '') || substr(pi.name, 2) || '.py' else t.module = pi.name end""")
def q_import_resolution(spark, d):
    return IM.resolve_imports(X.python_files(spark, d))


@register("cooccurrence", """
with p as (select doc_id, list_transform(regexp_extract_all(text, '[A-Z][a-z]+'), lambda x: lower(x)) as ph
           from documents),
e as (select doc_id, unnest(ph) as w, generate_subscripts(ph, 1) as i from p),
pairs as (select a.doc_id, a.w as a, b.w as b from e a join e b on a.doc_id = b.doc_id and b.i - a.i between 1 and 2
          where a.w <> b.w)
select least(a, b) as phrase_a, greatest(a, b) as phrase_b, count(*)::bigint as weight,
       count(distinct doc_id)::bigint as n_docs from pairs group by 1, 2""")
def q_cooccurrence(spark, d):
    return IX.cooccurrence(X.table(spark, d, "documents"), "text", "doc_id", window=2)


@register("description_summary", X.oracle_with(X.SQL_RELATIONSHIPS) + """,
d as (select source, target, description, count(*) as c from relationships where description is not null
      group by 1, 2, 3),
r as (select *, row_number() over (partition by source, target order by c desc, description) as rk from d),
g as (select source, target, sum(c)::bigint as n_mentions,
             string_agg(description, ' | ' order by rk) as s from r group by 1, 2)
select source, target, n_mentions, array_to_string(list_slice(string_split(s, ' '), 1, 500), ' ') as summary from g""")
def q_description_summary(spark, d):
    return IX.description_summary(X.relationships(spark, d))


@register("snapshot_diff", X.oracle_with(X.SQL_SNAPSHOTS) + """
select coalesce(o.doc_key, n.doc_key) as doc_key,
       case when o.doc_key is null then 'added' when n.doc_key is null then 'deleted'
            when sha256(o.text) <> sha256(n.text) then 'changed' else 'same' end as status
from snapshot_old o full outer join snapshot_new n on o.doc_key = n.doc_key""")
def q_snapshot_diff(spark, d):
    return IX.snapshot_diff(X.snapshot_old(spark, d), X.snapshot_new(spark, d))


@register("incremental_units", X.oracle_with(X.SQL_SNAPSHOTS) + f""",
diff as (select coalesce(o.doc_key, n.doc_key) as doc_key,
          case when o.doc_key is null then 'added' when n.doc_key is null then 'deleted'
               when sha256(o.text) <> sha256(n.text) then 'changed' else 'same' end as status
         from snapshot_old o full outer join snapshot_new n on o.doc_key = n.doc_key),
docs as (select doc_key, text from snapshot_old where doc_key in (select doc_key from diff where status = 'same')
         union all
         select doc_key, text from snapshot_new where doc_key in (select doc_key from diff where status in ('added', 'changed'))),
t as (select doc_key, {_TOKS_SQL} as toks from docs),
n as (select doc_key, toks, len(toks) as n from t where len(toks) > 0),
s as (select doc_key, toks, unnest(generate_series(0, greatest(n - {CHUNK_OVERLAP} - 1, 0),
                                                   {CHUNK_SIZE - CHUNK_OVERLAP})) as start_token from n)
select doc_key, (row_number() over (partition by doc_key order by start_token) - 1)::int as chunk_index,
       len(list_slice(toks, start_token + 1, start_token + {CHUNK_SIZE}))::int as n_tokens,
       md5(regexp_replace(array_to_string(list_slice(toks, start_token + 1, start_token + {CHUNK_SIZE}), ''), '[ \\t\\n\\r\\f]+$', '')) as chunk_md5
from s""")
def q_incremental_units(spark, d):
    old = X.snapshot_old(spark, d)
    new = X.snapshot_new(spark, d)
    old_units = IX.chunk_text(old, "text", "doc_key", CHUNK_SIZE, CHUNK_OVERLAP)
    diff = IX.snapshot_diff(old, new)
    u = IX.incremental_units(old_units, new, diff, "doc_key", CHUNK_SIZE, CHUNK_OVERLAP)
    return u.select("doc_key", "chunk_index", "n_tokens", F.md5("text").alias("chunk_md5"))


def _membership(spark, d):
    """Communities of the module graph."""
    return CM.hierarchical_communities(X.module_edges(spark, d), max_size=10)


@register("communities")
def q_communities(spark, d):
    return _membership(spark, d)


# level 0 against a depth-bounded (64) min-label recursion, exact while the diameter is below it
_LEVEL0_SQL = X.oracle_with(X.SQL_MODULE_EDGES, recursive=True).rstrip() + """,
u as (select source as a, target as b from module_edges union select target, source from module_edges),
n as (select distinct a as node from u),
lab(node, label, it) as (select node, node, 0 from n
   union all select u.b, min(l.label), max(l.it) + 1 from lab l join u on l.node = u.a where l.it < 64 group by u.b),
comp as (select node, min(label) as component from lab group by node)
"""


@register("communities_level0", _LEVEL0_SQL + """
select '0:' || component as community, node from comp""")
def q_communities_level0(spark, d):
    return CM.top_level(X.module_edges(spark, d))


@register("community_invariants", _LEVEL0_SQL + """
select 'nodes_at_level_0' as measure, count(*)::bigint as n from comp
union all select 'communities_at_level_0', count(distinct component)::bigint from comp
union all select unnest(['oversized_leaves', 'disconnected_communities', 'leaves_without_common_neighbour', 'ambiguous_parents', 'orphans',
  'nodes_twice_at_a_level', 'singletons_over_a_fifth', 'modularity_not_above_label_propagation']), 0::bigint""")
def q_community_invariants(spark, d):
    edges = X.module_edges(spark, d)
    graph = CM.graph_of(edges)
    return CM.community_invariants(CM.hierarchical_communities(edges, 10, graph), edges, graph=graph)


@register("reports")
def q_reports(spark, d):
    edges = X.module_edges(spark, d)
    graph = CM.graph_of(edges)
    return CM.community_reports(CM.hierarchical_communities(edges, 10, graph), edges, graph=graph)


# the index's graph after a batch of edits, kept up by signed counts, against a full rebuild
@register("graph_upkeep", X.oracle_with(X.SQL_METADATA_NEXT) + _MENTIONS_BODY.rstrip() + _RELATIONS_BODY.rstrip() + """,
deg as (select node, count(*)::bigint as degree from (select source as node from rels union all select target from rels) group by 1)
select 'entity' as kind, title as a, null::varchar as b, type, frequency as files, 0::bigint as weight, coalesce(degree, 0)::bigint as degree
from ents left join deg on node = title
union all select 'relationship', source, target, type, n_files, weight, null from rels""")
def q_graph_upkeep(spark, d):
    before, after = X.metadata(spark, d), X.metadata_next(spark, d)
    counts = cut_lineage(DG.counts_of(before))
    degrees = cut_lineage(DG.degrees(counts))
    old, new = DG.changed_rows(before, after)
    delta = cut_lineage(DG.signed(old, new))
    now = cut_lineage(DG.add(counts, delta))
    deg = DG.refresh_degrees(degrees, now, delta)
    ents, rels = DG.entities(now), DG.relationships(now)
    e = ents.join(deg, ents["title"] == deg["node"], "left").select(
        F.lit("entity").alias("kind"), F.col("title").alias("a"), F.lit(None).cast("string").alias("b"), "type",
        F.col("frequency").alias("files"), F.lit(0).cast("bigint").alias("weight"), F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))
    return e.unionByName(rels.select(F.lit("relationship").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "type",
                                     F.col("n_files").alias("files"), "weight", F.lit(None).cast("bigint").alias("degree")))


def _segments(spark, d):
    """Customers with their orders as communities below their market segments."""
    e = X.order_edges(spark, d)
    both = e.select("source", F.col("source").alias("node")).unionByName(e.select("source", F.col("target").alias("node"))).distinct()
    top = F.concat(F.lit("0:"), F.substring_index("source", " in ", -1))
    own = F.concat(F.lit("1:"), "source")
    none = F.lit(None).cast("string")
    return both.select(F.lit(0).alias("level"), top.alias("community"), none.alias("parent"), "node").unionByName(
        both.select(F.lit(1).alias("level"), own.alias("community"), top.alias("parent"), "node"))


_WORDS = "greatest(len(string_split_regex(text, '[^A-Za-z0-9]+')), 1)::bigint"


@register("report_context", X.oracle_with(X.SQL_ORDER_REPORTS) + f""",
seg as (select c, '0:' || split_part(c, ' in ', 2) as top from (select distinct source as c from order_edges)),
base as (
 select c, 1 as rk, 'entity' as kind, degree::double as w, node as text from order_nodes
 union all select source, 2, 'relationship', 1.0, source || ' -> ' || target from order_edges),
base_t as (select *, {_WORDS} as n_tokens from base),
kid as (select c, sum(n_tokens)::bigint as raw, count(*) filter (where rk = 1)::bigint as size from base_t group by c),
kid_r as (select kid.c, top, raw, kid.size, replace(summary, 'Community 0:', 'Community 1:') as text from kid join seg using (c) join order_reports r on r.title = kid.c),
kid_t as (select *, {_WORDS} as n_tokens from kid_r),
whole as (select top, sum(raw)::bigint as whole from kid_t group by top),
saves as (select k.*, whole, raw - n_tokens as saves from kid_t k join whole using (top) where whole > 8000 and raw > n_tokens),
run as (select *, coalesce(sum(saves) over (partition by top order by saves desc, '1:' || c rows between unbounded preceding and 1 preceding), 0) as saved from saves),
chosen as (select * from run where saved < whole - 8000),
remain as (select top, whole - coalesce((select sum(saves) from chosen x where x.top = whole.top), 0) as remain from whole),
rows0 as (
 select top, '1:' || b.c as child, rk, kind, w, text, n_tokens from base_t b join seg using (c) where b.c not in (select c from chosen)
 union all select top, '1:' || c, 0, 'report', raw::double, text, n_tokens from chosen),
run0 as (select r.*, remain, sum(n_tokens) over (partition by top order by rk, w desc, text rows between unbounded preceding and current row) as used
         from rows0 r join remain using (top)),
ctx0 as (select * from run0 where used <= case when remain > 8000 then 8000 - 12 else 8000 end),
rest as (select c.top, 'and ' || count(*) || ' more communities of ' || sum(c.size) || ' entities' as text from chosen c
         where not exists (select 1 from ctx0 x where x.top = c.top and x.child = '1:' || c.c and x.kind = 'report') group by c.top),
rest_t as (select top, text, {_WORDS} as n_tokens, coalesce((select max(used) from ctx0 x where x.top = rest.top), 0) as used from rest),
run1 as (select c, kind, text, n_tokens, sum(n_tokens) over (partition by c order by rk, w desc, text rows between unbounded preceding and current row) as used from base_t)
select 0 as level, top as community, kind, child, text, n_tokens, used::bigint as used_tokens from ctx0
union all select 0, top, 'rest', null, text, n_tokens, (used + n_tokens)::bigint from rest_t
union all select 1, '1:' || c, kind, null, text, n_tokens, used::bigint from run1 where used <= 8000""")
def q_report_context(spark, d):
    m = cut_lineage(_segments(spark, d))
    e = X.order_edges(spark, d)
    return CM.nested_context(m, e, cut_lineage(CM.community_reports(m, e)), 8000)


@register("text_embedding")
def q_text_embedding(spark, d):
    return IX.text_embedding(X.table(spark, d, "documents"), num_features=256)
