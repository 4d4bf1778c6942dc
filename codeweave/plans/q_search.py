"""Registered search queries: global (dynamic/static), migration report, vectors, local."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeweave.operators import communities as CM
from codeweave.operators import graph as G
from codeweave.operators import report_index as RI
from codeweave.operators import search as S
from codeweave.plans import fixtures as X
from codeweave.plans.registry import register
from codeweave.session import cut_lineage

QUESTION = S.MIGRATION_QUESTIONS[0]
TOP_K = 5


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _reports_sql(terms: list[str], name: str = "reports") -> str:
    tl = "[" + ", ".join(_q(t) for t in terms) + "]::varchar[]"
    return f"""
{name}_doc as (select source, lang,
   len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: list_contains({tl}, w)))::bigint as hits,
   len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))::bigint as words from documents),
{name}_l1 as (select source, lang, sum(hits) as score, sum(words) as w from {name}_doc group by 1, 2),
{name}_l0 as (select source, sum(score) as score, sum(w) as w from {name}_l1 group by 1),
{name} as (
 select source as community, 0 as level, null::varchar as parent, score::bigint as score,
        least(w, {S.REPORT_MAX_TOKENS})::bigint as n_tokens from {name}_l0
 union all
 select source || '/' || lang, 1, source, score::bigint, least(w, {S.REPORT_MAX_TOKENS})::bigint from {name}_l1)"""


def _ranked_sql(sel: str, name: str) -> str:
    return f"""
{name}_r as (select *, row_number() over (order by score desc, community) as rank from {sel}
             where score > 0 and n_tokens > 0),
{name} as (select *, sum(n_tokens) over (order by rank rows between unbounded preceding and current row) as used_tokens
           from {name}_r)"""


def _dynamic_sql(n: str) -> str:
    return f"""
{n}_rel as (select * from {n}_rep where score > 0 and level <= {S.COMMUNITY_LEVEL}),
{n}_kids as (select * from {n}_rel where level = 1 and parent in (select community from {n}_rel where level = 0)),
{n}_sel as (select * from {n}_rel where level = 0 and community not in (select parent from {n}_kids)
            union all select * from {n}_kids)"""


def _global_sql(question: str, n: str = "g") -> str:
    return ",".join([_reports_sql(S.question_terms(question), f"{n}_rep"), _dynamic_sql(n),
                     _ranked_sql(f"{n}_sel", n)])


@register("global_search", "with " + _global_sql(QUESTION) + f"""
select community, level, score, n_tokens, rank::int as rank, used_tokens::bigint as used_tokens
from g where used_tokens <= {S.CONTEXT_BUDGET}""")
def q_global_search(spark, d):
    r = S.global_search(X.table(spark, d, "documents"), QUESTION, dynamic=True)
    return r.select("community", "level", "score", "n_tokens", "rank", F.col("used_tokens").cast("bigint"))


@register("global_search_static", "with " + _reports_sql(S.question_terms(QUESTION), "s_rep") + """,
s_sel as (select * from s_rep where community not in (select parent from s_rep where parent is not null)),"""
          + _ranked_sql("s_sel", "s") + f"""
select community, level, score, n_tokens, rank::int as rank, used_tokens::bigint as used_tokens
from s where used_tokens <= {S.CONTEXT_BUDGET}""")
def q_global_search_static(spark, d):
    r = S.global_search(X.table(spark, d, "documents"), QUESTION, dynamic=False)
    return r.select("community", "level", "score", "n_tokens", "rank", F.col("used_tokens").cast("bigint"))


def _migration_sql() -> str:
    ctes, sels = [], []
    for i, q in enumerate(S.MIGRATION_QUESTIONS):
        n = f"q{i}"
        ctes.append(_global_sql(q, n))
        head = _q(f"### Question: {q}\n\n###Answer: ")
        sels.append(f"""select {i} as question_no, {head} || coalesce(
            (select string_agg(community || ' (' || score || ')', '; ' order by rank) from {n}
             where used_tokens <= {S.CONTEXT_BUDGET}), 'No relevant reports.') || chr(10) || chr(10) as section""")
    return "with " + ",".join(ctes) + "\n" + "\nunion all\n".join(sels)


@register("migration_report", _migration_sql())
def q_migration_report(spark, d):
    return S.migration_report(X.table(spark, d, "documents"))


_VEC_SQL = """
with e as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
c as (select label, i, avg(x) as m from e group by 1, 2),
qn as (select label, sqrt(sum(m * m)) as nq from c group by 1),
vn as (select vec_id, sqrt(sum(x * x)) as nv from e group by 1),
dt as (select c.label, e.vec_id, sum(c.m * e.x) as d from c join e on c.i = e.i group by 1, 2),
s as (select dt.label::bigint as query_id, dt.vec_id as id,
             case when nv = 0 then 0 else d / (nq * nv) end as score
      from dt join qn on dt.label = qn.label join vn on dt.vec_id = vn.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s),
top as (select query_id, id, round(score, 6) as score, rank::int as rank from r where rank <= 5)
"""


@register("vector_topk", _VEC_SQL + "select * from top")
def q_vector_topk(spark, d):
    emb = X.table(spark, d, "embeddings")
    top = S.vector_topk(emb, S.label_centroids(emb), k=TOP_K)
    return top.select(F.col("query_id").cast("bigint").alias("query_id"), "id", "score", "rank")


@register("local_search", _VEC_SQL + f""",
u as (select doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))::bigint as n_tokens
      from documents),
j as (select top.*, u.n_tokens, sum(u.n_tokens) over (partition by query_id order by rank, id
        rows between unbounded preceding and current row) as used_tokens from top join u on top.id = u.doc_id)
select query_id, id, rank, n_tokens, used_tokens::bigint as used_tokens from j where used_tokens <= {S.CONTEXT_BUDGET}""")
def q_local_search(spark, d):
    emb = X.table(spark, d, "embeddings")
    hits = S.vector_topk(emb, S.label_centroids(emb), k=TOP_K)
    units = X.table(spark, d, "documents").select("doc_id", S.word_count("text").cast("bigint").alias("n_tokens"))
    r = S.local_search(hits, units)
    return r.select(F.col("query_id").cast("bigint").alias("query_id"), "id", "rank", "n_tokens",
                    F.col("used_tokens").cast("bigint"))


# ------------------------------------------- search over community reports
REPORT_QUESTION = "Which customers in machinery have urgent orders that are still open (status O), and how many relationships do they have?"


def _order_index(spark, d) -> dict:
    """Reports of the order graph's components (level 0) with their search tables."""
    edges = X.order_edges(spark, d)
    comp = G.connected_components(edges)
    members = cut_lineage(comp.select(F.lit(0).alias("level"), F.concat(F.lit("0:"), "component").alias("community"),
                                      F.lit(None).cast("string").alias("parent"), "node"))
    reports = cut_lineage(CM.community_reports(members, edges))
    return {"community_reports": reports, "communities": cut_lineage(CM.community_table(members)),
            **{name: cut_lineage(t) for name, t in RI.build(reports).items()}}


def _bm25_sql(terms: list[str], n: str = "b") -> str:
    tl = "[" + ", ".join(_q(t) for t in terms) + "]::varchar[]"
    return f"""
{n}_w as (select community, list_filter(string_split_regex(lower(summary || ' ' || full_content), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') as words from order_reports),
{n}_c as (select count(*)::bigint as n, sum(len(words))::bigint as total from {n}_w),
{n}_t as (select community, len, term, count(*)::bigint as tf from (select community, len(words)::bigint as len, unnest(words) as term from {n}_w) group by all),
{n}_d as (select term, floor(1000 * ln(1 + (n::double - count(*) + 0.5) / (count(*) + 0.5)))::bigint as w from {n}_t, {n}_c
          where list_contains({tl}, term) group by term, n),
{n} as (select community, sum(w * ((2200000000 * tf) // (1000 * tf + 300 + (900 * len * n) // total)))::bigint as score
        from {n}_t join {n}_d using (term), {n}_c group by community having score > 0)"""


@register("report_topk", X.oracle_with(X.SQL_ORDER_REPORTS).rstrip() + "," + _bm25_sql(S.question_terms(REPORT_QUESTION)) + """
select community, score from b order by score desc, community limit 25""")
def q_report_topk(spark, d):
    return RI.top_reports(_order_index(spark, d), S.question_terms(REPORT_QUESTION), 25)


_REPORT_WORDS = "len(list_filter(string_split_regex(summary || ' ' || full_content, '[ \t\n\r\f]+'), lambda w: w <> ''))::bigint"


def _report_search_sql(question: str, n: str) -> str:
    return _bm25_sql(S.question_terms(question), n + "b") + f""",
{n}_s as (select community, title, summary, score, {_REPORT_WORDS} as n_tokens from {n}b join order_reports using (community)),
{n}_r as (select *, row_number() over (order by score desc, community) as rank from {n}_s),
{n} as (select *, sum(n_tokens) over (order by rank rows between unbounded preceding and current row) as used_tokens from {n}_r)"""


@register("report_search", X.oracle_with(X.SQL_ORDER_REPORTS).rstrip() + "," + _report_search_sql(REPORT_QUESTION, "g") + f"""
select community, title, score, n_tokens, rank::int as rank, used_tokens::bigint as used_tokens from g where used_tokens <= {S.CONTEXT_BUDGET}""")
def q_report_search(spark, d):
    r = S.search_reports(_order_index(spark, d), REPORT_QUESTION)
    return r.select("community", "title", "score", "n_tokens", "rank", F.col("used_tokens").cast("bigint"))


_ORDER_QUESTIONS = [REPORT_QUESTION, "Which orders of the building segment are low?", "Is there any vulnerability?"]


def _report_questions_sql() -> str:
    ctes = [_report_search_sql(q, f"q{i}") for i, q in enumerate(_ORDER_QUESTIONS)]
    rows = [f"""select {i} as question_no, {_q(f"### Question: {q}{chr(10) * 2}###Answer: ")} || coalesce(
      (select string_agg(title || ' (' || score || '): ' || summary, chr(10) order by rank) from q{i} where used_tokens <= {S.CONTEXT_BUDGET}),
      'No relevant reports.') || chr(10) || chr(10) as section""" for i, q in enumerate(_ORDER_QUESTIONS)]
    return X.oracle_with(X.SQL_ORDER_REPORTS).rstrip() + "," + ",".join(ctes) + "\n" + "\nunion all\n".join(rows)


@register("report_questions", _report_questions_sql())
def q_report_questions(spark, d):
    return S.index_migration_report(_order_index(spark, d), _ORDER_QUESTIONS)


# the largest customers as hits: entities, relationships and text units under a budget
@register("local_context", X.oracle_with(X.SQL_ORDER_EDGES) + """,
hit as (select source, row_number() over (order by count(*) desc, source) as rank from order_edges group by source qualify rank <= 3),
units as (select c_name||' in '||lower(c_mktsegment) as title, o_orderkey as unit_id, 'order '||o_orderkey||' has '||count(l_orderkey)||' lines' as text
          from orders join customer on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by 1, 2),
ctx as (select rank % 2 as query_id, 'entity' as kind, rank, 0.0::double as w, source as text from hit
        union all select distinct rank % 2, 'relationship', rank, 1.0, source||' PLACED '||target from order_edges join hit using (source)
        union all select rank % 2, 'text_unit', rank, -unit_id::double, text from units join hit on title = source),
t as (select *, len(list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda w: w <> ''))::bigint as n_tokens from ctx),
r as (select *, sum(n_tokens) over (partition by query_id order by kind, rank, w desc, text rows between unbounded preceding and current row) as used from t)
select query_id::int as query_id, kind, rank::int as rank, text, n_tokens, used::bigint as used_tokens from r where used <= 300""")
def q_local_context(spark, d):
    e = cut_lineage(X.order_edges(spark, d))
    top = e.groupBy("source").agg(F.count(F.lit(1)).alias("score")).orderBy(F.desc("score"), "source").limit(3)
    hits = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "source"))) \
        .select((F.col("rank") % 2).alias("query_id"), F.col("source").alias("id"), "score", "rank")
    lines = X.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit_id")).agg(F.count(F.lit(1)).alias("n"))
    o = X.table(spark, d, "orders").join(X.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")) \
        .select(F.concat("c_name", F.lit(" in "), F.lower("c_mktsegment")).alias("title"), F.col("o_orderkey").alias("unit_id"))
    units = o.join(lines, "unit_id", "left").select("title", "unit_id", F.concat(
        F.lit("order "), F.col("unit_id").cast("string"), F.lit(" has "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" lines")).alias("text"))
    rel = e.select("source", "target", F.lit("PLACED").alias("type"), F.lit(1.0).alias("weight"))
    return S.one_hop_context(hits, rel, 300, units).select("query_id", "kind", "rank", "text", "n_tokens", "used_tokens")
