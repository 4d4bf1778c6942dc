"""Registered corpus-preparation queries (scan passes, prompts, JSON, headers, winners)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweave.functions import mappings as M
from codeweave.functions.text import extract_json
from codeweave.operators import blocks as B
from codeweave.operators import completion as C
from codeweave.operators import generation as GEN
from codeweave.plans import fixtures as X
from codeweave.plans.registry import register

LANGUAGES = ["python", "java", "shell", "ansible"]
SMALL_CUTOFF = 5000   # the real cutoff (200,000) rejects nothing in the test corpus


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_list(xs) -> str:
    return "[" + ", ".join(_q(x) for x in xs) + "]::varchar[]"


def _sql_plan(languages) -> str:
    rows = [f"({seq}, {_q(lang)}, {str(cfg).lower()}, {_q(e)}, {_sql_list(dirs)})"
            for seq, lang, cfg, exts, dirs in M.pass_plan(languages) for e in exts]
    return "plan(pass_seq, language, is_config, ext, pruned_dirs) as (values " + ", ".join(rows) + ")"


_SPLITEXT_SQL = r"regexp_extract(file_path, '^(?:.*/)?\.*[^/]*?[^./][^/]*?(\.[^./]*)$', 1)"
_DIRS_SQL = "list_slice(string_split(file_path, '/'), 1, len(string_split(file_path, '/')) - 1)"
_NORM_SQL = "regexp_replace(code, '\\r\\n?', chr(10), 'g')"


def _passes_sql(cutoff: int) -> str:
    return X.oracle_with(X.SQL_CODE_FILES, _sql_plan(LANGUAGES)) + f""",
passes as (
 select f.*, p.pass_seq, p.language, p.is_config,
   case when list_has_any({_DIRS_SQL}, p.pruned_dirs) then 'pruned_dir'
        when size_bytes > {cutoff} then 'too_large' end as reason
 from code_files f join plan p on {_SPLITEXT_SQL} = p.ext)
"""


@register("code_scan_filter", _passes_sql(M.MAX_FILE_BYTES) + f"""
select doc_id, pass_seq, language, is_config, git_repo, file_path, size_bytes,
       md5({_NORM_SQL}) as code_md5, length({_NORM_SQL})::bigint as code_chars
from passes where reason is null""")
def q_code_scan_filter(spark, d):
    s = GEN.select_passes(X.code_files(spark, d), LANGUAGES)
    return s.select("doc_id", "pass_seq", "language", "is_config", "git_repo", "file_path", "size_bytes",
                    F.md5("code").alias("code_md5"), F.length("code").cast("bigint").alias("code_chars"))


@register("skipped_files", _passes_sql(SMALL_CUTOFF) + """
select pass_seq, language, file_path, size_bytes, reason from passes where reason is not null""")
def q_skipped_files(spark, d):
    return GEN.skipped_files(X.code_files(spark, d), LANGUAGES, SMALL_CUTOFF)


def _render_sql(template: str) -> str:
    out = _q(template)
    for var in ("language", "file_path", "git_repo"):
        out = f"replace({out}, '{{{{{var}}}}}', coalesce({var}, ''))"
    return f"replace({out}, '{{{{code}}}}', coalesce({_NORM_SQL}, ''))"


def _prompt_sql() -> str:
    (rs, ss), (ru, su) = GEN.prompt_templates(False)
    (_, cs), (_, cu) = GEN.prompt_templates(True)
    return _passes_sql(M.MAX_FILE_BYTES) + f""",
r as (select doc_id, pass_seq,
        case when is_config then {_render_sql(cs)} else {_render_sql(ss)} end as sys_c,
        case when is_config then {_render_sql(cu)} else {_render_sql(su)} end as usr_c
      from passes where reason is null)
select doc_id, pass_seq, md5(sys_c) as system_md5, md5(usr_c) as user_md5,
       (length(sys_c) + length(usr_c))::bigint as prompt_chars from r"""


@register("prompt_render", _prompt_sql())
def q_prompt_render(spark, d):
    s = GEN.render_prompts(GEN.select_passes(X.code_files(spark, d), LANGUAGES))
    sys_c, usr_c = F.col("messages")[0]["content"], F.col("messages")[1]["content"]
    return s.select("doc_id", "pass_seq", F.md5(sys_c).alias("system_md5"), F.md5(usr_c).alias("user_md5"),
                    (F.length(sys_c) + F.length(usr_c)).cast("bigint").alias("prompt_chars"))


_SPAN_SQL = r"nullif(regexp_extract(text, '(?s)\{.*\}|\[.*\]', 0), '')"


@register("extract_json", X.oracle_with(X.SQL_LLM_TEXT) + f""",
s as (select event_id, {_SPAN_SQL} as span from llm_text),
v as (select event_id, case when json_valid(span) then span end as j from s)
select event_id, lower(json_type(j)) as kind, json_extract(j, '$.k')::bigint as k from v""")
def q_extract_json(spark, d):
    t = X.llm_text(spark, d).withColumn("v", extract_json("text"))
    return t.select("event_id", GEN.variant_kind("v").alias("kind"),
                    F.try_variant_get("v", "$.k", "bigint").alias("k"))


@register("flatten_json", X.oracle_with(X.SQL_METADATA) + """
select doc_id, 'file_path' as key, file_path as value from metadata
union all select doc_id, 'git_repo', git_repo from metadata
union all select doc_id, 'package', package from metadata
union all select doc_id, 'purpose', purpose from metadata
union all select doc_id, 'imports_' || (generate_subscripts(imports, 1) - 1), unnest(imports) from metadata
union all select doc_id, 'classes_' || (generate_subscripts(classes, 1) - 1), unnest(classes) from metadata
union all select doc_id, 'methods_0_method_name', method_name from metadata
union all select doc_id, 'methods_0_callees_' || (generate_subscripts(callees, 1) - 1), unnest(callees) from metadata""")
def q_flatten_json(spark, d):
    return GEN.flatten_metadata(X.metadata_json_text(spark, d), "text", ["doc_id"])


def _delims_sql() -> str:
    rows = [f"('language', {_q(k)}, {_q(b)}, {_q(e)})" for k, (b, e) in M.SOURCE_COMMENT_DELIMITERS.items()]
    rows += [f"('extension', {_q(k)}, {_q(b)}, {_q(e)})" for k, (b, e) in M.CONFIG_COMMENT_DELIMITERS.items()]
    return "delims(kind, key, b, e) as (values " + ", ".join(rows) + ")"


def _header_sql() -> str:
    nl = "chr(10)"
    return X.oracle_with(X.SQL_METADATA, _delims_sql()) + f""",
h as (
 select m.*, case when is_config then de.b else dl.b end as cb, case when is_config then de.e else dl.e end as ce,
  list_concat(
   ['This file is located at ' || file_path || ' from repository ' || git_repo || '.'],
   case when coalesce(package, '') <> '' then [{nl} || ' Package: ' || package] else [] end,
   case when coalesce(purpose, '') <> '' then [{nl} || ' Purpose: ' || purpose] else [] end,
   case when len(imports) > 0 then list_concat([{nl} || 'Dependencies:'],
        list_transform(imports, lambda i: '- ' || file_path || ' imports ' || i)) else [] end,
   case when len(classes) > 0 then list_concat([{nl} || ' Classes:'], list_transform(classes, lambda c: '- ' || c)) else [] end,
   [{nl} || ' Methods:', '- ' || to_json({{'method_name': method_name, 'callees': callees}})]
  ) as lines
 from metadata m
 left join delims dl on dl.kind = 'language' and dl.key = m.language
 left join delims de on de.kind = 'extension' and de.key = {_SPLITEXT_SQL.replace('file_path', 'm.file_path')})
"""


def _md_header_input(spark, d):
    md = X.metadata(spark, d)
    return md.select("*", F.col("file_path").alias("md_file_path"), F.col("git_repo").alias("md_git_repo"),
                     F.array(F.to_json(F.struct("method_name", "callees"))).alias("methods"))


@register("comment_header", _header_sql() + """
select doc_id, cb || array_to_string(lines, chr(10)) || ce as header from h""")
def q_comment_header(spark, d):
    return GEN.comment_header(_md_header_input(spark, d)).select("doc_id", "header")


@register("annotated_text", _header_sql().rstrip() + """,
a as (select h.doc_id, h.file_path, cb || array_to_string(lines, chr(10)) || ce as header, d.text as code
      from h join documents d on d.doc_id = h.doc_id)
select doc_id, regexp_replace(file_path, '([^/])\\.[^./]+$', '\\1') || '.txt' as target_path,
       regexp_replace(file_path, '([^/])\\.[^./]+$', '\\1') || '_metadata.txt' as metadata_path,
       md5(coalesce(header, '') || chr(10) || code) as text_md5 from a""")
def q_annotated_text(spark, d):
    h = GEN.comment_header(_md_header_input(spark, d))
    docs = X.table(spark, d, "documents").select("doc_id", F.col("text").alias("code"))
    a = GEN.annotated_text(h.join(docs, "doc_id"))
    return a.select("doc_id", "target_path", "metadata_path", F.md5("text").alias("text_md5"))


@register("target_path_winner", _passes_sql(M.MAX_FILE_BYTES) + """,
t as (select doc_id, git_repo, pass_seq, file_path,
        regexp_replace(file_path, '([^/])\\.[^./]+$', '\\1') || '.txt' as target_path
      from passes where reason is null),
r as (select *, row_number() over (partition by git_repo, target_path
                                   order by pass_seq desc, file_path desc, doc_id desc) as rn,
             count(*) over (partition by git_repo, target_path) as n_writers from t)
select git_repo, target_path, file_path, pass_seq, doc_id, n_writers::bigint as n_writers from r where rn = 1""")
def q_target_path_winner(spark, d):
    s = GEN.annotated_text(GEN.select_passes(X.code_files(spark, d), LANGUAGES).withColumn("header", F.lit("")))
    w = GEN.target_path_winner(s, ["pass_seq", "file_path", "doc_id"])
    return w.select("git_repo", "target_path", "file_path", "pass_seq", "doc_id", "n_writers")


@register("reconcile_missing", X.oracle_with(X.SQL_CODE_FILES) + """
select distinct file_path from code_files
where file_path not in (select c.file_path from code_files c join labels l on c.doc_id = l.doc_id
                        where l.quality = 1)""")
def q_reconcile_missing(spark, d):
    files = X.code_files(spark, d)
    lab = X.table(spark, d, "labels").where(F.col("quality") == 1).select("doc_id")
    processed = files.join(lab, "doc_id", "left_semi")
    return GEN.reconcile_missing(files, processed)


@register("metadata_accept", X.oracle_with(X.SQL_LLM_TEXT) + f""",
s as (select event_id, {_SPAN_SQL} as span from llm_text),
v as (select event_id, case when json_valid(span) then span end as j from s)
select event_id, case when j is null then 'no_metadata' when json_type(j) <> 'OBJECT' then 'not_an_object'
                      when j::json::varchar = '{{}}' then 'no_metadata' end as reject_reason from v""")
def q_metadata_accept(spark, d):
    t = GEN.accept_metadata(GEN.parse_metadata_text(X.llm_text(spark, d)))
    return t.select("event_id", "reject_reason")


MODEL = "test-model"
SUMMARY_PROMPT = "Summarize the document."


def _doc_prompts(docs):
    return docs.select("doc_id", F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SUMMARY_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"))


@register("completion_cache_miss", f"""
with k as (select doc_id, sha256('{MODEL}' || chr(31) || 'system' || chr(30) || '{SUMMARY_PROMPT}'
                                 || chr(31) || 'user' || chr(30) || text) as prompt_key from documents),
cached as (select distinct k.prompt_key from k join labels l on k.doc_id = l.doc_id)
select prompt_key, count(*)::bigint as n_rows from k
where prompt_key not in (select prompt_key from cached) group by prompt_key""")
def q_completion_cache_miss(spark, d):
    docs = X.table(spark, d, "documents")
    keyed = C.with_prompt_key(_doc_prompts(docs), MODEL)
    cache = keyed.join(X.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("prompt_key")
    todo = C.cache_misses(keyed, cache).select("prompt_key")
    # rows that share each missing prompt (exact duplicate documents share one call)
    return keyed.join(todo, "prompt_key", "left_semi").groupBy("prompt_key").agg(
        F.count(F.lit(1)).alias("n_rows"))


FLOW = [
    {"block_type": "drop", "block_config": {"input_cols": ["n_chars", "source"]}},
]


@register("drop_columns", "select doc_id, text, lang from documents")
def q_drop_columns(spark, d):
    return B.run_flow(X.table(spark, d, "documents"), FLOW)
