"""Deterministic views over the test tables, as DataFrames and as DuckDB SQL.

Every view reads whole tables: node names, paths and flags are *derived* from
keys, but no view drops rows by id ranges or modulo tests to stay cheap.  Each
view exists twice -- a DataFrame builder (what the engine runs) and a SQL CTE
(what the oracle runs); ``oracle_with(...)`` stitches the CTEs a query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- code files
def code_files(spark, d) -> DataFrame:
    """One row per (synthetic) source file: every extension/prune/collision class."""
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    path = F.concat(
        F.lit("pkg"), (i % 7).cast("string"), F.lit("/"),
        F.when(i % 11 == 0, "node_modules/").when(i % 13 == 0, "build/").otherwise(""),
        F.when(i % 17 == 0, F.lit("__init__")).otherwise(F.concat(F.lit("f"), (i % 300).cast("string"))),
        F.element_at(F.array(*[F.lit(x) for x in [".py", ".pyi", ".toml", ".java", ".env", ".TXT"]]),
                     (i % 6 + 1).cast("int")),
    )
    return docs.select("doc_id", F.col("source").alias("git_repo"), path.alias("file_path"),
                       F.col("n_chars").alias("size_bytes"), F.col("text").alias("code"))


SQL_CODE_FILES = """code_files as (
 select doc_id, source as git_repo,
  'pkg'||(doc_id%7)||'/'
  ||case when doc_id%11=0 then 'node_modules/' when doc_id%13=0 then 'build/' else '' end
  ||case when doc_id%17=0 then '__init__' else 'f'||(doc_id%300) end
  ||case doc_id%6 when 0 then '.py' when 1 then '.pyi' when 2 then '.toml'
      when 3 then '.java' when 4 then '.env' else '.TXT' end as file_path,
  n_chars as size_bytes, text as code
 from documents)"""


def python_files(spark, d) -> DataFrame:
    """Python files that import one another by number, with imports in comments and strings that don't count; the text is a docstring."""
    i = F.col("doc_id")
    s = lambda x: x.cast("string")
    nl = F.lit("\n")
    mod = lambda x: F.concat(F.lit("pkg"), s(x % 7), F.lit(".mod"), s(x))
    code = F.concat(
        F.lit('"""'), F.translate("text", '"\\', ""), F.lit('"""'), nl, F.lit("import "), mod(i * 3 + 1), F.lit(", os.path  # import "), mod(i + 1), nl,
        F.lit("from "), mod(F.expr("doc_id div 2")), F.lit(" import x"), nl, F.lit("from .mod"), s(i + 7), F.lit(" import y"), nl,
        F.lit("s = 'import "), F.col("lang"), F.lit("'"), nl, F.lit("# import "), F.col("source"), nl)
    return table(spark, d, "documents").select(F.concat(F.lit("src/pkg"), s(i % 7), F.lit("/mod"), s(i), F.lit(".py")).alias("file_path"), F.lit("python").alias("language"), code.alias("code"))


SQL_PYTHON_IMPORTS = """pf as (select 'src/pkg'||(doc_id%7)||'/mod'||doc_id||'.py' as path, 'pkg'||(doc_id%7)||'.mod'||doc_id as module, doc_id from documents),
pi as (
 select distinct path, name from (
  select path, 'pkg'||((doc_id*3+1)%7)||'.mod'||(doc_id*3+1) as name from pf union all select path, 'os.path' from pf
  union all select path, 'pkg'||((doc_id//2)%7)||'.mod'||(doc_id//2) from pf union all select path, '.mod'||(doc_id+7) from pf))"""


# ------------------------------------------------------------ model answers
def llm_text(spark, d) -> DataFrame:
    """Completion-like texts: JSON amid prose, bare, none, malformed, null."""
    ev = table(spark, d, "events")
    i = F.col("event_id") % 5
    txt = (F.when(i == 0, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done")))
           .when(i == 1, F.col("props")).when(i == 2, F.lit("none"))
           .when(i == 3, F.lit("{bad}")).otherwise(F.lit(None).cast("string")))
    return ev.select("event_id", txt.alias("text"))


SQL_LLM_TEXT = """llm_text as (
 select event_id, case event_id%5 when 0 then 'Sure: '||props||' done' when 1 then props
  when 2 then 'none' when 3 then '{bad}' else null end as text from events)"""


# ------------------------------------------------------------ module graph
def module_edges(spark, d) -> DataFrame:
    """Directed module graph from every lineitem: part module -> supplier module.

    Shared 'mod.<key>' namespace, so supplier keys that are also part keys form
    a cyclic core; the rest hang off it.  Grows linearly with lineitem.
    """
    li = table(spark, d, "lineitem")
    return (li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("weight"))   # names are made of groups, not of rows
            .select(F.concat(F.lit("mod."), F.col("l_partkey").cast("string")).alias("source"),
                    F.concat(F.lit("mod."), F.col("l_suppkey").cast("string")).alias("target"), "weight"))


SQL_MODULE_EDGES = """module_edges as (
 select 'mod.'||l_partkey as source, 'mod.'||l_suppkey as target, count(*)::bigint as weight
 from lineitem group by 1, 2)"""


def trade_edges(spark, d) -> DataFrame:
    """Nation -> nation trade graph (customer nation buys from supplier nation)."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    cn = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("source"))
    sn = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("target"))
    j = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
         .join(cn, "c_nationkey").join(s, li.l_suppkey == s.s_suppkey)
         .join(sn, "s_nationkey"))
    return j.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


SQL_TRADE_EDGES = """trade_edges as (
 select cn.n_name as source, sn.n_name as target, count(*)::bigint as weight
 from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey
 join nation cn on c_nationkey=cn.n_nationkey join supplier on l_suppkey=s_suppkey
 join nation sn on s_nationkey=sn.n_nationkey group by 1, 2)"""


# --------------------------------------------------------- dialogue graphs
def dialogue_steps(spark, d) -> DataFrame:
    """Turns of conversations, three nodes each at most: many components, cycles of three where there are four turns or more."""
    t = table(spark, d, "conversations").select("conv_id", "turn")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"))

    def node(turn):
        return F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), (turn % 3).cast("string"))

    return t.join(nxt, ["conv_id", "turn"]).select(node(F.col("turn")).alias("source"), node(F.col("turn") + 1).alias("target")).distinct()


def dialogue_edges(spark, d) -> DataFrame:
    """The steps, and an edge from each conversation to the one of half its number: one component, deep and with many cycles."""
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    up = ids.where("conv_id > 0").select("conv_id", F.expr("conv_id div 2").alias("half")).join(ids.withColumnRenamed("conv_id", "half"), "half")
    start = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"), F.lit(".0"))
    return dialogue_steps(spark, d).unionByName(up.select(start("conv_id").alias("source"), start("half").alias("target")))


SQL_DIALOGUE_STEPS = """dialogue_steps as (
 select distinct 'c'||a.conv_id||'.'||(a.turn%3) as source, 'c'||b.conv_id||'.'||(b.turn%3) as target
 from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"""

SQL_DIALOGUE_EDGES = SQL_DIALOGUE_STEPS + """,
dialogue_edges as (
 select source, target from dialogue_steps union all
 select distinct 'c'||conv_id||'.0', 'c'||(conv_id//2)||'.0' from conversations
 where conv_id > 0 and conv_id//2 in (select conv_id from conversations))"""


# ------------------------------------------------------------ order graph
def order_edges(spark, d) -> DataFrame:
    """Customers and their orders: a component a customer."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.concat("c_name", F.lit(" in "), F.lower("c_mktsegment")).alias("source"),
                    F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.lower("o_orderpriority"), F.lit(" status "), "o_orderstatus").alias("target"))


SQL_ORDER_EDGES = """order_edges as (
 select c_name||' in '||lower(c_mktsegment) as source, 'order '||o_orderkey||' '||lower(o_orderpriority)||' status '||o_orderstatus as target
 from orders join customer on o_custkey = c_custkey)"""

#: Reports of the order graph's components, as ``communities.community_reports`` words them.
SQL_ORDER_REPORTS = SQL_ORDER_EDGES + """,
order_nodes as (select source as c, source as node, count(*) as degree from order_edges group by 1
                union all select source, target, 1 from order_edges),
order_members as (select *, row_number() over (partition by c order by degree desc, node) as rk from order_nodes),
order_reports as (
 select '0:' || c as community, c as title, count(*)::bigint as size, (count(*) - 1)::bigint as n_edges,
        'Community 0:' || c || ' of ' || count(*) || ' entities around ' || c || ' with ' || (count(*) - 1) || ' internal relationships.' as summary,
        '# ' || c || chr(10) || chr(10) || 'Key entities:' || chr(10)
        || string_agg(node || ' (degree ' || degree || ')', chr(10) order by rk) filter (where rk <= 10) as full_content
 from order_members group by c)"""


# ------------------------------------------------------- index relationships
def relationships(spark, d) -> DataFrame:
    """Index-style relationships: part name -> supplier name, with descriptions."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    ln = F.col("l_linenumber") % 3
    desc = (F.when(ln == 0, F.concat(F.col("p_brand"), F.lit(" imports "), F.col("s_name")))
            .when(ln == 1, F.concat(F.lit("Depends on "), F.col("s_name")))
            .otherwise(F.concat(F.lit("calls "), F.col("s_name"))))
    w = F.when(F.col("l_linenumber") == 4, F.lit(None).cast("double")).otherwise(F.col("l_quantity").cast("double"))
    return j.select(F.col("p_name").alias("source"), F.col("s_name").alias("target"),
                    desc.alias("description"), w.alias("weight"))


SQL_RELATIONSHIPS = """relationships as (
 select p_name as source, s_name as target,
  case l_linenumber%3 when 0 then p_brand||' imports '||s_name
    when 1 then 'Depends on '||s_name else 'calls '||s_name end as description,
  case when l_linenumber=4 then null else cast(l_quantity as double) end as weight
 from lineitem join part on l_partkey=p_partkey join supplier on l_suppkey=s_suppkey)"""


def entities(spark, d) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_name").alias("title"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("title"))
    return p.union(s).distinct()


SQL_ENTITIES = """entities as (
 select distinct p_name as title from part union select distinct s_name from supplier)"""


# ---------------------------------------------------------------- metadata
def metadata(spark, d) -> DataFrame:
    """Typed per-file metadata, as a model would return it for source/config files."""
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    s = lambda x: x.cast("string")
    return docs.select(
        "doc_id",
        F.concat(F.lit("pkg"), s(i % 7), F.lit("/f"), s(i),
                 F.when(i % 4 == 1, F.lit(".yaml")).otherwise(F.lit(".py"))).alias("file_path"),
        (i % 4 == 1).alias("is_config"),
        F.col("source").alias("git_repo"),
        F.element_at(F.array(F.lit("java"), F.lit("python"), F.lit("ruby")), (i % 3 + 1).cast("int")).alias("language"),
        F.when(i % 9 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("org."), F.col("lang"))).alias("package"),
        F.when(i % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("purpose "), s(i % 10))).alias("purpose"),
        F.when(i % 5 == 0, F.array().cast("array<string>"))
         .otherwise(F.array(F.concat(F.lit("lib"), s(i % 12)), F.concat(F.lit("lib"), s(i % 5)))).alias("imports"),
        F.array(F.concat(F.lit("C"), s(i))).alias("classes"),
        F.concat(F.lit("m"), s(i)).alias("method_name"),
        F.array(F.concat(F.lit("m"), s((i * 7) % 1500)), F.concat(F.lit("m"), s((i * 3) % 1500))).alias("callees"),
        F.concat(F.lit("lib"), s(i % 12)).alias("library_name"),
        F.concat(F.lit("1."), s(i % 4)).alias("library_version"),
        F.when(i % 6 == 0, F.array(F.concat(F.lit("CVE-"), s(i % 3)))).otherwise(F.array().cast("array<string>")).alias("vulnerabilities"),
    )


SQL_METADATA = """metadata as (
 select doc_id, 'pkg'||(doc_id%7)||'/f'||doc_id||case when doc_id%4=1 then '.yaml' else '.py' end as file_path,
  doc_id%4=1 as is_config, source as git_repo,
  case doc_id%3 when 0 then 'java' when 1 then 'python' else 'ruby' end as language,
  case when doc_id%9=0 then null else 'org.'||lang end as package,
  case when doc_id%4=0 then '' else 'purpose '||(doc_id%10) end as purpose,
  case when doc_id%5=0 then []::varchar[] else ['lib'||(doc_id%12), 'lib'||(doc_id%5)] end as imports,
  ['C'||doc_id] as classes,
  'm'||doc_id as method_name, ['m'||((doc_id*7)%1500), 'm'||((doc_id*3)%1500)] as callees,
  'lib'||(doc_id%12) as library_name, '1.'||(doc_id%4) as library_version,
  case when doc_id%6=0 then ['CVE-'||(doc_id%3)] else []::varchar[] end as vulnerabilities
 from documents)"""


def library_uses(spark, d) -> DataFrame:
    """A library, its version and the range asked for, by file."""
    i = F.col("doc_id")
    s = lambda x: x.cast("string")
    tail = F.when(i % 5 == 0, F.concat(F.lit("-rc."), s(i % 13))).when(i % 7 == 0, "").otherwise(F.concat(F.lit("."), s(i % 4)))
    return table(spark, d, "documents").select(
        F.concat(F.lit("f"), s(i), F.lit(".xml")).alias("file_path"), F.concat(F.lit("lib"), s(i % 37)).alias("library_name"),
        F.concat(F.when(i % 37 < 20, F.lit("1")).otherwise(s(i % 3)), F.lit("."), s(i % 11), tail).alias("library_version"), (i % 101 == 0).alias("deprecated"),
        F.concat(F.lit(">=0."), s(i % 9), F.lit(",<"), F.when(i % 37 == 5, F.lit("0.7")).otherwise(F.lit("9"))).alias("requires"))


SQL_LIBRARY_USES = """library_uses as (
 select 'f'||doc_id||'.xml' as file_path, 'lib'||(doc_id%37) as library_name, doc_id%101=0 as deprecated,
  case when doc_id%37<20 then 1 else doc_id%3 end as v0, doc_id%11 as v1,
  case when doc_id%5=0 then 0 when doc_id%7=0 then 0 else doc_id%4 end as v2, case when doc_id%5=0 then 0 else 1 end as rel,
  case when doc_id%5=0 then doc_id%13 else 0 end as rc,
  (case when doc_id%37<20 then 1 else doc_id%3 end)||'.'||(doc_id%11)
   ||case when doc_id%5=0 then '-rc.'||(doc_id%13) when doc_id%7=0 then '' else '.'||(doc_id%4) end as version,
  doc_id%9 as low, case when doc_id%37=5 then 7 else 9000 end as high
 from documents)"""


# ---------------------------------------------------------------- snapshots
def snapshot_old(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc_key"), "text")


def snapshot_new(spark, d) -> DataFrame:
    """Next snapshot: toxic-labelled docs deleted, low-quality ones edited, benchmark items added."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    kept = (docs.join(lab, "doc_id", "left")
            .where(F.coalesce(F.col("toxic"), F.lit(0)) == 0)
            .select(F.col("doc_id").alias("doc_key"),
                    F.when(F.col("quality") == 0, F.concat(F.col("text"), F.lit(" changed")))
                    .otherwise(F.col("text")).alias("text")))
    added = table(spark, d, "benchmark").select((F.col("item_id") + F.lit(1_000_000_000)).alias("doc_key"), "text")
    return kept.unionByName(added)


SQL_SNAPSHOTS = """snapshot_old as (select doc_id as doc_key, text from documents),
snapshot_new as (
 select d.doc_id as doc_key, case when l.quality=0 then d.text||' changed' else d.text end as text
 from documents d left join labels l on d.doc_id=l.doc_id where coalesce(l.toxic,0)=0
 union all select item_id+1000000000, text from benchmark)"""


def metadata_next(spark, d) -> DataFrame:
    """Metadata after edits: files of toxic-labelled documents deleted, low-quality ones edited, one file a benchmark item added."""
    md = metadata(spark, d).select("doc_id", "file_path", "package", "imports", "classes", "method_name", "callees")
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    bad = F.col("quality") == 0
    kept = md.join(lab, "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0).select(
        "file_path", F.when(bad, F.lit("org.edited")).otherwise(F.col("package")).alias("package"),
        F.when(bad, F.array(F.concat(F.lit("lib"), (F.col("doc_id") % 7).cast("string")))).otherwise(F.col("imports")).alias("imports"),
        "classes", "method_name", "callees")
    s = F.col("item_id").cast("string")
    added = table(spark, d, "benchmark").select(
        F.concat(F.lit("bench/b"), s, F.lit(".py")).alias("file_path"), F.lit("org.bench").alias("package"), F.array(F.lit("lib0")).alias("imports"),
        F.array(F.concat(F.lit("B"), s)).alias("classes"), F.concat(F.lit("mb"), s).alias("method_name"), F.array(F.lit("m1")).alias("callees"))
    return kept.unionByName(added)


SQL_METADATA_NEXT = SQL_METADATA.replace("metadata as (", "metadata_before as (", 1) + """,
metadata as (
 select file_path, case when quality=0 then 'org.edited' else package end as package,
        case when quality=0 then ['lib'||(m.doc_id%7)] else imports end as imports, classes, method_name, callees
 from metadata_before m left join labels l on m.doc_id=l.doc_id where coalesce(l.toxic,0)=0
 union all
 select 'bench/b'||item_id||'.py', 'org.bench', ['lib0'], ['B'||item_id], 'mb'||item_id, ['m1'] from benchmark)"""


def metadata_json_text(spark, d) -> DataFrame:
    """Model-style answers: the metadata as JSON text, sometimes wrapped in prose."""
    md = metadata(spark, d)
    obj = F.to_json(F.struct("file_path", "git_repo", "package", "purpose", "imports", "classes",
                             F.array(F.struct("method_name", "callees")).alias("methods")),
                    {"ignoreNullFields": "false"})
    txt = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Here you go: "), obj, F.lit(" Thanks"))).otherwise(obj)
    return md.select("doc_id", txt.alias("text"))


def oracle_with(*ctes: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",\n".join(ctes) + "\n"
