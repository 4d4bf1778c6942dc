"""Index construction: text units, entities, relationships, co-occurrence, upkeep.

* ``chunk_text`` (I1): token windows of ``size`` with ``overlap`` computed by
  array functions inside each row -- no shuffle, no Python.
* ``structural_entities`` / ``structural_relationships`` (I2, I3, I6, I7):
  explode the per-file metadata, then merge duplicates with one partial/final
  aggregate; relationships keep only edges whose endpoints are entities
  (two semi-joins).
* ``href_edges`` (I4): link extraction with ``regexp_extract_all``.
* ``cooccurrence`` (I5): phrase pairs within a sliding window of ``window``
  positions, generated per row from the phrase array (linear in phrases -- never
  all pairs of a document), then counted with map-side combine.
* ``description_summary`` (I8): the most frequent distinct descriptions per
  edge, salted top-k (a hub edge never lands in one task), cut to 500 words.
* ``snapshot_diff`` (I16): full outer join on the key with a content hash.
* ``text_embedding`` (I14 default): hashed term-frequency vectors, L2-normalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.functions.topk import top_k_per_group

WS = r"[ \t\n\r\f]+"
RUN = r"[^ \t\n\r\f]+[ \t\n\r\f]*"  # a token with the white space behind it


# --------------------------------------------------------------------- I1
def tokens(text: str | Column) -> Column:
    """Whitespace tokens (ASCII whitespace), empty text -> empty array."""
    t = F.col(text) if isinstance(text, str) else text
    stripped = F.regexp_replace(t, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, WS))


def chunk_text(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
               size: int = 1200, overlap: int = 100) -> DataFrame:
    """One row per chunk: ``(id, chunk_index, start_token, n_tokens, text)``.

    Starts are ``0, size-overlap, ...`` while ``start < n - overlap`` (at least
    one chunk for non-empty text); an empty text yields no chunk.  A chunk is a
    substring of the text: line breaks and indentation stay as they are.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    toks = df.select(id_col, F.regexp_extract_all(F.col(text_col), F.lit(RUN), 0).alias("_t")).withColumn("_n", F.size("_t"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("_n") - overlap - 1, F.lit(0)), F.lit(step))
    # build every chunk inside the row, then explode only the chunks: each output
    # row carries its own text, never a copy of the whole token array
    chunks = F.transform(starts, lambda st: F.struct(
        st.alias("start_token"), F.size(F.slice("_t", st + 1, size)).alias("n_tokens"),
        F.regexp_replace(F.array_join(F.slice("_t", st + 1, size), ""), WS + "$", "").alias("text")))
    ex = toks.where(F.col("_n") > 0).select(id_col, F.posexplode(chunks).alias("chunk_index", "c"))
    return ex.select(id_col, F.col("chunk_index").cast("int"), F.col("c.start_token").cast("int").alias("start_token"),
                     F.col("c.n_tokens").cast("int").alias("n_tokens"), F.col("c.text").alias("text"))


# ----------------------------------------------------------------- I2, I6
def _norm_title(c: Column) -> Column:
    return F.upper(F.trim(c))


def _pairs(items, kind: str, first=None):
    """array<struct<a, b, type>> from an array column (``first`` fixed on the left when given)."""
    if first is None:
        return F.transform(F.coalesce(items, F.array().cast("array<string>")),
                           lambda x: F.struct(x.alias("a"), F.lit(None).cast("string").alias("b"), F.lit(kind).alias("type")))
    return F.transform(F.coalesce(items, F.array().cast("array<string>")),
                       lambda x: F.struct(first.alias("a"), x.alias("b"), F.lit(kind).alias("type")))


def _one(a, b, kind: str):
    return F.array(F.struct(a.cast("string").alias("a"), b.cast("string").alias("b"), F.lit(kind).alias("type")))


def structural_mentions(md: DataFrame) -> DataFrame:
    """Entity mentions from typed metadata: one row per (file, name, type) -- one scan, one explode."""
    fp = F.col("file_path")
    pkg = F.when(F.col("package").isNotNull() & (F.col("package") != ""), _one(F.col("package"), F.lit(None), "package")) \
        .otherwise(F.array().cast("array<struct<a:string,b:string,type:string>>"))
    items = F.concat(_one(fp, F.lit(None), "module"), pkg, _pairs(F.col("imports"), "dependency"),
                     _pairs(F.col("classes"), "class"), _one(F.col("method_name"), F.lit(None), "function"))
    ex = md.select(fp, F.explode(items).alias("m"))
    out = ex.select(fp, F.col("m.a").alias("name"), F.col("m.type").alias("type"))
    return out.where(F.col("name").isNotNull() & (F.trim(F.col("name")) != ""))


def structural_entities(md: DataFrame) -> DataFrame:
    """Merged entities: ``(title, type, frequency)``; title = upper(trim(name))."""
    m = structural_mentions(md)
    return m.groupBy(_norm_title(F.col("name")).alias("title"), "type").agg(
        F.countDistinct("file_path").alias("frequency"))


def structural_relations(md: DataFrame, callee_is_caller: bool = True) -> DataFrame:
    """Relationship mentions ``(file_path, source, target, type)`` from metadata, one row each.

    IMPORTS: file -> import; USES: file -> class; DEPENDS_ON: file -> package;
    CALLS: caller -> method (callee lists read as callers by default).
    One explode per metadata row.
    """
    fp = F.col("file_path")
    pkg = F.when(F.col("package").isNotNull() & (F.col("package") != ""), _one(fp, F.col("package"), "DEPENDS_ON")) \
        .otherwise(F.array().cast("array<struct<a:string,b:string,type:string>>"))
    callees = F.coalesce(F.col("callees"), F.array().cast("array<string>"))
    if callee_is_caller:
        calls = F.transform(callees, lambda x: F.struct(x.alias("a"), F.col("method_name").alias("b"),
                                                        F.lit("CALLS").alias("type")))
    else:
        calls = _pairs(callees, "CALLS", F.col("method_name"))
    items = F.concat(_pairs(F.col("imports"), "IMPORTS", fp), _pairs(F.col("classes"), "USES", fp), pkg, calls)
    return md.select(fp, F.explode(items).alias("r")).select(
        fp, _norm_title(F.col("r.a")).alias("source"), _norm_title(F.col("r.b")).alias("target"),
        F.col("r.type").alias("type"))


def structural_relationships(md: DataFrame, callee_is_caller: bool = True) -> DataFrame:
    """Merged relationships ``(source, target, type, weight, n_files)`` from metadata.

    Edges whose endpoints are not entities are dropped (two semi-joins against the merged entity titles).
    """
    merged = structural_relations(md, callee_is_caller).groupBy("source", "target", "type").agg(
        F.count(F.lit(1)).alias("weight"), F.countDistinct("file_path").alias("n_files"))
    ent = structural_entities(md).select("title").distinct()
    return (merged.join(ent.select(F.col("title").alias("source")), "source", "left_semi")
            .join(ent.select(F.col("title").alias("target")), "target", "left_semi")
            .select("source", "target", "type", "weight", "n_files"))


# --------------------------------------------------------------------- I4
HREF_RE = r'href="([^"]*)"'


def href_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Link graph: ``(source=url, target=href, weight=#links)``; empty hrefs dropped."""
    ex = pages.select(F.col(url_col).alias("source"),
                      F.explode(F.regexp_extract_all(F.col(html_col), F.lit(HREF_RE), 1)).alias("target"))
    return ex.where(F.col("target") != "").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def import_edges(code: DataFrame, path_col: str = "file_path", code_col: str = "code") -> DataFrame:
    """Regex import extractor over source text: Python/Java/JS/C forms -> IMPORTS edges."""
    pats = [r"(?m)^\s*import\s+([\w.]+)", r"(?m)^\s*from\s+([\w.]+)\s+import\b",
            r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", r"(?m)^\s*#include\s*[<\"]([^>\"]+)[>\"]"]
    arr = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.col(code_col), F.lit(p), 1) for p in pats])))
    return (code.select(F.col(path_col).alias("source"), F.explode(arr).alias("target"))
            .withColumn("type", F.lit("IMPORTS")))


# --------------------------------------------------------------------- I5
PHRASE_RE = r"[A-Z][a-z]+"


def phrases(text: str | Column, pattern: str = PHRASE_RE) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), lambda x: F.lower(x))


def cooccurrence(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 2,
                 pattern: str = PHRASE_RE) -> DataFrame:
    """Phrase pairs appearing within ``window`` positions of each other.

    ``(phrase_a < phrase_b, weight = co-occurrences, n_docs)``.  Pairs are built
    per row by zipping the phrase array with its own shifted slices -- at most
    ``window`` pairs per phrase.
    """
    p = docs.select(id_col, phrases(text_col, pattern).alias("_p")).withColumn("_n", F.size("_p"))
    # all offsets 1..window in one array, one explode: a single scan of the documents
    zips = [F.arrays_zip(F.slice("_p", 1, F.greatest(F.col("_n") - k, F.lit(0))).alias("a"),
                         F.slice("_p", k + 1, F.greatest(F.col("_n") - k, F.lit(0))).alias("b"))
            for k in range(1, window + 1)]
    allp = p.where(F.col("_n") > 1).select(id_col, F.explode(F.flatten(F.array(*zips))).alias("z"))
    allp = allp.select(id_col, F.col("z.a").alias("a"), F.col("z.b").alias("b")).where(F.col("a") != F.col("b"))
    return allp.groupBy(F.least("a", "b").alias("phrase_a"), F.greatest("a", "b").alias("phrase_b")).agg(
        F.count(F.lit(1)).alias("weight"), F.countDistinct(id_col).alias("n_docs"))


# --------------------------------------------------------------------- I8
def description_summary(rel: DataFrame, max_words: int = 500) -> DataFrame:
    """Per (source, target): the most frequent distinct descriptions, joined, cut to ``max_words``.

    Every description is a word at least, so those ranked beyond ``max_words``
    can't reach the summary; ``n_mentions`` counts all of them.
    """
    d = (rel.where(F.col("description").isNotNull())
         .groupBy("source", "target", "description").agg(F.count(F.lit(1)).alias("_c")))
    top = top_k_per_group(d, ["source", "target"], [F.col("_c").desc(), F.col("description").asc()],
                          max_words, salt_cols=["description"])
    total = d.groupBy("source", "target").agg(F.sum("_c").alias("n_mentions"))
    g = top.groupBy("source", "target").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "description"))),
                                 lambda x: x["description"]), " | ").alias("_s"))
    words = F.split("_s", " ")
    return g.join(total, ["source", "target"]).select("source", "target", "n_mentions",
                    F.array_join(F.slice(words, 1, max_words), " ").alias("summary"))


# -------------------------------------------------------------------- I16
def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "doc_key", text_col: str = "text") -> DataFrame:
    """``(key, status)`` with status added / deleted / changed / same (content hash compare)."""
    o = old.select(key, F.sha2(F.col(text_col), 256).alias("_ho"))
    n = new.select(key, F.sha2(F.col(text_col), 256).alias("_hn"))
    j = o.join(n, key, "full_outer")
    status = (F.when(F.col("_ho").isNull(), "added").when(F.col("_hn").isNull(), "deleted")
              .when(F.col("_ho") != F.col("_hn"), "changed").otherwise("same"))
    return j.select(key, status.alias("status"))


def incremental_units(old_units: DataFrame, new_docs: DataFrame, diff: DataFrame, key: str = "doc_key",
                      size: int = 1200, overlap: int = 100) -> DataFrame:
    """Re-chunk only added/changed documents; keep units of unchanged ones (anti/semi joins)."""
    redo = diff.where(F.col("status").isin("added", "changed")).select(key)
    keep = diff.where(F.col("status") == "same").select(key)
    fresh = chunk_text(new_docs.join(redo, key, "left_semi"), "text", key, size, overlap)
    return old_units.join(keep, key, "left_semi").unionByName(fresh)


# -------------------------------------------------------------------- I14
def text_embedding(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                   num_features: int = 1024) -> DataFrame:
    """Default embedding: hashed term frequencies, L2-normalised (Spark ML, JVM-side)."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array
    t = docs.select(id_col, tokens(F.lower(F.col(text_col))).alias("_tok"))
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features).transform(t)
    nv = Normalizer(inputCol="_tf", outputCol="_v", p=2.0).transform(tf)
    return nv.select(id_col, vector_to_array("_v", "float32").alias("embedding"))
