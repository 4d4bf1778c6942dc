"""Question answering over community reports and vectors.

The default scorer is deterministic and model-free: a report's score for a
question is how many of its words are question terms (integer term counts,
summed from per-document counts, so a report over a third of the corpus is a
partial/final aggregate, never one gathered text).  Map = score every report;
reduce = keep reports with score > 0 in score order while the running token
budget holds, then join their ids into an answer.  A model can replace the
reduce step through ``completion.complete`` on the selected context.

Vector search is exact cosine top-k: queries are broadcast in blocks of about
``QUERY_BLOCK``, scored per Arrow batch with numpy, cut to a top-k per batch,
and merged -- a scan of the corpus per block, O(batches x queries x k) rows shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeweave.functions.ranks import running_sums
from codeweave.operators import completion as C
from codeweave.operators import report_index as RI
from codeweave.session import cut_lineage

# FIXED VALUES: the three questions of the migration report, verbatim.
MIGRATION_QUESTIONS = [
    """
            What migration order would be recommended when refactoring to reduce breaking changes? 
            Provide a comprehensive order that includes as many classes and packages as possible.
            Include the fully qualified names.
            """,
    """
            Are there any security vulnerabilities in the code or associated libraries?
            Include the fully qualified names.
            """,
    """
            Are there any dependencies that need to be upgraded and in what order?
            Include the fully qualified names.
            """,
]

COMMUNITY_LEVEL = 2
REPORT_MAX_TOKENS = 2000
CONTEXT_BUDGET = 8000
QUERY_BLOCK = 4096  # query vectors broadcast at a time
STOP_WORDS = frozenset("a an and in of the to".split())


def question_terms(question: str) -> list[str]:
    """Distinct lower-case words (letters and digits of any script) but for ``STOP_WORDS``, in first-seen order."""
    return list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", question.lower()) if w not in STOP_WORDS))


def term_hits(text: str | Column, terms: list[str]) -> Column:
    """Number of words of ``text`` (runs of letters and digits, lower-cased) that are question terms.

    One JVM regex count per row (no array of words is materialised).
    """
    t = F.col(text) if isinstance(text, str) else text
    if not terms:
        return F.lit(0).cast("bigint")
    pat = r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(terms, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"
    return F.regexp_count(F.lower(t), F.lit(pat)).cast("bigint")


def word_count(text: str | Column) -> Column:
    """Whitespace-separated tokens (ASCII whitespace), counted by one regex scan."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(t, F.lit("[^ \t\n\r\f]+")), F.lit(0)).cast("int")


def document_reports(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Two-level report hierarchy over documents: level 0 per source, level 1 per (source, lang).

    ``(community, level, parent, score, n_tokens)`` with per-report integer
    score and token count (capped at the report output limit).
    """
    per_doc = docs.select("source", "lang", term_hits("text", terms).alias("hits"),
                          word_count("text").alias("words"))
    l1 = per_doc.groupBy("source", "lang").agg(F.sum("hits").alias("score"), F.sum("words").alias("w"))
    l0 = l1.groupBy("source").agg(F.sum("score").alias("score"), F.sum("w").alias("w"))
    cap = F.least(F.col("w"), F.lit(REPORT_MAX_TOKENS)).cast("bigint")
    r0 = l0.select(F.col("source").alias("community"), F.lit(0).alias("level"),
                   F.lit(None).cast("string").alias("parent"), F.col("score").cast("bigint").alias("score"),
                   cap.alias("n_tokens"))
    r1 = l1.select(F.concat_ws("/", "source", "lang").alias("community"), F.lit(1).alias("level"),
                   F.col("source").alias("parent"), F.col("score").cast("bigint").alias("score"),
                   cap.alias("n_tokens"))
    return r0.unionByName(r1)


def select_dynamic(reports: DataFrame, max_level: int = COMMUNITY_LEVEL) -> DataFrame:
    """Start at root reports; descend only into children of relevant (score > 0) parents.

    The selected report set = the deepest relevant reports along each relevant
    path (a relevant parent is replaced by its relevant children when it has any).
    """
    rel = reports.where((F.col("score") > 0) & (F.col("level") <= max_level))
    roots = rel.where(F.col("level") == 0)
    chosen = roots
    frontier = roots
    for lvl in range(1, max_level + 1):
        kids = rel.where(F.col("level") == lvl).join(
            frontier.select(F.col("community").alias("parent")), "parent", "left_semi")
        has_kids = kids.select(F.col("parent").alias("community")).distinct()
        chosen = chosen.join(has_kids, "community", "left_anti").unionByName(kids)
        frontier = kids
    return chosen


def select_static(reports: DataFrame, max_level: int = COMMUNITY_LEVEL) -> DataFrame:
    """R2: every report at the deepest available level <= ``max_level`` (no relevance pruning)."""
    lv = reports.where(F.col("level") <= max_level)
    parents = lv.where(F.col("parent").isNotNull()).select(F.col("parent").alias("community")).distinct()
    return lv.join(parents, "community", "left_anti")


def map_reduce(selected: DataFrame, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """Relevant reports ranked by score, kept while the running token total fits the budget.

    The window orders only relevant reports (one row per community), a set
    bounded by the number of communities at the chosen level.
    """
    order = [F.col("score").desc(), F.col("community").asc()]
    w = Window.orderBy(*order)
    # every kept report costs >= 1 token, so at most `budget` of them can fit:
    # a bounded top-k (TakeOrderedAndProject) feeds the single running-sum window
    top = selected.where((F.col("score") > 0) & (F.col("n_tokens") > 0)).orderBy(*order).limit(budget)
    ranked = (top
              .withColumn("rank", F.row_number().over(w).cast("int"))
              .withColumn("used_tokens", F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return ranked.where(F.col("used_tokens") <= budget)


def answer_text(mr: DataFrame) -> DataFrame:
    """Reduce the ranked context into one answer line (ordered listagg of bounded rows)."""
    return mr.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "community", "score"))),
                                           lambda x: F.concat(x["community"], F.lit(" ("), x["score"].cast("string"),
                                                              F.lit(")"))), "; ").alias("answer"))


def global_search(docs: DataFrame, question: str, dynamic: bool = True) -> DataFrame:
    reports = document_reports(docs, question_terms(question))
    sel = select_dynamic(reports) if dynamic else select_static(reports)
    return map_reduce(sel)


def migration_report(docs: DataFrame, questions: list[str] = MIGRATION_QUESTIONS) -> DataFrame:
    """One row per question -- ``(question_no, section)`` with the '### Question' format.

    All questions are scored in one pass over the documents (one hit column per
    question); each question then selects and reduces over the small report
    table.  An empty answer is an error in the original; here it is the text
    'No relevant reports.' so the batch always returns all sections.
    """
    term_sets = [question_terms(q) for q in questions]
    per_doc = docs.select("source", "lang", word_count("text").alias("words"),
                          *[term_hits("text", t).alias(f"h{i}") for i, t in enumerate(term_sets)])
    sums = [F.sum(f"h{i}").alias(f"h{i}") for i in range(len(questions))]
    l1 = per_doc.groupBy("source", "lang").agg(F.sum("words").alias("w"), *sums)
    l0 = l1.groupBy("source").agg(F.sum("w").alias("w"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(len(questions))])
    cap = F.least(F.col("w"), F.lit(REPORT_MAX_TOKENS)).cast("bigint")
    r0 = l0.select(F.col("source").alias("community"), F.lit(0).alias("level"),
                   F.lit(None).cast("string").alias("parent"), cap.alias("n_tokens"),
                   *[f"h{i}" for i in range(len(questions))])
    r1 = l1.select(F.concat_ws("/", "source", "lang").alias("community"), F.lit(1).alias("level"),
                   F.col("source").alias("parent"), cap.alias("n_tokens"), *[f"h{i}" for i in range(len(questions))])
    reports = r0.unionByName(r1)
    parts = []
    for i, q in enumerate(questions):
        rep = reports.select("community", "level", "parent", "n_tokens", F.col(f"h{i}").cast("bigint").alias("score"))
        ans = answer_text(map_reduce(select_dynamic(rep))).select(
            F.lit(i).alias("question_no"),
            F.concat(F.lit(f"### Question: {q}\n\n###Answer: "),
                     F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.lit("No relevant reports.")),
                     F.lit("\n\n")).alias("section"))
        parts.append(ans)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scored_reports(tables: dict[str, DataFrame], terms: list[str]) -> DataFrame:
    """``(community, level, parent, title, summary, n_tokens, score)`` of the reports that hold a term, from the index tables."""
    rep = tables["community_reports"]
    rep = rep.select("community", "level", "title", "summary", "full_content", word_count(RI.report_text(rep)).cast("bigint").alias("n_tokens"))
    parents = tables["communities"].select("community", "parent")
    return RI.scores(tables, terms).join(rep, "community").join(parents, "community", "left") \
        .select("community", "level", "parent", "title", "summary", "full_content", "n_tokens", "score")


def search_reports(tables: dict[str, DataFrame], question: str, dynamic: bool = True, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """R1-R3 over community reports: BM25 scores, selection by level, the best ones within the token budget.

    ``(community, level, parent, title, summary, full_content, n_tokens, score, rank, used_tokens)``;
    tokens are those of the reports' own texts.  Scores are written once, without the texts,
    which only the selected reports get back; a community and a level have one report.
    """
    terms = question_terms(question)
    scored = cut_lineage(scored_reports(tables, terms).select("community", "level", "parent", "n_tokens", "score"))
    if dynamic:
        sel = select_dynamic(scored)
    else:  # the deepest reports up to the level, whatever their score; the score decides afterwards
        kept = select_static(tables["communities"].select("community", "level", "parent")).select("community")
        sel = scored.join(kept, "community", "left_semi")
    best = map_reduce(sel, budget).withColumnsRenamed({"community": "_community", "level": "_level"})  # at most ``budget`` rows
    rep = tables["community_reports"].select("community", "level", "title", "summary", "full_content")
    return rep.join(F.broadcast(best), F.col("community").eqNullSafe(F.col("_community")) & F.col("level").eqNullSafe(F.col("_level"))) \
        .select("community", "level", "parent", "title", "summary", "full_content", "n_tokens", "score", "rank", "used_tokens").orderBy("rank")


def answer_from_reports(found: DataFrame) -> DataFrame:
    """The reduce step without a model: title and summary of each selected report, best first (one row)."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "title", "score", "summary")))  # within the token budget
    return found.agg(F.array_join(F.transform(rows, lambda x: F.concat(
        x["title"], F.lit(" ("), x["score"].cast("string"), F.lit("): "), x["summary"])), "\n").alias("answer"))


def answer_by_model(found: DataFrame, question: str, chat_fn, model: str = "", cache_path: str | None = None) -> DataFrame:
    """The reduce step with a model: one prompt of the selected reports in order; ``(question, content)``."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "full_content")))
    context = found.agg(F.array_join(F.transform(rows, lambda x: x["full_content"]), "\n\n").alias("context"))
    text = F.concat(F.lit("Reports:\n\n"), F.col("context"), F.lit(f"\n\nQuestion: {question}\nAnswer from the reports alone, in several paragraphs."))
    prompts = context.select(F.lit(question).alias("question"), F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages"))
    return C.complete(prompts, chat_fn, model, cache_path).select("question", "content")


def index_migration_report(tables: dict[str, DataFrame], questions: list[str] = MIGRATION_QUESTIONS, dynamic: bool = True) -> DataFrame:
    """R4 over community reports: ``(question_no, section)``, a row a question."""
    out = None
    for i, q in enumerate(questions):
        answer = answer_from_reports(search_reports(tables, q, dynamic))
        part = answer.select(F.lit(i).alias("question_no"), F.concat(
            F.lit(f"### Question: {q}\n\n###Answer: "), F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.lit("No relevant reports.")), F.lit("\n\n")).alias("section"))
        out = part if out is None else out.unionByName(part)
    return out


def report_text(sections: DataFrame) -> str:
    """The assembled report: sections in question order (three short rows)."""
    rows = sections.orderBy("question_no").select("section").collect()
    return "".join(r.section for r in rows)


# ------------------------------------------------------------------ vectors
def label_centroids(vectors: DataFrame, vec_col: str = "embedding", key: str = "label") -> DataFrame:
    """Query vectors derived from the corpus: mean vector per label (per-dimension averages)."""
    ex = vectors.select(key, F.posexplode(vec_col).alias("i", "x"))
    per = ex.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return per.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))),
                                            lambda s: s["m"]).alias("query"))


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
                vec_col: str = "embedding", qid_col: str = "label") -> DataFrame:
    """Exact cosine top-k per query: ``(query_id, id, score, rank)``; ties by id.

    Any number of queries: they are dealt into blocks of about ``QUERY_BLOCK``,
    each broadcast on its own and scored against the whole corpus.
    """
    queries = cut_lineage(queries.select(F.col(qid_col).alias("qid"), "query"))
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(n_blocks)))
    id_t = corpus.schema[id_col].dataType.simpleString()
    q_t = queries.schema["qid"].dataType.simpleString()
    spark = corpus.sparkSession

    def scorer(block: int):
        rows = dealt.where(F.col("block") == block).select("qid", "query").collect()  # about QUERY_BLOCK rows
        mat = np.array([r["query"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
        sent = spark.sparkContext.broadcast(
            ([r["qid"] for r in rows], mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-300)))

        def score(batches):
            names, q = sent.value
            for pdf in batches:
                if pdf.empty or not names:
                    continue
                pdf = pdf.sort_values(id_col, kind="stable")
                m = np.vstack(pdf[vec_col].to_numpy()).astype(np.float64)
                norms = np.linalg.norm(m, axis=1)
                s = (m @ q.T) / np.where(norms == 0, np.inf, norms)[:, None]
                best = np.argsort(-s, axis=0, kind="stable")[:k]     # rows are in id order: ties by id
                yield pd.DataFrame({"query_id": np.repeat(np.array(names, dtype=object), len(best)),
                                    "id": pdf[id_col].to_numpy()[best.T.ravel()],
                                    "score": np.take_along_axis(s, best, 0).T.ravel()})

        return score

    cand = None
    for block in range(n_blocks):
        part = corpus.select(id_col, vec_col).mapInPandas(scorer(block), f"query_id {q_t}, id {id_t}, score double")
        cand = part if cand is None else cand.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int"))


def one_hop_context(hits: DataFrame, relationships: DataFrame, budget: int = CONTEXT_BUDGET, units: DataFrame | None = None) -> DataFrame:
    """R6 on a graph: top entities, the relationships touching them, then their text units, under a token budget.

    ``hits(query_id, id=title, score, rank)``, ``units(title, unit_id, text)``; returns context rows
    ``(query_id, kind, rank, text, n_tokens, used_tokens)`` -- entities first in
    rank order, then each entity's relationships by weight, then its text units by id.  The running
    token count is a distributed prefix sum, so a hub with any number of relationships
    never lies in one task.
    """
    ent = hits.select("query_id", F.lit("entity").alias("kind"), "rank", F.lit(0.0).alias("w"),
                      F.col("id").cast("string").alias("text"))
    src = hits.select("query_id", "rank", F.col("id").alias("source"))
    dst = hits.select("query_id", "rank", F.col("id").alias("target"))
    desc = F.concat_ws(" ", "source", F.coalesce("type", F.lit("")), "target")
    r1 = relationships.join(src, "source").select("query_id", "rank", F.col("weight").cast("double").alias("w"),
                                                    desc.alias("text"))
    r2 = relationships.join(dst, "target").select("query_id", "rank", F.col("weight").cast("double").alias("w"),
                                                    desc.alias("text"))
    rel = r1.unionByName(r2).distinct().withColumn("kind", F.lit("relationship"))
    ctx = ent.unionByName(rel)
    if units is not None:
        told = units.join(hits.select("query_id", "rank", F.col("id").alias("title")), "title")
        ctx = ctx.unionByName(told.select("query_id", "rank", (-F.col("unit_id")).cast("double").alias("w"), "text", F.lit("text_unit").alias("kind")))
    ctx = ctx.withColumns({"n_tokens": word_count("text").cast("bigint"), "order": -F.col("w")})
    ctx = running_sums(ctx, ["query_id"], ["kind", "rank", "order", "text"], "n_tokens")
    return ctx.withColumn("used_tokens", F.col("before") + F.col("n_tokens")).where(F.col("used_tokens") <= budget).drop("w", "order", "before")


def local_search(hits: DataFrame, units: DataFrame, budget: int = CONTEXT_BUDGET,
                 unit_key: str = "doc_id", token_col: str = "n_tokens") -> DataFrame:
    """Vector hits -> their text units -> running token budget per query (a distributed prefix sum)."""
    j = running_sums(hits.join(units, hits["id"] == units[unit_key]).drop(unit_key), ["query_id"], ["rank", "id"], token_col)
    return j.withColumn("used_tokens", F.col("before") + F.col(token_col)).where(F.col("used_tokens") <= budget).drop("before")
