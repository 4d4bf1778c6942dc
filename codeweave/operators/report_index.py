"""Inverted index over community reports, and BM25 search over it.

``build`` makes three tables, which are written with the index:

* ``report_postings(term, block, best, docs)``: the reports of a block that hold a term,
  with counts and lengths.  Reports are dealt to blocks of about ``BLOCK`` by hash;
  ``best`` is the largest impact of the term in the block.
* ``report_terms(term, df)``: in how many reports a term occurs.
* ``report_corpus(n, words)``: number of reports and their words (one row).

``top_reports`` reads the postings of the question's terms alone.  The sum of a block's
``best`` impacts, weighted by term, bounds the score of every report in it: the ``k`` blocks
of the largest bounds are scored first, and the k-th score found there is what a block's
bound must reach to be scored at all.  The result is exact.

Scores are integers (weights and impacts in thousandths and millionths), so they are equal
in any order of summing and in any engine.  Words are runs of letters and digits of any
script, lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.functions.topk import top_k_per_group

BLOCK = 128
TABLES = ["report_postings", "report_terms", "report_corpus"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def report_text(reports: DataFrame) -> Column:
    """What a report is found by, and what it costs: its summary and content."""
    return F.concat_ws(" ", *[c for c in ("summary", "full_content") if c in reports.columns])


def build(reports: DataFrame) -> dict[str, DataFrame]:
    """Index tables of ``reports(community, summary, full_content)``."""
    r = reports.select("community", words_of(report_text(reports)).alias("words")).withColumn("len", F.size("words").cast("long"))
    corpus = r.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("words"))
    n, total = corpus.first()
    block = F.pmod(F.xxhash64("community"), F.lit(max(1, -(-n // BLOCK))))
    if reports.groupBy("community").count().where("count > 1").isEmpty():
        # a report is a row: its terms are counted in place, and it is shuffled once, whole, to its block
        counted = F.expr("transform(array_distinct(words), t -> struct(t as term, cast(size(filter(words, x -> x = t)) as bigint) as tf))")
        tf = r.withColumn("block", block).repartition("block").select("community", "len", "block", F.explode(counted).alias("t")).select("community", "len", "block", "t.*")
        df = r.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    else:
        tf = r.select("community", "len", F.explode("words").alias("term")).groupBy("term", "community", "len").agg(F.count(F.lit(1)).alias("tf")).withColumn("block", block)
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    tf = tf.withColumn("impact", impact(n, total))
    postings = tf.groupBy("term", "block").agg(F.max("impact").alias("best"), F.collect_list(F.struct("community", "impact")).alias("docs"))  # a block
    return {"report_postings": postings, "report_terms": df, "report_corpus": corpus}


def impact(n: int, total: int) -> Column:
    """BM25's share of a term in a report in millionths: k1 = 1.2, b = 0.75."""
    return F.expr(f"(2200000000 * tf) div (1000 * tf + 300 + (900 * len * {int(n)}L) div {max(int(total), 1)}L)")


def _weighted(index: dict[str, DataFrame], terms: list[str]) -> DataFrame:
    """Posting rows of ``terms`` with their weight ``w``: ln(1 + (n - df + 0.5) / (df + 0.5)) in thousandths."""
    n = index["report_corpus"].first()["n"]
    df = index["report_terms"].where(F.col("term").isin(terms))  # a row a term of the question
    w = F.floor(1000 * F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))).cast("long")
    return index["report_postings"].where(F.col("term").isin(terms)).join(df.select("term", w.alias("w")), "term")


def _scores(postings: DataFrame) -> DataFrame:
    return postings.select("w", F.explode("docs").alias("d")).groupBy("d.community").agg(F.sum(F.col("w") * F.col("d.impact")).alias("score"))


def scores(index: dict[str, DataFrame], terms: list[str]) -> DataFrame:
    """``(community, score)`` of every report with a term of the question."""
    return _scores(_weighted(index, terms)).where("score > 0")


def top_reports(index: dict[str, DataFrame], terms: list[str], k: int) -> DataFrame:
    """``(community, score)`` of the ``k`` best reports, ties by name; few blocks are scored."""
    p = _weighted(index, terms)
    bounds = p.groupBy("block").agg(F.sum(F.col("w") * F.col("best")).alias("bound"))
    order = [F.desc("score"), F.asc("community")]
    first = _scores(p.join(bounds.orderBy(F.desc("bound"), "block").limit(k), "block")).where("score > 0").orderBy(*order).limit(k)
    found, least = first.agg(F.count(F.lit(1)), F.min("score")).first()
    if found == k:
        p = p.join(bounds.where(F.col("bound") >= least), "block")
    return _scores(p).where("score > 0").orderBy(*order).limit(k)


def top_reports_by_question(index: dict[str, DataFrame], questions: DataFrame, k: int) -> DataFrame:
    """``(question_no, community, score, rank)`` for ``questions(question_no, terms)``: all in one plan."""
    n = index["report_corpus"].first()["n"]
    q = questions.select("question_no", F.explode(F.array_distinct("terms")).alias("term"))
    w = F.floor(1000 * F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))).cast("long")
    p = index["report_postings"].join(q.join(index["report_terms"], "term").select("question_no", "term", w.alias("w")), "term")
    s = p.select("question_no", "w", F.explode("docs").alias("d")).groupBy("question_no", "d.community").agg(F.sum(F.col("w") * F.col("d.impact")).alias("score"))
    return top_k_per_group(s.where("score > 0"), ["question_no"], [F.desc("score"), F.asc("community")], k, salt_cols=["community"])
