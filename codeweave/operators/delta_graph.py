"""Entities, relationships and degrees kept up by signed counts (I16).

What a file contributes is a set of counts: its entities (one file each) and its
relationships (one file, a weight).  The graph is the sum over files, so a batch of edits
is the sum of the new rows' counts less that of the old rows', for the changed files alone:

* ``counts(kind, a, b, type, files, weight)``: kind 0 are entities (``a`` = title), kind 1
  relationships (``a`` -> ``b``).  ``add`` sums counts and drops what has come to nothing.
* a *log* holds counts as signed rows by version.  A version is one partition, rewritten
  whole if its batch is replayed, so nothing counts twice.  ``compact`` sums the log up
  to a version into a new generation, which one row of the manifest makes current;
  readers of the old generation go on undisturbed.
* ``refresh_degrees`` counts again only for nodes whose relationships may have changed.

Every step is a sum with map-side combine; nothing is read of files that did not change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.operators import indexing as IX
from codeweave.session import read_if_there

KEY = ["kind", "a", "b", "type"]
SCHEMA = "kind int, a string, b string, type string, files long, weight long"


def _file_counts(md: DataFrame) -> DataFrame:
    """Counts a file contributes: one row for each file and key."""
    e = IX.structural_mentions(md).select("file_path", F.lit(0).alias("kind"), F.upper(F.trim("name")).alias("a"), F.lit(None).cast("string").alias("b"),
                                          "type", F.lit(0).alias("w"))
    r = IX.structural_relations(md).select("file_path", F.lit(1).alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "type", F.lit(1).alias("w"))
    return e.unionByName(r).groupBy("file_path", *KEY).agg(F.lit(1).cast("long").alias("files"), F.sum("w").cast("long").alias("weight"))


def counts_of(md: DataFrame) -> DataFrame:
    return _file_counts(md).groupBy(*KEY).agg(F.sum("files").alias("files"), F.sum("weight").alias("weight"))


def add(*parts: DataFrame) -> DataFrame:
    """Sum of counts, without what has come to nothing."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*KEY).agg(F.sum("files").alias("files"), F.sum("weight").alias("weight")).where("files <> 0 or weight <> 0")


def signed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts of ``new`` metadata rows less those of ``old`` ones."""
    less = counts_of(old).select(*KEY, (-F.col("files")).alias("files"), (-F.col("weight")).alias("weight"))
    return add(counts_of(new), less)


def changed_rows(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The metadata rows before and after of the files that differ (added, deleted or edited)."""
    cols = ["file_path", "package", "imports", "classes", "method_name", "callees"]

    def prints(md: DataFrame, name: str) -> DataFrame:  # a file may have several rows
        return md.groupBy("file_path").agg(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias(name), F.count(F.lit(1)).alias(name + "_n"))

    both = prints(before, "p").join(prints(after, "q"), "file_path", "full_outer")
    touched = both.where(~(F.col("p").eqNullSafe(F.col("q")) & F.col("p_n").eqNullSafe(F.col("q_n")))).select("file_path")
    return before.select(*cols).join(touched, "file_path", "left_semi"), after.select(*cols).join(touched, "file_path", "left_semi")


# --------------------------------------------------------------------- tables
def entities(counts: DataFrame) -> DataFrame:
    return counts.where("kind = 0").select(F.col("a").alias("title"), "type", F.col("files").alias("frequency"))


def relationships(counts: DataFrame) -> DataFrame:
    """Relationships both of whose ends are entities."""
    titles = counts.where("kind = 0").select("a").distinct()
    return counts.where("kind = 1").join(titles, "a", "left_semi").join(titles.withColumnRenamed("a", "b"), "b", "left_semi") \
        .select(F.col("a").alias("source"), F.col("b").alias("target"), "type", "weight", F.col("files").alias("n_files"))


def degrees(counts: DataFrame) -> DataFrame:
    """``(node, degree)``: relationships at each node, a loop twice."""
    r = relationships(counts)
    return r.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def refresh_degrees(before: DataFrame, counts: DataFrame, delta: DataFrame) -> DataFrame:
    """``degrees(counts)`` from those before ``delta``: only nodes near a change are counted again."""
    ends = delta.where("kind = 1").select(F.explode(F.array("a", "b")).alias("node"))
    named = delta.where("kind = 0").select(F.col("a").alias("node")).distinct()
    rows = counts.where("kind = 1").select("a", "b")
    # relationships of an entity that came or went count or not at their other end
    other = rows.join(named.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")) \
        .unionByName(rows.join(named.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node")))
    touched = ends.unionByName(named).unionByName(other).distinct()
    near = touched.select(F.col("node").alias("a"))
    of = counts.where("kind = 1").join(near, "a", "left_semi").unionByName(
        counts.where("kind = 1").join(near, "a", "left_anti").join(near.withColumnRenamed("a", "b"), "b", "left_semi"))
    titles = counts.where("kind = 0").select("a").distinct()
    valid = of.join(titles, "a", "left_semi").join(titles.withColumnRenamed("a", "b"), "b", "left_semi")
    again = valid.select(F.explode(F.array("a", "b")).alias("node")).join(touched, "node", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return before.join(touched, "node", "left_anti").unionByName(again)


# ------------------------------------------------------------------------ log
def _generation(spark: SparkSession, log_dir: str) -> tuple[str | None, int]:
    """(folder, version up to which it is summed) of the current generation."""
    m = read_if_there(spark, f"{log_dir}/manifest")
    last = m.orderBy(F.desc("generation")).first() if m is not None else None
    return (last["folder"], last["base"]) if last else (None, -1)


def append(log_dir: str, version: int, delta: DataFrame) -> None:
    """Write a version's signed counts (again, if its batch is replayed); versions already compacted stay as they are."""
    folder, base = _generation(delta.sparkSession, log_dir)
    if version > base:
        delta.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("version").parquet(f"{log_dir}/versions")


def current(spark: SparkSession, log_dir: str, version: int | None = None) -> DataFrame:
    """Counts as of ``version`` (default: the last one), lazily: keep a copy of what has to outlast the next ``append``."""
    folder, base = _generation(spark, log_dir)
    log = read_if_there(spark, f"{log_dir}/versions")
    parts = [] if folder is None else [spark.read.parquet(f"{log_dir}/{folder}")]
    if log is not None:
        newer = log.where(F.col("version") > base)
        parts.append((newer if version is None else newer.where(F.col("version") <= version)).select(*KEY, "files", "weight"))
    return add(*parts) if parts else spark.createDataFrame([], SCHEMA)


def compact(spark: SparkSession, log_dir: str, version: int) -> None:
    """Sum everything up to ``version`` into a new generation and make it current."""
    folder, base = _generation(spark, log_dir)
    if version <= base:
        return
    name = f"sum-{uuid.uuid4().hex}"
    current(spark, log_dir, version).write.parquet(f"{log_dir}/{name}")
    m = read_if_there(spark, f"{log_dir}/manifest")
    g = (m.agg(F.max("generation")).first()[0] if m is not None else 0) + 1
    spark.createDataFrame([(g, name, version)], "generation long, folder string, base long").coalesce(1).write.mode("append").parquet(f"{log_dir}/manifest")
