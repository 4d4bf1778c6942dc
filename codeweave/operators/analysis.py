"""Dependency questions over an index's relationship table.

* ``find_dependencies`` / ``find_dependents``: regex match on the source (or
  target) AND an import/depend description -- pure filters, so Spark fuses
  them into the scan stage.
* ``dependency_layers``: in-degree per target, then three bounded top-k slices
  of the total order ``(in_degree, module)`` -- a partial/final aggregation and
  ``TakeOrderedAndProject``; no global sort of the whole table.
* ``dependency_report``: the three answers above as one tagged table.
* ``library_inventory`` / ``call_graph``: explode-and-group analytics on
  per-file metadata.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.functions import versions as V
from pyspark.sql.window import Window

IMPORT_OR_DEPEND = "import|depend"


def _pattern(text: str, literal: bool) -> str:
    # (?iu): case-insensitive for all of Unicode, like Python's re.IGNORECASE on str.
    return "(?iu)" + (re.escape(text) if literal else text)


def _edge_rows(rel: DataFrame, cond) -> DataFrame:
    weight = F.col("weight").cast("double") if "weight" in rel.columns else F.lit(1.0)
    return rel.where(cond).select(
        F.col("source").alias("from"), F.col("target").alias("to"),
        F.col("description").alias("type"), weight.alias("weight"))


def find_dependencies(rel: DataFrame, module_name: str, literal: bool = False) -> DataFrame:
    """Edges whose *source* matches ``module_name`` and whose description says import/depend."""
    cond = (F.col("source").rlike(_pattern(module_name, literal))
            & F.col("description").rlike("(?iu)" + IMPORT_OR_DEPEND))
    return _edge_rows(rel, cond)


def find_dependents(rel: DataFrame, module_name: str, literal: bool = False) -> DataFrame:
    """Edges whose *target* matches ``module_name`` and whose description says import/depend."""
    cond = (F.col("target").rlike(_pattern(module_name, literal))
            & F.col("description").rlike("(?iu)" + IMPORT_OR_DEPEND))
    return _edge_rows(rel, cond)


def in_degree(rel: DataFrame) -> DataFrame:
    """Edge rows per target (no dedup), as ``(module, in_degree)``."""
    return rel.groupBy(F.col("target").alias("module")).agg(F.count(F.lit(1)).alias("in_degree"))


def dependency_layers(rel: DataFrame, n_edge: int = 5, n_middle: int = 10) -> DataFrame:
    """Leaf / intermediate / top modules by in-degree.

    ``leaf`` = first ``n_edge`` of the ascending order, ``intermediate`` = the
    next ``n_middle``, ``top`` = last ``n_edge`` (groups overlap when there are
    few targets, as in the original lists).  ``pos`` is the position inside the
    list, ascending.
    """
    deg = in_degree(rel)
    asc = [F.col("in_degree").asc(), F.col("module").asc()]
    desc = [F.col("in_degree").desc(), F.col("module").desc()]
    # two bounded top-k's over one aggregate: the first n_edge+n_middle ascending
    # (leaf + intermediate) and the last n_edge; the aggregate exchange is reused
    head = deg.orderBy(*asc).limit(n_edge + n_middle).withColumn("_i", F.lit(None).cast("int"))
    w_all = Window.orderBy(*asc)   # over <= n_edge + n_middle rows
    head = head.withColumn("_i", F.row_number().over(w_all) - 1)
    leaf = head.where(F.col("_i") < n_edge).withColumn("layer", F.lit("leaf_modules"))
    middle = head.where(F.col("_i") >= n_edge).withColumn("layer", F.lit("intermediate_modules"))
    top = deg.orderBy(*desc).limit(n_edge).withColumn("_i", F.lit(0)).withColumn("layer", F.lit("top_modules"))
    # the three slices are bounded (<= 20 rows): the window only orders within them
    w = Window.partitionBy("layer").orderBy(*asc)
    return (leaf.unionByName(middle).unionByName(top)
            .withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
            .select("layer", "pos", "module", "in_degree"))


def root_modules(rel: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities nobody depends on (in-degree 0): anti-join, distributed."""
    targets = rel.select(F.col("target").alias("title")).distinct()
    return entities.select("title").distinct().join(targets, "title", "left_anti") \
        .select(F.col("title").alias("module"), F.lit(0).cast("bigint").alias("in_degree"))


def dependency_report(rel: DataFrame, module_name: str, dependents_of: str = "database",
                      literal: bool = False) -> DataFrame:
    """Dependencies of a module, dependents of another, and the layers -- one tagged table."""
    # both edge sections from one scan: a row matching both appears once per section
    dep_c = (F.col("source").rlike(_pattern(module_name, literal))
             & F.col("description").rlike("(?iu)" + IMPORT_OR_DEPEND))
    dnt_c = (F.col("target").rlike(_pattern(dependents_of, literal))
             & F.col("description").rlike("(?iu)" + IMPORT_OR_DEPEND))
    tags = F.array_compact(F.array(F.when(dep_c, F.lit("dependencies")), F.when(dnt_c, F.lit("dependents"))))
    weight = F.col("weight").cast("double") if "weight" in rel.columns else F.lit(1.0)
    edges = (rel.where(dep_c | dnt_c)
             .select(F.explode(tags).alias("section"), F.col("source").alias("from"), F.col("target").alias("to"),
                     F.col("description").alias("type"), weight.alias("weight"),
                     F.lit(None).cast("string").alias("module"), F.lit(None).cast("bigint").alias("in_degree"),
                     F.lit(None).cast("int").alias("pos")))
    layers = dependency_layers(rel).select(
        F.col("layer").alias("section"), F.lit(None).cast("string").alias("from"),
        F.lit(None).cast("string").alias("to"), F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("double").alias("weight"), "module", "in_degree", "pos")
    return edges.unionByName(layers)


# ------------------------------------------------------------ metadata analytics
def library_inventory(md: DataFrame) -> DataFrame:
    """Per library: versions in use, files, vulnerable files, version-conflict flag.

    ``md`` has one row per (file, library) with ``library_name``,
    ``library_version``, ``vulnerabilities`` (array) and ``file_path``.
    Grouping is a partial/final hash aggregate; one hot library is combined
    map-side before the shuffle.
    """
    # distinct values first: a library used by a third of all files contributes
    # one row per version / vulnerability to the collect, not one per file
    versions = md.select("library_name", "library_version").distinct().groupBy("library_name").agg(
        F.array_join(F.array_sort(F.collect_list("library_version")), ",").alias("versions"),
        F.count("library_version").alias("n_versions"))
    vulns = (md.select("library_name", F.explode("vulnerabilities").alias("v")).distinct()
             .groupBy("library_name").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("vulnerabilities")))
    files = md.groupBy("library_name").agg(
        F.countDistinct("file_path").alias("n_files"),
        F.count(F.when(F.size("vulnerabilities") > 0, F.lit(1))).alias("n_vulnerable_files"))
    g = (files.join(versions, "library_name", "left").join(vulns, "library_name", "left")
         .select("library_name", F.coalesce("versions", F.lit("")).alias("versions"),
                 F.coalesce("n_versions", F.lit(0)).alias("n_versions"), "n_files", "n_vulnerable_files",
                 F.coalesce("vulnerabilities", F.lit("")).alias("vulnerabilities")))
    return g.withColumn("version_conflict", F.col("n_versions") > 1)


def library_versions(uses: DataFrame) -> DataFrame:
    """Per library: newest version in use, outdated files, conflicts, deprecation (Q9).

    ``uses`` has one row per (file, library) with ``file_path``, ``library_name``,
    ``library_version`` and, if known, ``deprecated`` and ``requires`` (a range of versions).
    ``newest`` is the greatest version by number, not by text; ``n_outdated`` the files that use
    an older one; ``conflicting`` says that files use versions of different first numbers
    or that no version meets all ranges.  Two aggregations, each with map-side combine;
    no list of files or versions is gathered.
    """
    u = uses.select("file_path", "library_name", "library_version", V.version_key(F.col("library_version")).alias("key"),
                    (F.col("deprecated") if "deprecated" in uses.columns else F.lit(False)).alias("deprecated"),
                    (V.range_bounds(F.col("requires")) if "requires" in uses.columns else V.range_bounds(F.lit(None).cast("string"))).alias("r"))
    low = F.struct(F.col("r.low").alias("key"), F.col("r.low_open").alias("open"))
    high = F.struct(F.col("r.high").alias("key"), (~F.col("r.high_open")).alias("closed"))
    # one row a library and version
    per = u.groupBy("library_name", "key").agg(
        F.max("library_version").alias("version"), F.countDistinct("file_path").alias("n_files"), F.bool_or(F.coalesce("deprecated", F.lit(False))).alias("deprecated"),
        F.max(F.when(F.col("r.low").isNotNull(), low)).alias("low"), F.min(F.when(F.col("r.high").isNotNull(), high)).alias("high"))
    lib = per.groupBy("library_name").agg(
        F.max_by("version", "key").alias("newest"), F.max("key").alias("top"), F.countDistinct("key").alias("n_versions"), F.countDistinct("key.n0").alias("n_first"),
        F.bool_or("deprecated").alias("deprecated"), F.max("low").alias("low"), F.min("high").alias("high"))
    old = per.join(lib.select("library_name", "top"), "library_name").where(F.col("key") < F.col("top")) \
        .groupBy("library_name").agg(F.sum("n_files").alias("n_outdated"))
    met = V.have_common(F.col("low.key"), F.col("low.open"), F.col("high.key"), ~F.col("high.closed"))
    return lib.join(old, "library_name", "left").select(
        "library_name", "newest", F.col("n_versions").cast("bigint"), F.coalesce("n_outdated", F.lit(0)).alias("n_outdated"), "deprecated",
        ((F.col("n_first") > 1) | ~met).alias("conflicting"))


def call_graph(md: DataFrame, callee_is_caller: bool = True) -> DataFrame:
    """Method call edges from per-method callee lists, resolved against known methods.

    The metadata text describes ``callees`` as the methods that *call* this one,
    so by default an edge runs callee-list entry -> method; flip with
    ``callee_is_caller=False``.
    """
    ex = md.select("file_path", "method_name", F.explode("callees").alias("other"))
    known = md.select(F.col("method_name").alias("other")).distinct().withColumn("known", F.lit(True))
    # resolution = does the listed name exist as a method? (left join keeps every row)
    ex = ex.join(known, "other", "left")
    src, dst = ("other", "method_name") if callee_is_caller else ("method_name", "other")
    edges = ex.select(F.col(src).alias("caller"), F.col(dst).alias("callee"),
                      F.coalesce(F.col("known"), F.lit(False)).alias("resolved"))
    return edges.groupBy("caller", "callee").agg(
        F.count(F.lit(1)).alias("n_sites"), F.bool_and("resolved").alias("resolved"))
