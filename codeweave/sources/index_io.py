"""Index tables on shared storage: load (S7, S8), write (K4, K5), export/import (K6),
plus the run outputs of corpus preparation (K1-K3) and the corpus view (S9).

An index is a folder of parquet tables under ``{root}/runs/`` (``INDEX_TABLES``, and those of ``MORE_TABLES`` that were
made), named by the last row of ``{root}/manifest``.  Reads are lazy, so a question that touches two columns of ``relationships`` scans two columns.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.session import read_if_there

INDEX_TABLES = ["entities", "relationships", "text_units", "communities", "community_reports", "membership"]
#: Tables that an index may have besides: what search and inventory read.
MORE_TABLES = ["report_postings", "report_terms", "report_corpus", "methods", "libraries"]


#: Columns that a table must have to be published.
REQUIRED = {
    "entities": {"title", "type"}, "relationships": {"source", "target", "description", "weight"},
    "text_units": {"id", "document_id", "text"}, "communities": {"community", "level", "parent"},
    "community_reports": {"community", "level", "title", "summary", "full_content"}, "membership": {"level", "community", "node"},
    "report_postings": {"term", "block", "best", "docs"}, "report_terms": {"term", "df"}, "report_corpus": {"n", "words"},
    "methods": {"file_path", "method_name", "callees"}, "libraries": {"file_path", "library_name", "library_version"},
}


def _check(name: str, df: DataFrame) -> None:
    lacking = sorted(REQUIRED[name] - set(df.columns))
    if lacking:
        raise ValueError(f"index table {name} lacks columns {lacking}")


def current_run(spark: SparkSession, root: str) -> tuple[int, str, list[str]] | None:
    """(version, run, tables) of the index that readers see; None if nothing is published."""
    m = read_if_there(spark, f"{root.rstrip('/')}/manifest")
    last = m.orderBy(F.desc("version"), F.desc("run")).first() if m is not None else None
    return (last["version"], last["run"], list(last["tables"])) if last else None


def write_index(tables: dict[str, DataFrame], root: str) -> int:
    """K4: write all tables to a folder of their own, check them, then publish them at once.

    Publishing adds one row (one file) to the manifest, whose highest version is the index.
    If anything fails before, readers go on with the index of before and
    never see the unfinished folder.  Returns the version.
    """
    missing = sorted(set(INDEX_TABLES) - set(tables))
    if missing:
        raise ValueError(f"index is missing tables {missing}")
    root, run = root.rstrip("/"), uuid.uuid4().hex
    names = [n for n in [*INDEX_TABLES, *MORE_TABLES] if n in tables]
    for name in names:
        _check(name, tables[name])
        tables[name].write.parquet(f"{root}/runs/{run}/{name}")
    spark = tables[names[0]].sparkSession
    for name in names:
        written = spark.read.parquet(f"{root}/runs/{run}/{name}")
        if [(c, t) for c, t in written.dtypes] != [(c, t) for c, t in tables[name].dtypes]:
            raise ValueError(f"index table {name} reads back with another schema")
    before = current_run(spark, root)
    version = before[0] + 1 if before else 1
    spark.createDataFrame([(version, run, names)], "version long, run string, tables array<string>").coalesce(1) \
        .write.mode("append").parquet(f"{root}/manifest")
    return version


def load_index(spark: SparkSession, root: str, views: bool = False, version: int | None = None) -> dict[str, DataFrame]:
    """The published tables as lazy DataFrames, checked; ``views`` also registers them as temp views."""
    found = current_run(spark, root)
    if found is None:
        raise ValueError(f"no index is published under {root}")
    if version is not None and version != found[0]:
        row = spark.read.parquet(f"{root.rstrip('/')}/manifest").where(F.col("version") == version).first()
        if row is None:
            raise ValueError(f"index version {version} is not published under {root}")
        found = (version, row["run"], list(row["tables"]))
    out = {}
    for name in found[2]:
        df = spark.read.parquet(f"{root.rstrip('/')}/runs/{found[1]}/{name}")
        _check(name, df)
        if views:
            df.createOrReplaceTempView(name)
        out[name] = df
    return out


def export_index(spark: SparkSession, src_root: str, dst_root: str) -> None:
    """K6: copy the published index (read, check, write, check, publish)."""
    write_index(load_index(spark, src_root), dst_root)


import_index = export_index


def write_vectors(vectors: DataFrame, path: str) -> None:
    """K5: vector store as parquet, overwritten, one folder per kind."""
    vectors.write.mode("overwrite").partitionBy("kind").parquet(path)


def write_metadata_csv(df: DataFrame, run_dir: str, language: str, config: bool, epoch: int) -> str:
    """K1: metadata of one pass as CSV (no index column), named like the original run files."""
    path = os.path.join(run_dir, f"data_{language}_{'config_' if config else '_'}{epoch}.csv")
    # CSV holds scalars only: nested values are written as JSON text
    cols = [F.to_json(F.col(c)).alias(c) if t.startswith(("array", "struct", "map")) else
            (F.col(c).cast("string").alias(c) if t == "variant" else F.col(c)) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_annotated(df: DataFrame, root: str) -> None:
    """K2/K3: annotated texts and metadata texts as one parquet table ``(path, text)``."""
    a = df.select(F.col("target_path").alias("path"), "text")
    if "metadata_text" in df.columns:
        a = a.unionByName(df.select(F.col("metadata_path").alias("path"), F.col("metadata_text").alias("text")))
    a.write.mode("overwrite").parquet(root)


def export_text_files(corpus: DataFrame, root: str) -> None:
    """Optional file export: each task writes its own rows' files (shared storage)."""
    def write_part(rows):
        for r in rows:
            dst = os.path.join(root, r["path"])
            os.makedirs(os.path.dirname(dst) or ".", exist_ok=True)
            with open(dst, "w", encoding="utf-8") as f:
                f.write(r["text"])
    corpus.select("path", "text").foreachPartition(write_part)


def corpus_documents(annotated: DataFrame) -> DataFrame:
    """The text corpus the indexer reads -- annotated files and metadata files together."""
    a = annotated.select(F.col("target_path").alias("id"), F.col("target_path").alias("path"), "text")
    if "metadata_text" in annotated.columns:
        a = a.unionByName(annotated.select(F.col("metadata_path").alias("id"), F.col("metadata_path").alias("path"),
                                           F.col("metadata_text").alias("text")))
    return a
