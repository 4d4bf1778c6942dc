"""Approximate vector search: cells with residual codes and an exact re-rank.

*Build.*  Centroids come from k-means on at most about ``SAMPLE`` vectors (unit length); every
vector of the corpus goes to its nearest centroid and is coded as the residual in 8 bits a
dimension, with one scale a vector.  Codes are a parquet table sorted by cell, so a reader
that asks for a few cells skips the row groups of all others.

*Search.*  A query looks at its ``probes`` nearest cells.  Their codes give approximate
cosines; the best ``RERANK`` times k of them are compared with the vectors themselves.
Queries go in blocks of ``search.QUERY_BLOCK``; centroids are sent to the tasks, their number
is bounded by ``MAX_CELLS``.

Null, empty, zero or non-finite vectors, and those of another length, are in no cell.  The
exact search is ``search.vector_topk``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeweave.session import cut_lineage

SAMPLE = 50_000
MAX_CELLS = 4096
RERANK = 10
ROW_GROUP = 4 << 20


def _unit(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)``: vectors of the usual length scaled to one, others left out."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    d = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(
        (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    d = d.withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where("len > 0")
    return d.select("id", F.transform("v", lambda x: x / F.col("len")).alias("v"))


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None) -> None:
    """Write the index of ``vectors`` under ``path``: ``cells`` (centroids) and ``codes``."""
    spark = vectors.sparkSession
    unit = cut_lineage(_unit(vectors, id_col, vec_col))
    # the usual length: that of most vectors
    usual = unit.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    unit = unit.where(F.size("v") == (usual["n"] if usual else 0))
    n = unit.count()
    share = min(1.0, SAMPLE / max(n, 1))
    cells = cells or max(1, min(MAX_CELLS, math.isqrt(n)))
    some = unit.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(1_000_000 * share)).select(array_to_vector("v").alias("features"))
    centers = np.array(KMeans(k=cells, seed=1, maxIter=10).fit(some).clusterCenters()) if n else np.empty((0, 0))
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cell int, center array<double>") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    kind = unit.schema["id"].dataType.simpleString()

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            v = np.stack(b["v"].to_numpy())
            cell = np.argmax(v @ centers.T - 0.5 * (centers ** 2).sum(axis=1), axis=1)
            rest = v - centers[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
            yield pd.DataFrame({"id": b["id"], "cell": cell.astype("int32"), "scale": scale,
                                "code": [x.tobytes() for x in np.rint(rest / scale[:, None]).astype(np.int8)]})

    unit.mapInPandas(code, f"id {kind}, cell int, scale double, code binary").repartitionByRange("cell", "id").sortWithinPartitions("cell") \
        .write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/codes")


def search(spark: SparkSession, path: str, vectors: DataFrame, queries: DataFrame, k: int = 5, probes: int = 8, id_col: str = "vec_id",
           vec_col: str = "embedding", qid_col: str = "label") -> DataFrame:
    """``(query_id, id, score, rank)``: approximate cosine top-k of ``queries(qid_col, query)``, re-ranked on ``vectors``."""
    from codeweave.operators.search import QUERY_BLOCK

    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MAX_CELLS at most
    centers = np.array([r["center"] for r in cells])
    q = cut_lineage(_unit(queries, qid_col, "query").where(F.size("v") == (centers.shape[1] if len(centers) else 0)))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    codes, wide = spark.read.parquet(f"{path}/codes"), RERANK * k
    kind, q_kind = codes.schema["id"].dataType.simpleString(), q.schema["id"].dataType.simpleString()
    near = None
    for block in range(blocks if len(centers) else 0):
        mine = q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()  # about QUERY_BLOCK rows
        names, mat = [r["id"] for r in mine], np.array([r["v"] for r in mine]).reshape(len(mine), -1)
        if not names:
            continue
        probed = np.argsort(-(mat @ centers.T - 0.5 * (centers ** 2).sum(axis=1)), axis=1)[:, :probes]
        of_cell: dict[int, list[int]] = {}
        for i, row in enumerate(probed.tolist()):
            for c in row:
                of_cell.setdefault(c, []).append(i)

        def score(batches, names=names, mat=mat, of_cell=of_cell):
            for b in batches:
                out = []
                for c, g in b.groupby("cell"):
                    v = centers[c] + np.frombuffer(b"".join(g["code"]), np.int8).reshape(len(g), -1) * g["scale"].to_numpy()[:, None]
                    s = mat[of_cell[c]] @ v.T
                    for row, i in zip(s, of_cell[c]):
                        top = np.argsort(-row, kind="stable")[:wide]
                        out.append(pd.DataFrame({"query_id": [names[i]] * len(top), "id": g["id"].to_numpy()[top], "near": row[top]}))
                if out:
                    yield pd.concat(out)

        part = codes.where(F.col("cell").isin(sorted(of_cell))).mapInPandas(score, f"query_id {q_kind}, id {kind}, near double")
        near = part if near is None else near.unionByName(part)
    if near is None:
        return spark.createDataFrame([], f"query_id {q_kind}, id {kind}, score double, rank int")
    first = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")  # a few rows a cell and query
    some = cut_lineage(near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= wide).select("query_id", "id"))
    found = _unit(vectors.join(some.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi"), id_col, vec_col)
    dot: Column = F.aggregate(F.zip_with("v", "qv", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    exact = some.join(found, "id").join(q.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id").select("query_id", "id", dot.alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int"))
