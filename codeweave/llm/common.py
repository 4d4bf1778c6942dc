"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.session import checkpoint_dir, cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of ASCII that is neither a digit nor a lower-case letter part the words.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` under the session's shared checkpoint folder and read it back."""
    return cut_lineage(df)


def scratch(spark: SparkSession) -> str:
    """A new folder under the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/codeweave-files/{uuid.uuid4().hex}"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept (``lower`` is right for pure ASCII)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, UPPER.lower()))


def ascii_words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m`` (null ids count as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base = "_" + base
    return base


def chunks(texts: Iterable[str], max_chars: int) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts in groups of about ``max_chars`` characters: (index of the first, texts)."""
    part: list[str] = []
    at = size = 0
    for i, t in enumerate(texts):
        if part and size + len(t) > max_chars:
            yield at, part
            part, at, size = [], i, 0
        part.append(t)
        size += len(t)
    if part:
        yield at, part


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def components(pairs: DataFrame) -> DataFrame:
    """Connected components of ``pairs(a, b)`` (undirected): ``(node, root)``, root = smallest node.

    Min-label rounds with pointer jumping.  Each round is one join on the arcs,
    one aggregation with map-side combine and one write of ``(node, root)``
    under the checkpoint folder; the driver reads one number a round.
    """
    arcs = materialise(pairs.where("a <> b").select("a", "b")
                       .unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = materialise(arcs.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = arcs.join(lab, arcs.b == lab.node).select(arcs.a.alias("node"), "root")
        best = near.unionByName(lab).groupBy("node").agg(F.min("root").alias("root"))
        # the root of my root: one row a node on the right side
        up = lab.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = materialise(best.join(up, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root")))
        moved = new.join(lab.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        lab = new
        if not moved:
            return lab
