"""Merkle manifest of a dataset with nested-interval labels (operator 11).

Every row is a leaf (a digest of its fields).  The leaves of a source, in the order of
their ids, are ranked; a node of its tree covers an interval of leaf ranks ``[lo, hi)``.
``ARITY`` consecutive nodes have a parent, whose digest is that of theirs in a row; the
last run may be shorter.  What remains at the end is the source's subroot, and the
subroots, ranked by source, are the leaves of one more tree, whose top is the root.

*Labels.*  The tables of ``Manifest`` hold *families*: ``(tree, level, lo, hi, digest,
kids)``, a parent with its interval and its children with theirs.  Levels come in
buckets of ``LEVELS``: all levels of a bucket below one of its nodes are made in one
group of at most ``ARITY ** LEVELS`` digests, so a tree takes one shuffle a bucket and no
group grows with the data.

*Proofs.*  The ancestors of a rank are the families whose intervals contain it, found by
a containment join; the siblings on the way are the difference of a family's interval
and the child that contains the rank.  The join goes bucket by bucket: a leaf meets the
families of the lowest bucket, the node over that bucket those of the next one, and so
on, so no family meets more than ``ARITY ** LEVELS`` ranks and the long upper ends of
proofs are made once for all leaves below.

Ranks come from a range-partitioned sort: the position in a partition plus the rows of
the source in the partitions before.  A source of any share of the rows is thus spread
over many tasks.

Cases: null fields are ``-``, every other value carries its length, so no two rows of
different fields have the same input; a null source is a source of its own and comes
first, null ids come first; rows of one id are ranked by digest (equal rows are alike); a
source of one row has the leaf as its subroot; an empty table gives an empty result and no
root; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeweave.llm.common import materialise

ARITY = 3
LEVELS = 6  # levels of a bucket
SPAN = ARITY ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROOT_TREE = "root"


# ------------------------------------------------------------------- digests
def h(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` or length, colon, value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return h(F.concat(*[field(c) for c in fields]))


def tree_key(source: Column) -> Column:
    """A key of the source that is never null and sorts as the sources do, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


# --------------------------------------------------------------------- ranks
def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``lo``, the rank within ``tree`` in the given order, and ``size``, the rows of the tree."""
    keys = ["tree", *order]
    placed = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
                         .withColumn("task", F.shiftright("at", 33)))
    runs = placed.groupBy("task", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tasks = Window.partitionBy("tree")  # a row a task
    runs = runs.withColumns({"before": F.coalesce(F.sum("n").over(tasks.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                             "size": F.sum("n").over(tasks)})
    return placed.join(runs.drop("n"), ["task", "tree"]).withColumn("lo", F.col("before") + F.col("at") - F.col("first")) \
        .drop("task", "at", "first", "before")


# --------------------------------------------------------------------- trees
@dataclass(frozen=True)
class Trees:
    families: list[DataFrame]  # a bucket of levels each: (tree, size, level, lo, hi, digest, kids)
    tops: DataFrame  # (tree, digest)


def _parents(nodes: Column) -> Column:
    """Families over consecutive runs of ``nodes(lo, hi, digest)``."""
    def family(i: Column) -> Column:
        kids = F.slice(nodes, i, ARITY)
        return F.struct(F.element_at(kids, 1)["lo"].alias("lo"), F.element_at(kids, -1)["hi"].alias("hi"),
                        h(F.array_join(F.transform(kids, lambda k: k["digest"]), "")).alias("digest"), kids.alias("kids"))

    return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(ARITY)), family)


def _at_level(level: int):
    return lambda f: F.struct(F.lit(level).alias("level"), f["lo"].alias("lo"), f["hi"].alias("hi"), f["digest"].alias("digest"), f["kids"].alias("kids"))


def _bucket(nodes: DataFrame, bucket: int) -> DataFrame:
    """Families of one bucket of levels over its lowest nodes ``(tree, size, lo, hi, digest)``."""
    width = SPAN ** (bucket + 1)
    g = nodes.groupBy("tree", "size", F.expr(f"lo div {width}").alias("block")) \
        .agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("nodes"))  # at most SPAN
    none = F.array().cast("array<struct<lo:bigint,hi:bigint,digest:string,kids:array<struct<lo:bigint,hi:bigint,digest:string>>>>")
    made = []
    for j in range(LEVELS):
        # a tree ends with one node; below that every run has a parent, even a run of one
        grows = (F.col("size") > width) | (F.size("nodes") > 1)
        g = g.withColumn(f"f{j}", F.when(grows, _parents(F.col("nodes"))).otherwise(none))
        g = g.withColumn("nodes", F.when(F.size(f"f{j}") > 0, F.transform(f"f{j}", lambda f: F.struct(f["lo"], f["hi"], f["digest"])))
                         .otherwise(F.col("nodes")))
        made.append(F.transform(f"f{j}", _at_level(bucket * LEVELS + j)))
    return g.select("tree", "size", F.explode(F.concat(*made)).alias("f")).select("tree", "size", "f.*")


def build(leaves: DataFrame) -> Trees:
    """Trees over ``leaves(tree, size, lo, digest)``."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    nodes = leaves.select("tree", "size", "lo", (F.col("lo") + 1).alias("hi"), "digest")
    families, tops = [], leaves.where("size = 1").select("tree", "digest")
    while not families or SPAN ** len(families) < most:
        families.append(materialise(_bucket(nodes, len(families))))
        top = F.col("level") == len(families) * LEVELS - 1
        whole = (F.col("lo") == 0) & (F.col("hi") == F.col("size"))
        nodes = families[-1].where(top & (F.col("size") > SPAN ** len(families))).select("tree", "size", "lo", "hi", "digest")
        # the whole tree's interval may be that of several families; the highest one is its top
        tops = tops.unionByName(families[-1].where(whole & (F.col("size") <= SPAN ** len(families))).groupBy("tree")
                                .agg(F.max_by("digest", "level").alias("digest")))
    return Trees(families, tops)


def paths(leaves: DataFrame, trees: Trees, ends: DataFrame | None = None) -> DataFrame:
    """``(tree, lo, steps)``: for every leaf the digests left and right of it on the way up, level by level.

    ``ends(tree, steps)`` go behind the steps of every leaf of a tree.
    """
    upper = None  # (tree, lo, steps) of the nodes under the bucket above
    for bucket in reversed(range(len(trees.families))):
        base, width = ARITY ** (bucket * LEVELS), SPAN ** (bucket + 1)
        nodes = leaves.select("tree", "lo") if not bucket else \
            trees.families[bucket - 1].where((F.col("level") == bucket * LEVELS - 1) & (F.col("size") > base)).select("tree", "lo")
        probe = nodes.withColumn("level", F.explode(F.sequence(F.lit(bucket * LEVELS), F.lit((bucket + 1) * LEVELS - 1)))) \
            .select("tree", "level", F.col("lo").alias("rank"))
        widths = ", ".join(f"{base * ARITY ** (j + 1)}L" for j in range(LEVELS))
        cell = f"{{}} div element_at(array({widths}), level - {bucket * LEVELS - 1})"
        over = trees.families[bucket].select("tree", "level", "lo", "hi", "kids")
        p, f = probe.withColumn("cell", F.expr(cell.format("rank"))), over.withColumn("cell", F.expr(cell.format("lo")))
        inside = (F.col("lo") <= F.col("rank")) & (F.col("rank") < F.col("hi"))
        met = p.join(f, ["tree", "level", "cell"]).where(inside)

        def beside(apart) -> Column:
            return F.array_join(F.transform(F.filter("kids", apart), lambda k: k["digest"]), "")

        step = F.struct("level", beside(lambda k: k["hi"] <= F.col("rank")).alias("left"), beside(lambda k: k["lo"] > F.col("rank")).alias("right"))
        own = met.select("tree", "rank", step.alias("step")).groupBy("tree", "rank").agg(F.sort_array(F.collect_list("step")).alias("own"))
        ways = nodes.join(own.withColumnRenamed("rank", "lo"), ["tree", "lo"], "left")
        above = upper.withColumn("block", F.expr(f"lo div {width}")).drop("lo") if upper is not None else None
        if not bucket and ends is not None:  # joined by block, of which a tree has far fewer than leaves
            blocks = leaves.select("tree", F.expr(f"lo div {width}").alias("block")).distinct()
            above = blocks.join(above, ["tree", "block"], "left") if above is not None else blocks.withColumn("steps", F.lit(None))
            above = above.join(ends.withColumnRenamed("steps", "end"), "tree") \
                .select("tree", "block", F.concat(F.coalesce("steps", F.array()), F.col("end")).alias("steps"))
        if above is None:
            upper = ways.select("tree", "lo", F.coalesce("own", F.array()).alias("steps"))
        else:
            upper = ways.withColumn("block", F.expr(f"lo div {width}")).join(above, ["tree", "block"], "left") \
                .select("tree", "lo", F.concat(F.coalesce("own", F.array()), F.coalesce("steps", F.array())).alias("steps"))
        if bucket:
            upper = materialise(upper)
    return upper


# ------------------------------------------------------------------ manifest
@dataclass(frozen=True)
class Manifest:
    leaves: DataFrame  # (id, tree, size, lo, digest, changed)
    sources: DataFrame  # (tree, subroot, size, lo, digest) the leaves of the root's tree
    trees: Trees
    root_tree: Trees
    root: str | None


def manifest(docs: DataFrame, now: DataFrame | Column | None = None, id_col: str = "doc_id", source_col: str = "source",
             fields: tuple[str, ...] = FIELDS, text_col: str = "text") -> Manifest:
    """Trees of ``docs``; ``now`` (a column) is the text as it is found later, whose digest goes into ``changed``."""
    cols = [F.col(c) for c in fields]
    later = [now if c == text_col and now is not None else F.col(c) for c in fields]
    rows = docs.select(F.col(id_col).alias("id"), tree_key(F.col(source_col)).alias("tree"), leaf_digest(cols).alias("digest"),
                       leaf_digest(later).alias("changed"))
    leaves = materialise(ranked(rows, "id", "digest"))
    trees = build(leaves)
    tops = trees.tops.select(F.lit(ROOT_TREE).alias("tree"), F.col("tree").alias("source"), "digest")
    sources = materialise(ranked(tops, "source"))
    root_tree = build(sources)
    top = root_tree.tops.first()
    return Manifest(leaves, sources, trees, root_tree, top["digest"] if top else None)


def prove(m: Manifest) -> DataFrame:
    """``(id, leaf, subroot, root, steps, changed)`` of every leaf: ``steps`` lead from the leaf to the root."""
    ends = paths(m.sources, m.root_tree).join(m.sources.select("tree", "lo", "source"), ["tree", "lo"]) \
        .select(F.col("source").alias("tree"), "steps")
    last = m.sources.select(F.col("source").alias("tree"), F.struct(F.lit(-1).alias("level"), F.col("digest").alias("left"), F.lit("").alias("right")).alias("top"))
    # the subroot goes along as an entry of its own, so that it too is joined by block
    ends = materialise(ends.join(last, "tree").select("tree", F.concat(F.array("top"), "steps").alias("steps")))
    ways = paths(m.leaves, m.trees, ends)
    return m.leaves.join(ways, ["tree", "lo"]).select(
        "id", F.col("digest").alias("leaf"), F.filter("steps", lambda s: s["level"] == -1)[0]["left"].alias("subroot"), F.lit(m.root).alias("root"),
        F.filter("steps", lambda s: s["level"] >= 0).alias("steps"), "changed")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf leads to."""
    return F.aggregate(steps, leaf, lambda d, s: h(F.concat(s["left"], d, s["right"])))


def proof(steps: Column) -> Column:
    """All siblings in a row."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def verify(proofs: DataFrame) -> DataFrame:
    """``proofs`` with ``folded_root`` of the leaves as they are found later, and ``verified``."""
    return proofs.withColumn("folded_root", fold(F.col("changed"), F.col("steps"))) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def report(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, verified against a copy whose texts lost their line breaks where 2 divides crc32(doc_id)."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    now = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return verify(prove(manifest(docs, now))).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", h(proof(F.col("steps"))).alias("proof_sha256"), "folded_root", "verified")


#: crc32 bit by bit, then level by level over lists of each tree's digests.
ORACLE = """
WITH RECURSIVE f AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, text,
         list_reduce(flatten(list_transform(range(1, length(doc_id::varchar) + 1),
                       lambda i: [ascii(substr(doc_id::varchar, i::int, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
                     lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295::bigint) AS crc,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') AS head
  FROM documents),
d AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             sha256(head || coalesce(strlen(t) || ':' || t, '-')) AS changed
      FROM (SELECT *, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM f)),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS lo FROM d),
lv(tree, l, hs) AS (
  SELECT tree, 0, list(leaf ORDER BY lo) FROM r GROUP BY tree
  UNION ALL
  SELECT tree, l + 1, list_transform(range(0, len(hs), 3), lambda i: sha256(array_to_string(hs[i + 1:i + 3], ''))) FROM lv WHERE len(hs) > 1),
s AS (SELECT tree, hs[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS lo FROM lv WHERE len(hs) = 1),
top(l, hs) AS (
  SELECT 0, list(subroot ORDER BY lo) FROM s
  UNION ALL
  SELECT l + 1, list_transform(range(0, len(hs), 3), lambda i: sha256(array_to_string(hs[i + 1:i + 3], ''))) FROM top WHERE len(hs) > 1),
steps AS (
  SELECT r.tree, r.lo, lv.l, r.lo // pow(3, lv.l)::bigint AS p, hs[p - p % 3 + 1:p] AS before, hs[p + 2:p - p % 3 + 3] AS after
  FROM r JOIN lv ON lv.tree = r.tree AND len(lv.hs) > 1
  UNION ALL
  SELECT r.tree, r.lo, 100 + t.l, s.lo // pow(3, t.l)::bigint AS p, hs[p - p % 3 + 1:p], hs[p + 2:p - p % 3 + 3]
  FROM r JOIN s ON s.tree = r.tree JOIN top t ON len(t.hs) > 1),
way AS (SELECT tree, lo, list(array_to_string(before, '') || ',' || array_to_string(after, '') ORDER BY l) AS w FROM steps GROUP BY tree, lo),
o AS (SELECT r.doc_id, r.leaf, s.subroot, (SELECT hs[1] FROM top WHERE len(hs) = 1) AS root, r.changed, coalesce(w, []) AS w
      FROM r JOIN s ON s.tree = r.tree LEFT JOIN way ON way.tree = r.tree AND way.lo = r.lo),
z AS (SELECT *, sha256(replace(coalesce(array_to_string(w, ''), ''), ',', '')) AS proof_sha256,
             list_reduce(w, lambda d, x: sha256(split_part(x, ',', 1) || d || split_part(x, ',', 2)), changed) AS folded_root FROM o)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM z
"""
