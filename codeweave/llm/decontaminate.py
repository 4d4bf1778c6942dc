"""Benchmark decontamination (operator 2), with DataFrame functions only.

A prefix-filtered set join.  Every item is cut into windows of ``WINDOW``
consecutive words (a shorter item is one window).  The tokens of a window are its
shingles of ``SHINGLE`` words (of all its words if it has fewer), ordered by
rarity over all windows.  A window must be contained whole, so its necessary
prefix is its rarest shingle alone.  Documents look up their shingles among
those; a hit fixes where the window would start (positional bound) and whether
it fits into the document (length bound), and the words around the hit, carried
along, verify it exactly.

One scan of the documents and one shuffle of small rows: texts are never
shuffled, and the few words around a hit are the only copies made.  The index is
as large as the benchmark: it is broadcast while its windows number at most
``BROADCAST_WINDOWS`` and joined by shuffle beyond that.  The list of rarest
shingles that documents test in place is used up to ``IN_PLACE`` entries; beyond
that all shingles go to the join.  Both ways give the same rows.

Cases: null or wordless texts have no words, no hit and aren't contaminated;
items without words have no window; an item without an id hits but isn't
listed; equal items and repeated rows count as given (one result per row);
equal ids with different texts are judged apart; empty tables on either side work;
other columns are not read by ``report`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import ascii_words, free_name, materialise

WINDOW = 13
SHINGLE = 3
BROADCAST_WINDOWS = 50_000
IN_PLACE = 50_000
BROADCAST_BAD = 100_000


def _shingle(words: str, at: str, n: int) -> str:
    return f"xxhash64({', '.join(f'get({words}, {at} + {j})' for j in range(n))})"


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(w, len, items)``: distinct windows with the ids of their items."""
    w = items.select(F.col(id_col).cast("string").alias("item"), ascii_words(F.col(text_col)).alias("words")).where("size(words) > 0")
    return w.select("item", F.explode_outer(F.expr(
        f"transform(sequence(0, greatest(size(words) - {size}, 0)), i -> slice(words, i + 1, {size}))")).alias("w")) \
        .groupBy("w").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("w"))


def index(wins: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(h, s, off, w, len, items)``: every window under its rarest shingle (hash, words, offset)."""
    def shingles(n: int) -> Column:
        return F.expr(f"transform(sequence(0, len - {n}), i -> struct({_shingle('w', 'i', n)} as h, {n} as s, i as off))")

    kinds = F.when(F.col("len") >= shingle, shingles(shingle))
    for n in range(shingle - 1, 0, -1):
        kinds = kinds.when(F.col("len") == n, shingles(n))
    each = wins.withColumn("sh", F.explode_outer(kinds)).select("w", "len", "items", "sh.*")
    rarity = each.groupBy("h").agg(F.count(F.lit(1)).alias("freq"))
    return each.join(rarity, "h").groupBy("w").agg(
        F.min(F.struct("freq", "h", "off", "s")).alias("best"), F.first("len").alias("len"), F.first("items").alias("items")) \
        .select("best.h", "best.s", "best.off", "w", "len", "items")


def report(docs: DataFrame, items: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: ``(doc_id, text_hash, n_words, n_hit, n_items, items, contaminated)``."""
    idx = materialise(index(windows(items, size, item_id, item_text)))
    n_index = idx.count()
    kinds = sorted(r[0] for r in idx.select("s").distinct().collect())  # at most SHINGLE values
    known = [r[0] for r in idx.select("h").distinct().limit(IN_PLACE + 1).collect()]
    inset = f" in ({','.join(f'{h}L' if h > -2**63 else '-9223372036854775807L - 1L' for h in known)})" if len(known) <= IN_PLACE else " is not null"

    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), ascii_words(F.col(text)).alias("words"))
    reach = size - 1  # words before a hit that its window can hold
    found = [
        f"transform(filter(if(size(words) >= {s}, sequence(0, size(words) - {s}), array()), i -> {_shingle('words', 'i', s)}{inset}), "
        f"i -> struct({_shingle('words', 'i', s)} as h, {s} as s, i as pos, slice(words, greatest(i - {reach}, 0) + 1, {reach + size}) as ctx))"
        for s in kinds if known]
    # explode_outer: plain explode adds a filter on the array, which would be pushed below
    # and there split the text again for every word
    # a row of its own keeps documents without hits; its hash only spreads it
    own = "array(struct(xxhash64(doc_id, text_hash) as h, 0 as s, -1 as pos, cast(array() as array<string>) as ctx))"
    d = d.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.expr(f"concat({', '.join([own, *found])})").alias("c"))
    d = d.select("doc_id", "text_hash", "n_words", F.explode_outer("c").alias("c")).select("doc_id", "text_hash", "n_words", "c.*")

    r = idx.select(F.col("h").alias("ih"), F.col("s").alias("is"), "off", "w", "len", "items")
    if n_index <= BROADCAST_WINDOWS:
        r = F.broadcast(r)
    start = F.col("pos") - F.col("off")
    same = (F.col("h") == F.col("ih")) & (F.col("s") == F.col("is")) & (F.col("pos") >= 0) & (start >= 0) \
        & (start + F.col("len") <= F.col("n_words")) & F.expr(
            f"slice(ctx, greatest(pos - off - greatest(pos - {reach}, 0), 0) + 1, len) = w")
    hits = d.join(r, same, "left").where("pos < 0 or len is not null")
    g = hits.groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"), F.sum(F.when(F.col("pos") < 0, 1).otherwise(0)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("len").isNotNull(), F.struct(start.alias("a"), (start + F.col("len")).alias("b"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    n_hit = F.expr("aggregate(spans, struct(0 as b, 0 as n), (acc, x) -> struct(greatest(acc.b, x.b) as b, "
                   "acc.n + greatest(0, x.b - greatest(acc.b, x.a)) as n), acc -> acc.n)")
    out = g.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"),
                   F.size("items").cast("long").alias("n_items"), "items", "spans", F.explode_outer(F.expr("array_repeat(0, int(copies))")).alias("_"))
    return out.drop("_").withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = materialise(report(docs, items).where("contaminated").select("doc_id", "text_hash").distinct())
    if bad.count() <= BROADCAST_BAD:  # 16 bytes a row
        bad = F.broadcast(bad)
    bid, bhash = free_name(docs, "bad_id"), free_name(docs, "bad_hash")
    bad = bad.withColumnsRenamed({"doc_id": bid, "text_hash": bhash})
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[bid]) & (F.xxhash64(docs["text"]) == bad[bhash]), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, list_slice(w, i + 1, i + least(len(w), 13)) AS win, least(len(w), 13) AS n
       FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i AS a, i + n AS e, list_slice(w, i + 1, i + n) AS win
       FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.a, dw.e, bw.item FROM dw JOIN bw ON dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, e)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
