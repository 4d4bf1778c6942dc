"""Ranked lexical search by accumulator-limited term-at-a-time evaluation (operator 12).

*Index.*  One pass over the documents writes an inverted index in shards (about
``SHARD_WORDS`` words of consecutive rows): a header row with the ids and lengths of its
documents, and a posting row for each term, the documents in the shard that hold it and
how often.  A posting takes three bytes (16 bits of place in the shard and a count of 8,
or 32 bits where a count needs them).  The index holds every term and serves any queries.

*Search.*  A term's weight falls with its document frequency, a sum over its posting
rows.  A shard evaluates a query term at a time, rarest first.  Each new document gets an
accumulator until the sum of the bounds of the terms that are left (weight times the
largest impact in the shard) is below the kth best partial score, that of the shard or
the one carried on from the shards before in the same task.  From then on no document
without an accumulator can come into the first k, so none is made; accumulators that the
bounds keep from the first k go, and the others are updated to their exact scores.
Equal bounds go on, as ties are broken by id.  A task gives its k best for each query;
they are merged by query.

Queries go in blocks of about ``BLOCK_TERMS`` terms, dealt by hash; one block is with the
tasks at a time.  Posting rows of other terms aren't read into the search.

Scores are 64-bit integers and exact, so the limits cut nothing from the results.

Cases: null and wordless texts hold no term and don't count; a query text that is null or
without words has no results; every row of the queries is answered, also rows of one id;
documents of one id are ranked apart; documents without an id come first among equal
scores; an empty table of either kind gives an empty result; only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeweave.llm.common import ascii_words, materialise

SHARD_WORDS = 1_500_000
SHARD_ROWS = 1 << 16
BLOCK_TERMS = 1 << 17
TOP = 10
#: Of an impact: 1000 tf over tf plus a length norm, in integers.
SCALE, TF, NORM, FLAT, SLOPE = 10**9, 1000, 8, 10, 90
# A-Z lower-cased; ASCII other than letters and digits parts the terms
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


# --------------------------------------------------------------------- index
def _shard(number: int, ids: list, words: list[list[bytes]], kind: pa.DataType) -> pa.RecordBatch:
    """Header and posting rows of one shard."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    coded = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    terms, codes = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # a term's documents together, in their order
    keys, tf = np.unique(codes * SHARD_ROWS + np.repeat(np.arange(len(words)), lengths), return_counts=True)
    at = np.searchsorted(keys >> 16, np.arange(len(terms) + 1))
    places, small = (keys & (SHARD_ROWS - 1)).astype("<u2"), tf.astype("<u1")
    wide = np.add.reduceat(tf > 255, at[:-1]) > 0 if len(terms) else np.empty(0, bool)
    p, s = places.tobytes(), small.tobytes()
    tfs = [tf[i:j].astype("<u4").tobytes() if w else s[i:j] for i, j, w in zip(at[:-1], at[1:], wide)]
    docs, n = [p[2 * i:2 * j] for i, j in zip(at[:-1], at[1:])], len(terms) + 1
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, number, np.int64)), pa.concat_arrays([pa.array([None], pa.string()), terms]),
        pa.array(np.concatenate([[int((lengths > 0).sum())], np.diff(at)]).astype(np.int64)),
        pa.array([int(lengths.sum())] + [None] * (n - 1), pa.int64()),
        pa.array([None, *docs], pa.binary()), pa.array([lengths.astype("<u4").tobytes(), *tfs], pa.binary()),
        pa.array([ids] + [None] * (n - 1), pa.list_(kind))], names=["shard", "term", "n", "words", "docs", "counts", "ids"])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(shard, term, n, words, docs, counts, ids)``: posting rows, and header rows (``term`` is null).

    The index is a table under the checkpoint folder.  A posting row has the number of documents ``n``, their places in the shard and counts;
    a header row has the number of documents with a term, all their ``words``, the lengths
    (in ``counts``) and ids.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = d.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        ids, words, size, id_type = [], [], 0, pa.int64()
        for b in batches:
            id_type = b.column(0).type
            for i, t in zip(b.column(0), b.column(1)):
                w = (t.as_py() or "").encode("utf-8", "replace").translate(_TERMS).split()
                if words and (size + len(w) > shard_words or len(words) == SHARD_ROWS):
                    yield _shard(first + number, ids, words, id_type)
                    number, ids, words, size = number + 1, [], [], 0
                ids.append(i.as_py())
                words.append(w)
                size += len(w)
        if words:
            yield _shard(first + number, ids, words, id_type)

    # written once: numbers of shards hold for one evaluation
    return materialise(d.mapInArrow(run, f"shard bigint, term string, n bigint, words bigint, docs binary, counts binary, ids array<{kind}>"))


# -------------------------------------------------------------------- search
def weights(postings: DataFrame, terms: DataFrame) -> tuple[DataFrame, int, int]:
    """``(term, df, w)`` of those ``terms(term)`` that occur; documents with a term; words of all documents."""
    n, words = postings.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    df = postings.where("term is not null").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    w = F.floor(1000 * F.log((F.lit(2 * n + 2).cast("double")) / (2 * F.col("df") + 1).cast("double")))
    return df.withColumn("w", w.cast("long")), n, words


class Best(dict):
    """The k best (score, id) so far of each query."""

    def __init__(self, k: int) -> None:
        self.k = k

    def floor(self, q: int) -> int:
        """What a document needs at least to get in; ties may."""
        top = self.get(q, ())
        return top[-1][0] if len(top) == self.k else 1

    def add(self, q: int, found: list[tuple[int, object]]) -> None:
        self[q] = sorted([*self.get(q, ()), *found], key=lambda x: (-x[0], x[1] is not None, x[1]))[:self.k]


def rank_shard(ids: list, lengths: np.ndarray, postings: dict[str, tuple[np.ndarray, np.ndarray]], queries: dict[int, list[tuple[str, int]]],
               n: int, words: int, best: Best) -> int:
    """Add a shard's documents to ``best``; queries have (term, weight) rarest first.  Returns the accumulators made."""
    norm = NORM * (FLAT + SLOPE * lengths.astype(np.int64) * n // max(words, 1))
    impact, most, made = {}, {}, 0
    for t, (docs, tf) in postings.items():
        impact[t] = SCALE * tf // (TF * tf + norm[docs])
        most[t] = int(impact[t].max())
    for q, terms in queries.items():
        here = [(t, w) for t, w in terms if t in postings and w > 0]
        left = sum(w * most[t] for t, w in here)
        floor = best.floor(q)
        if not here or left < floor:
            continue
        score, alive = np.zeros(len(ids), np.int64), None
        for t, w in here:
            docs, gain = postings[t][0], w * impact[t]
            left -= w * most[t]
            if alive is None:
                score[docs] += gain
                top = int(score.max())
                if left < max(top, floor):  # else no kth score can be above it
                    kth = max(floor, int(np.partition(score, -best.k)[-best.k]) if len(score) >= best.k else 0)
                    if left < kth:
                        made += int((score > 0).sum())
                        alive = (score > 0) & (score + left >= kth)
            else:
                on = alive[docs]
                score[docs[on]] += gain[on]
        if alive is None:
            made += int((score > 0).sum())
            alive = score > 0
        got = np.flatnonzero(alive & (score >= floor))
        if len(got) > best.k:
            got = got[score[got] >= np.partition(score[got], -best.k)[-best.k]]
        best.add(q, [(int(score[i]), ids[i]) for i in got])
    return made


def search(postings: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(id_col, rank, doc_id, score)`` of the ``k`` best documents of ``index`` for every row of ``items``."""
    spark = postings.sparkSession
    q = materialise(items.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("item"), F.array_distinct(ascii_words(F.col(text_col))).alias("terms")))
    qt = q.select("q", F.explode("terms").alias("term"))
    w, n, words = weights(postings, qt.select("term").distinct())
    w = materialise(w)
    qt = materialise(qt.join(w, "term"))
    blocks = max(1, -(-qt.count() // BLOCK_TERMS))
    kind = postings.schema["ids"].dataType.elementType.simpleString()
    found = None
    for block in range(blocks):
        mine = qt.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        queries: dict[int, list[tuple[str, int]]] = {}
        for r in sorted(mine.select("q", "term", "df", "w").collect(), key=lambda r: (r["df"], r["term"])):  # about BLOCK_TERMS rows
            queries.setdefault(r["q"], []).append((r["term"], r["w"]))
        rows = postings.where("term is not null").join(mine.select("term").distinct(), "term", "left_semi") \
            .select("shard", "term", "docs", "counts", F.lit(None).cast(f"array<{kind}>").alias("ids")) \
            .unionByName(postings.where("term is null").select("shard", "term", "docs", "counts", "ids")) \
            .repartition("shard").sortWithinPartitions("shard", "term")  # a shard's header comes first
        out = rows.mapInArrow(_ranker(queries, n, words, k), f"q bigint, score bigint, doc_id {kind}")
        found = out if found is None else found.unionByName(out)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).where(F.col("rank") <= k)
    return best.join(q.select("q", F.col("item").alias(id_col)), "q").select(id_col, "rank", "doc_id", "score")


def _ranker(queries: dict[int, list[tuple[str, int]]], n: int, words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now, id_type = Best(k), None, pa.int64()
        ids, lengths, postings = [], np.empty(0), {}
        for b in batches:
            id_type = b.column(4).type.value_type
            for shard, term, docs, counts, doc_ids in zip(*(b.column(c) for c in range(5))):
                if shard.as_py() != now:
                    if postings:
                        rank_shard(ids, lengths, postings, queries, n, words, best)
                    now, postings = shard.as_py(), {}
                if not term.is_valid:
                    ids, lengths = doc_ids.as_py(), np.frombuffer(counts.as_py(), "<u4")
                    continue
                at, raw = np.frombuffer(docs.as_py(), "<u2"), counts.as_py()
                postings[term.as_py()] = at, np.frombuffer(raw, "<u1" if len(raw) == len(at) else "<u4").astype(np.int64)
        if postings:
            rank_shard(ids, lengths, postings, queries, n, words, best)
        rows = [(q, s, i) for q, top in best.items() for s, i in top]
        q, s, i = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(s, pa.int64()), pa.array(i, id_type)], names=["q", "score", "doc_id"])

    return run


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, w, len(w)::bigint AS n FROM t WHERE len(w) > 0),
a AS (SELECT count(*)::bigint AS big_n, sum(n)::bigint AS big_l FROM d),
p AS (SELECT doc_id, n, term, count(*)::bigint AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM p, a GROUP BY term, big_n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::bigint AS score
      FROM q JOIN f USING (term) JOIN p USING (term), a GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::int AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
