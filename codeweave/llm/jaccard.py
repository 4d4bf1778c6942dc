"""Exact n-gram Jaccard join by universe partitioning (operator 8).

A text's set is its distinct shingles of ``k`` words (64-bit hashes of them; two of
a text's shingles are taken for one with odds below 1e-13 for 1,000 words).  Sets
that are equal form one class, and only one member of a class goes on.

*Pigeonhole.*  If two sets with sizes up to ``U`` have Jaccard ``num/den`` or more,
their symmetric difference is at most ``H = 2U(den-num)/(den+num)``.  Hash the
universe of shingles into ``m`` segments and give segment ``i`` an allocation
``v_i`` of 1 or 2 with ``sum v_i > H``: then some segment differs in fewer than
``v_i`` shingles.  Sizes are cut into bands (``U`` is the band's largest size), and
a set signs for its own band and for those above it that it can reach.  A segment
with ``v = 1`` is signed by its subset, one with ``v = 2`` also by its one-deletion
neighbourhood.

*Allocation by cost.*  Small segments make ``v = 1`` enough nearly everywhere, but unlike
sets then share more signatures.  The cost of ``m`` segments is the signatures that a
set of the band writes plus the candidates they bring: segments times the chance that
all shingles of one are shared.  That chance is measured: ``shared_share`` counts, for a
part of the shingle universe (one in ``PROBE`` of all shingles of all sets), how many of
a set's shingles other sets hold.

*Slack.*  Allocations add up to ``H + 1 + gaps + slack``.  A set may leave out the
signatures of empty segments while their allocations don't exceed ``gaps``, and
signatures that are shared by more than ``HOT`` classes while those don't exceed
``slack``: a partner must then agree with it on another one.  Texts that share a
passage stop meeting; near copies, which share nearly all, still do.

*Verification.*  A class has a sketch of ``64 * SKETCH`` bits, the parities of its
shingles by hash.  The sketches of two sets differ in at most as many bits as the sets in
shingles, so candidates whose sizes or sketches are too far apart go at once and
nothing is lost; sets of more than ``WIDE`` shingles have a longer sketch besides, of two bits
a shingle.  The others are verified exactly on the sets of the whole texts.
First all members of a signature are compared with one of them, the one that
shares most signatures with others, so a group of near copies costs a line, not
all pairs.  Components follow.  Signatures whose members are still in different
components remain.  Of those of at most ``HOT`` members, the members stay that are near one of
another component by size and sketch.  Texts that share a passage make larger ones, which
grow with the table, so there no pairs are looked at first: a set stays only if few enough of
its shingles are its own (``supported``), which takes a row a shingle.  What stays is compared by sketch,
dealt into blocks of ``BLOCK_ROWS``, each pair of blocks a group of its
own that counts all common shingles at once by matrix products and gives only the
edges of a spanning forest.  So no pairs are written, no link is lost to the
components, and no task holds more than two blocks.  Only texts that are to be verified
are shuffled.

Signatures are flat rows ``(key, class)``, computed and shuffled once; keys of one class
go after that shuffle, where they stand side by side.

Cases: null and wordless texts have an empty set and link with nothing; texts of
fewer than ``k`` words have one shingle; rows of one id are judged apart, by the digest of their set; rows
without an id belong to the documents with their set, else they are alone (their
component is null); empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweave.llm.common import components, free_name, materialise

HOT = 64
BLOCK_ROWS = 512
COLUMNS = 4096  # shingles counted at a time
BAND = 1.6  # largest size of a band over its smallest
SKETCH = 8  # longs
WIDE = 400  # shingles of sets that have a wide sketch besides
PROBE = 1024
SEGMENTS_OF = (1, 2, 3, 4, 6)  # sizes of segments that are looked at
CANDIDATE = 20.0  # cost of a candidate over that of a signature
MAP_BITS = 23  # of the bitmap of ids whose texts are needed
CACHE_WORDS = 80_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


# ------------------------------------------------------------------ the sets
class _Words(dict):
    """Hashes of the words seen so far (bounded)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M[3]
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``k`` words of a whole text (A-Z lower-cased, split at ASCII blanks)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, np.uint64(n))
    for j in range(n):
        h = _mix(h + w[j:len(w) - n + 1 + j] * _M[4])
    return np.unique(h)


# --------------------------------------------------------------- the schemes
@dataclass(frozen=True)
class Scheme:
    least: int  # smallest size of the band
    most: int  # largest
    segments: int
    twos: int  # the first segments, with allocation 2
    gaps: int  # allocation of empty segments that may be left out
    slack: int  # allocation of hot segments that may be left out


def difference(size: int, num: int, den: int) -> int:
    """Largest symmetric difference of two sets of up to ``size`` with Jaccard num/den."""
    return 2 * size * (den - num) // (den + num)


def scheme(least: int, most: int, num: int, den: int, shared: float) -> Scheme:
    """Cheapest allocation of the band: ones cost a signature each, twos one more for each shingle of the segment."""
    need = difference(most, num, den) + 1
    gaps, slack = 1 + need // 12, need // 12
    total = need + gaps + slack
    typical = (least * most) ** 0.5
    best = None
    for of in SEGMENTS_OF:
        m = max(-(-total // 2), min(total, least // of))
        twos, per = total - m, typical / m
        cost = m + twos * per + CANDIDATE * (m * shared ** per + twos * per * shared ** max(per - 1, 0))
        if best is None or cost < best[0]:
            best = cost, Scheme(least, most, m, twos, gaps, slack)
    return best[1]


@cache
def schemes(num: int, den: int, shared: float = 0.05) -> tuple[Scheme, ...]:
    """Bands of all sizes that can differ at all (fewer than 128); smaller sets must be equal."""
    out, least = [], 1
    while difference(least, num, den) == 0:
        least += 1
    while least < 2**40:
        most = max(least, int(least * BAND))
        out.append(scheme(least, most, num, den, shared))
        least = most + 1
    return tuple(out)


def signatures(u: np.ndarray, num: int, den: int, shared: float = 0.05) -> np.ndarray:
    """All signatures of a set; the lowest 7 bits of a signature are its scheme."""
    out, n = [np.empty(0, np.int64)], len(u)
    for j, s in enumerate(schemes(num, den, shared)):
        if n > s.most:
            continue
        if den * n < num * s.least:  # too small for any set of this band
            break
        salt = np.uint64((j + 1) * int(_M[1]) % 2**64)
        v = _mix(u ^ salt)
        seg = ((v >> np.uint64(32)) * np.uint64(s.segments) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        v, seg = _mix(v * _M[2])[order], seg[order]
        size = np.bincount(seg, minlength=s.segments)
        upto = np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)])
        ends = np.cumsum(size)
        total = upto[ends] - upto[ends - size]
        near = seg < s.twos  # shingles whose deletion is signed
        where = np.concatenate([np.arange(s.segments), seg[near]])
        content = np.concatenate([total, total[seg[near]] - v[near]])
        empty = np.concatenate([size == 0, size[seg[near]] == 1])
        if empty.any():
            gone = np.unique(where[empty])
            if len(gone) + int((gone < s.twos).sum()) <= s.gaps:
                where, content = where[~empty], content[~empty]
        keys = _mix((content ^ _mix(where.astype(np.uint64) + salt)) * _M[0])
        out.append((keys & ~np.uint64(127) | np.uint64(j)).view(np.int64))
    return np.concatenate(out)


def _class(u: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(u.tobytes()) - 2**63


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the shingles by hash (``h``): ``SKETCH`` longs."""
    bits = np.bincount((h >> np.uint64(32)).astype(np.int64) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_sketch(u: np.ndarray, h: np.ndarray) -> bytes | None:
    """For sets of more than ``WIDE`` shingles, whose short sketches say little: a power of two of bits, two a shingle or more."""
    if len(u) <= WIDE:
        return None
    bits = 1 << int(2 * len(u) - 1).bit_length()
    return np.packbits((np.bincount((h >> np.uint64(16)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(x: np.ndarray) -> np.ndarray:
    """Sketches of half as many bits: the upper half laid over the lower one."""
    half = x.shape[-1] // 2
    return x[..., :half] ^ x[..., half:]


_LONGS = [f"s{i}" for i in range(SKETCH)]


def _in_part(u: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which shingles are in the part of the universe that is looked at first: twice the share in which linked sets may differ."""
    return (_mix(u * _M[2]) >> np.uint64(44)) * np.uint64(den) < np.uint64(2 * (den - num) << 20)


def _sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(id, n_shingles, part, digest, class, s0, ..., probe)`` of every row; the digest and what follows are null for the empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, part, digest, cls, longs, probe, wide = [], [], [], [], [], [], []
            for t in b.column(1):
                u = shingle_set(t.as_py(), k)
                n.append(len(u))
                part.append(int(_in_part(u, num, den).sum()))
                digest.append(xxhash.xxh3_128_digest(u.tobytes()) if len(u) else None)
                cls.append(_class(u) if len(u) else None)
                h = _mix(u * _M[1])
                longs.append(sketch(h))
                wide.append(wide_sketch(u, h))
                probe.append(u[h & np.uint64(PROBE - 1) == 0].view(np.int64))
            s = np.array(longs).reshape(len(n), SKETCH)
            upto = np.concatenate([[0], np.cumsum([len(x) for x in probe])]).astype(np.int32)
            probes = pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate([np.empty(0, np.int64), *probe])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(part, pa.int64()), pa.array(digest, pa.binary()), pa.array(cls, pa.int64()),
                                              *[pa.array(np.ascontiguousarray(s[:, i])) for i in range(SKETCH)], pa.array(wide, pa.binary()), probes],
                                             names=["id", "n_shingles", "part", "digest", "class", *_LONGS, "wide", "probe"])

    kind = docs.schema["id"].dataType.simpleString()
    longs = ", ".join(f"{c} bigint" for c in _LONGS)
    return docs.mapInArrow(run, f"id {kind}, n_shingles bigint, part bigint, digest binary, class bigint, {longs}, wide binary, probe array<bigint>")


def shared_share(sets: DataFrame) -> float:
    """The share of shingle places (of distinct sets) whose shingle another set holds, rounded to 0.01."""
    held = sets.where("class is not null and size(probe) > 0").select("class", F.explode("probe").alias("p")).distinct() \
        .groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    total, common = held.agg(F.sum("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))).first()
    return min(0.5, max(0.01, round((common or 0) / total, 2))) if total else 0.01


def _keys(docs: DataFrame, k: int, num: int, den: int, shared: float) -> DataFrame:
    """``(key, class)`` of all sets, once a class and Arrow batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[int] = set()
            keys, cls, size = [], [], 0
            for t in b.column(0):
                u = shingle_set(t.as_py(), k)
                c = _class(u)
                if not len(u) or c in seen:
                    continue
                seen.add(c)
                g = signatures(u, num, den, shared)
                keys.append(g)
                cls.append(np.full(len(g), c))
                size += len(g)
                if size >= 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(cls))], names=["key", "class"])
                    keys, cls, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(cls))], names=["key", "class"])

    return docs.select("text").mapInArrow(run, "key bigint, class bigint")


# -------------------------------------------------------------- verification
def _near(num: int, den: int, a: str = "a", b: str = "b") -> Column:
    """Sizes and sketches of ``a`` and ``b`` (prefixes of columns) don't rule out a link."""
    na, nb = F.col(f"{a}_n"), F.col(f"{b}_n")
    apart = sum((F.bit_count(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}"))).cast("long") for c in _LONGS), F.lit(0).cast("long"))
    return (den * F.least(na, nb) >= num * F.greatest(na, nb)) & (apart * (den + num) <= (na + nb) * (den - num))


def _by_wide_sketch(pairs: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b, ia, ib, n)`` (``n``: sum of sizes) that wide sketches ``wide(class, wide)`` don't rule out."""
    w = pairs.join(wide.select(F.col("class").alias("a"), F.col("wide").alias("wa")), "a", "left") \
        .join(wide.select(F.col("class").alias("b"), F.col("wide").alias("wb")), "b", "left").select("a", "b", "ia", "ib", "n", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, x, y in zip(b.column(4).to_pylist(), b.column(5), b.column(6)):
                if not x.is_valid or not y.is_valid:
                    keep.append(True)
                    continue
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                while len(x) > len(y):
                    x = _folded(x)
                while len(y) > len(x):
                    y = _folded(y)
                keep.append(int(np.bitwise_count(x ^ y).sum()) * (den + num) <= n * (den - num))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)], names=["a", "b", "ia", "ib"]).filter(pa.array(keep, pa.bool_()))

    ids = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return w.mapInArrow(run, f"a bigint, b bigint, ia {ids['ia']}, ib {ids['ib']}")


def near_by_wide(members: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """``members(key, a, root, id, n)`` without those of more than ``WIDE`` shingles that wide sketches keep from all others of their key.

    Sizes of a link differ by a factor of two at most, so sketches are equally long or one is
    folded once.
    """
    assert 2 * num >= den
    rows = _dealt(members.join(wide.select(F.col("class").alias("a"), "wide"), "a", "left")) \
        .select("key", "i", "j", "a", "root", "n", "wide").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, group in _groups_of(batches):
            a, root, n = (np.array([g[i] for g in group], np.int64) for i in range(3))
            size = np.array([len(g[3]) if g[3] else 0 for g in group])
            on = size == 0
            for length in np.unique(size[size > 0]).tolist():
                here, twice = np.flatnonzero(size == length), np.flatnonzero(size == 2 * length)
                stack = [np.stack([np.frombuffer(group[i][3], np.uint64) for i in here])]
                if len(twice):
                    stack.append(_folded(np.stack([np.frombuffer(group[i][3], np.uint64) for i in twice])))
                all_, at = np.concatenate(stack), np.concatenate([here, twice])
                for k, i in enumerate(here.tolist()):
                    other = (root[at] != root[i]) & (den * np.minimum(n[at], n[i]) >= num * np.maximum(n[at], n[i]))
                    if other.any():
                        o = np.flatnonzero(other)
                        near = o[np.bitwise_count(all_[o] ^ all_[k]).sum(axis=1, dtype=np.int64) * (den + num) <= (n[at[o]] + n[i]) * (den - num)]
                        on[at[near]] = True
                        on[i] |= len(near) > 0
            # short sets may be linked with somewhat longer ones
            least = n[size == 0].max() if (size == 0).any() else 0
            on |= num * n <= den * least
            yield pa.RecordBatch.from_arrays([pa.array(np.full(on.sum(), now[0], np.int64)), pa.array(a[on])], names=["key", "a"])

    kept = rows.mapInArrow(run, "key bigint, a bigint").distinct()
    return members.join(kept, ["key", "a"], "left_semi")


def _prefixed(reps: DataFrame, p: str) -> DataFrame:
    return reps.select(F.col("class").alias(p), F.col("rep").alias(f"i{p}"), F.col("n_shingles").alias(f"{p}_n"), *[F.col(c).alias(f"{p}_{c}") for c in _LONGS])


def _maybe(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, text)`` of the rows of ``docs`` whose id is in ``wanted(id)``, and few others, by a bitmap of fixed size over hashes of the ids."""
    place = F.shiftrightunsigned(F.xxhash64("id"), 64 - MAP_BITS)
    words = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(id), {64 - MAP_BITS}) & 63 as int))")).alias("bits"))
    bitmap = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for r in words.collect():  # one bitmap of 2 ** MAP_BITS bits
        bitmap[r["word"]] = np.uint64(r["bits"] % 2**64)

    def held(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in places:
            p = p.to_numpy()
            yield pd.Series((bitmap[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    held.__annotations__ = {"places": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where("id is not null").select("id", "text").where(F.pandas_udf(held, "boolean")(place))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, text)`` of the rows of ``docs`` whose id is in ``wanted(id)``, written once; ``_maybe`` keeps most other texts out of the shuffle."""
    wanted = materialise(wanted.distinct())
    return materialise(_maybe(docs, wanted).join(wanted, "id", "left_semi"))


def verify(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(a, b)`` of those ``pairs(a, b, ia, ib)`` of classes that link; their texts are among those of ``ia`` and ``ib`` in ``texts(id, text)``."""
    t1 = texts.select(F.col("id").alias("ia"), F.col("text").alias("ta"))
    t2 = texts.select(F.col("id").alias("ib"), F.col("text").alias("tb"))
    both = pairs.join(t1, "ia").join(t2, "ib").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, second = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):  # one text at a time
                tb = tb.as_py()
                if tb != last:
                    last, second = tb, shingle_set(tb, k)
                first = shingle_set(ta.as_py(), k)
                same = len(np.intersect1d(first, second, assume_unique=True))
                # an id may have several texts: only those of the classes count
                keep.append(same > 0 and den * same >= num * (len(first) + len(second) - same) and _class(first) == a and _class(second) == b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


# ------------------------------------------------------------------ the join
def _shared(docs: DataFrame, k: int, num: int, den: int, share: float) -> DataFrame:
    """``(key, class)``: signatures of two classes or more, without the hot ones that slack allows to leave out."""
    shared = materialise(_of_two(_keys(docs, k, num, den, share), "key", "class").select("key", "class"))
    hot = shared.groupBy("key").count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))
    rules = docs.sparkSession.createDataFrame(
        [(j, 2 if s.twos else 1, s.slack) for j, s in enumerate(schemes(num, den, share))], "scheme int, cost int, slack long")
    j = F.col("key").bitwiseAND(F.lit(127)).cast("int").alias("scheme")
    h = materialise(shared.join(hot, "key").select("key", "class", j))
    free = h.join(F.broadcast(rules), "scheme").groupBy("class", "scheme", "slack").agg(F.sum("cost").alias("spent")) \
        .where("spent <= slack").select("class", "scheme")
    return materialise(shared.join(h.join(free, ["class", "scheme"]).select("key", "class"), ["key", "class"], "left_anti"))


def _links_within(sets: list[np.ndarray], root: np.ndarray, apart: np.ndarray | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) that link and have different roots (of different blocks, if given): a spanning forest of them."""
    n = len(sets)
    size = np.array([len(u) for u in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count[col] > 1
    _, col = np.unique(col[often], return_inverse=True)
    row = row[often]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    common = np.zeros((n, n), np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        lo, hi = np.searchsorted(col, [at, at + COLUMNS])
        m = np.zeros((n, COLUMNS), np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        common += m @ m.T
    a, b = np.nonzero((den * common >= num * (size[:, None] + size - common)) & (common > 0))
    keep = (a < b) & (root[a] != root[b])
    if apart is not None:
        keep &= apart[a] != apart[b]
    a, b = a[keep], b[keep]
    tree = np.arange(n)
    while True:  # labels of the forest
        low = np.minimum(tree[a], tree[b])
        new = tree.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == tree).all():
            break
        tree = new
    on = np.nonzero(tree != np.arange(n))[0]
    return on, tree[on]


def _dealt(members: DataFrame) -> DataFrame:
    """``members`` of a key in blocks, a row for each pair ``(i, j)`` of blocks that a member's block is in."""
    size = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    v = members.join(size, "key").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    return v.withColumn("other", F.explode_outer(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def _groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, i, j) and the other columns of its rows, of batches sorted by key, i, j."""
    now, group = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in range(b.num_columns))):
            if row[:3] != now:
                if group:
                    yield now, group
                now, group = row[:3], []
            group.append(row[3:])
    if group:
        yield now, group


def _shingle_rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(shingle, a)`` of the texts of ``docs``, of the part of the universe that ``_in_part`` names, once a class and Arrow batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[int] = set()
            shingles, cls, size = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
            for t in b.column(0):
                u = shingle_set(t.as_py(), k)
                c = _class(u)
                if not len(u) or c in seen:
                    continue
                seen.add(c)
                u = u[_in_part(u, num, den)]
                shingles.append(u)
                cls.append(np.full(len(u), c))
                size += len(u)
                if size >= 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(cls))], names=["shingle", "a"])
                    shingles, cls, size = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(cls))], names=["shingle", "a"])

    return docs.select("text").mapInArrow(run, "shingle bigint, a bigint")


def _of_two(rows: DataFrame, key: str, of: str, by: str | None = None) -> DataFrame:
    """``rows(key, of, ...)`` whose key has several values of ``by`` (``of``, if not given), once each: one shuffle, no aggregate."""
    w = Window.partitionBy(key)
    v = rows.withColumn("before", F.lag(of).over(w.orderBy(of))).withColumns({"lo": F.min(by or of).over(w), "hi": F.max(by or of).over(w)})
    return v.where((F.col("lo") < F.col("hi")) & ~F.col("before").eqNullSafe(F.col(of)))


def _held(rows: DataFrame, by: str) -> DataFrame:
    """``(a, held)``: how many shingles of ``a`` in ``rows(shingle, a, ...)`` have another value of ``by`` too; a repeated row counts once."""
    return _of_two(rows, "shingle", "a", by).groupBy("a").agg(F.count(F.lit(1)).alias("held"))


def supported(some: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(a)`` of those sets of ``some(a, root, id, n, part)`` that can be linked with one of another root among them.

    A set of ``n`` shingles has at most ``n * (den - num) / den`` that a set linked with it lacks.
    Texts that share no more than a passage have more than that which no other set holds.  Most
    show it in a part of the universe (``part`` of their shingles), the others in all of it,
    where only shingles of other roots count.  A row a shingle is shuffled, none a pair.
    """
    def left(of: DataFrame, held: DataFrame, size: str) -> DataFrame:
        lacks = F.col(size) - F.coalesce("held", F.lit(0))
        return of.join(held, "a", "left").where(lacks * den <= F.col("n") * (den - num)).drop("held")

    first = _held(_shingle_rows(_maybe(docs, some.select("id").distinct()), k, num, den), "a")
    some = materialise(left(some, first, "part"))
    rows = some.select("a", "root", "id").join(texts_of(docs, some.select("id")), "id")
    return materialise(left(some, _held(_root_rows(rows, k), "root"), "n").select("a"))


def _root_rows(texts: DataFrame, k: int) -> DataFrame:
    """``(shingle, a, root)`` of all shingles of the sets of ``texts(a, root, text)``; a text of another set counts for none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, root, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                u = shingle_set(t.as_py(), k)
                if _class(u) == a:
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.full(len(u), a)), pa.array(np.full(len(u), root))], names=["shingle", "a", "root"])

    return texts.select("a", "root", "text").mapInArrow(run, "shingle bigint, a bigint, root bigint")


def near_members(members: DataFrame, num: int, den: int) -> DataFrame:
    """``(key, a, root)`` of ``members(key, a, root, n, s0, ...)`` that are near one of another root in their key by size and sketch."""
    rows = _dealt(members).select("key", "i", "j", "a", "root", "block", "n", *_LONGS).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, group in _groups_of(batches):
            v = np.array(group, np.int64)
            a, root, block, n, s = v[:, 0], v[:, 1], v[:, 2], v[:, 3], v[:, 4:].view(np.uint64)
            apart = sum(np.bitwise_count(s[:, None, c] ^ s[None, :, c]).astype(np.int64) for c in range(SKETCH))
            near = (root[:, None] != root) & (apart * (den + num) <= (n[:, None] + n) * (den - num)) \
                & (den * np.minimum(n[:, None], n) >= num * np.maximum(n[:, None], n))
            on = near.any(axis=1)
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(on.sum(), now[0], np.int64)), pa.array(a[on]), pa.array(root[on])], names=["key", "a", "root"])

    return rows.mapInArrow(run, "key bigint, a bigint, root bigint").distinct()


def verify_within(members: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges ``(a, b)`` that link different roots of a key of ``members(key, a, root, id)``; ``texts(id, text)``."""
    v = _dealt(members).select("id", "key", "i", "j", "a", "root", "block")
    rows = v.join(texts, "id").select("key", "i", "j", "a", "root", "block", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, group in _groups_of(batches):
            sets = [(a, root, block, u) for a, root, block, t in group for u in [shingle_set(t, k)] if _class(u) == a]
            if len({g[1] for g in sets}) < 2:
                continue
            a = np.array([g[0] for g in sets])
            x, y = _links_within([g[3] for g in sets], np.array([g[1] for g in sets]),
                                 np.array([g[2] for g in sets]) if now[1] != now[2] else None, num, den)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(a[x]), pa.array(a[y])], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _groups(rest: DataFrame) -> DataFrame:
    """``(key, a, root)`` to verify within, so that few texts need be sent.

    Signatures of one group of near copies have much the same members.  Roots that hang
    together by signatures are verified in one group if that sends fewer texts (members
    times blocks) than signature by signature; either way all members of a signature
    meet.  Links are between a signature's roots and the least one, not between members.
    """
    least = materialise(rest.groupBy("key").agg(F.min("root").alias("b"), F.count(F.lit(1)).alias("n")))
    whole = components(rest.join(least, "key").select(F.col("root").alias("a"), "b").distinct())
    of_key = least.join(whole.withColumnRenamed("root", "whole"), least["b"] == whole["node"]).select("key", "whole", "n")
    cost = F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK_ROWS))
    apart = of_key.groupBy("whole").agg(cost.alias("apart"))
    together = rest.select("a", "root").distinct().join(whole.withColumnRenamed("root", "whole"), F.col("root") == F.col("node")) \
        .groupBy("whole").agg(F.count(F.lit(1)).alias("n")).select("whole", (F.col("n") * F.ceil(F.col("n") / BLOCK_ROWS)).alias("together"))
    choice = materialise(of_key.join(apart, "whole").join(together, "whole")
                         .select("key", F.when(F.col("together") <= F.col("apart"), F.col("whole")).otherwise(F.col("key")).alias("group")))
    return rest.join(choice, "key").select(F.col("group").alias("key"), "a", "root").distinct()


def class_links(member: DataFrame, reps: DataFrame, wide: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(node, root)`` of the classes that are linked with another one.

    ``member(key, class)`` are the shared signatures, ``reps(class, rep, n_shingles, part, s0, ...)`` a document of every class,
    ``wide(class, wide)`` the wide sketches.
    """
    member = member.withColumnRenamed("class", "a")
    n = member.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weight = materialise(member.join(n, "key").groupBy("a").agg(F.sum("n").alias("w")))
    middle = member.join(weight, "a").groupBy("key").agg(F.max_by("a", F.struct("w", "a")).alias("b"))
    pairs = materialise(member.join(middle, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    pairs = materialise(pairs.join(_prefixed(reps, "a"), "a").join(_prefixed(reps, "b"), "b").where(_near(num, den)).select("a", "b", "ia", "ib", (F.col("a_n") + F.col("b_n")).alias("n")))
    pairs = materialise(_by_wide_sketch(pairs, wide, num, den))
    texts = texts_of(docs, pairs.select(F.col("ia").alias("id")).unionByName(pairs.select(F.col("ib").alias("id"))))
    links = materialise(verify(pairs, texts, k, num, den))
    roots = components(links)
    m = member.join(roots.withColumnsRenamed({"node": "a", "root": "r"}), "a", "left").select("key", "a", F.coalesce("r", "a").alias("root"))
    # the one in the middle has been compared with all others
    m = materialise(m.join(middle.withColumnRenamed("b", "a"), ["key", "a"], "left_anti"))
    open_keys = m.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("key", "size")
    rest = materialise(m.join(open_keys, "key"))
    of = reps.select(F.col("class").alias("a"), F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "part", *_LONGS)
    # members of small keys are compared at once, those of large ones if they can be linked at all
    few = near_members(rest.where(F.col("size") <= HOT).join(of, "a"), num, den)
    rest = materialise(few.unionByName(rest.where(F.col("size") > HOT).select("key", "a", "root")))
    some = materialise(rest.select("a", "root").distinct().join(of, "a").select("a", "root", "id", "n", "part"))
    rest = materialise(_groups(materialise(rest.join(supported(some, docs, k, num, den), "a", "left_semi"))).join(of, "a"))
    rest = materialise(near_members(rest, num, den).join(of.select("a", "id", "n"), "a"))
    if 2 * num >= den:
        rest = materialise(near_by_wide(rest, wide, num, den))
    rest = rest.drop("n")
    more = materialise(verify_within(rest, texts_of(docs, rest.select("id")), k, num, den))
    return components(links.unionByName(more))


def _labelled(d: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(id, n_shingles, digest, root, component)`` of every row of ``d(id, text)``; an id may be the least of several roots."""
    sets = materialise(_sets(d, k, num, den))
    # a class is a digest; its 64-bit number stands for it in keys and pairs
    classes = materialise(sets.where("digest is not null and id is not null").groupBy("digest", "class")
                          .agg(F.min("id").alias("rep"), *[F.max(c).alias(c) for c in ("n_shingles", "part", *_LONGS)]))
    reps = materialise(classes.groupBy("class").agg(F.min("rep").alias("rep"), *[F.max(c).alias(c) for c in ("n_shingles", "part", *_LONGS)]))
    wide = materialise(sets.where("wide is not null and id is not null").groupBy("class").agg(F.first("wide").alias("wide")))
    member = _shared(d.where("id is not null"), k, num, den, shared_share(sets))
    roots = class_links(member, reps, wide, d, k, num, den)
    labels = classes.join(roots, classes["class"] == roots["node"], "left").select("digest", "rep", F.coalesce("root", "class").alias("root"))
    least = labels.groupBy("root").agg(F.min("rep").alias("component"))
    of = labels.join(least, "root").select("digest", "component", "root")
    return sets.join(of, "digest", "left").select("id", "n_shingles", "digest", "root", F.coalesce("component", "id").alias("component"))


def join_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(id_col, n_shingles, component_id)``, the smallest id reachable by links."""
    out = _labelled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), k, num, den)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) of one document of each component, the one with the smallest id.

    Rows without an id stay.  A document is an id and a set: of several rows with one id those
    with texts of their own stay, one row each; of near copies with one id the one with the
    least digest stays, of rows without words one.
    """
    rows = materialise(_labelled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), k, num, den).where("id is not null"))
    node, mark = free_name(docs, "dropped"), free_name(docs, "set_digest")
    twice = materialise(rows.groupBy("id").count().where("count > 1").select(F.col("id").alias(node)))
    gone = rows.where("id <> component").select(F.col("id").alias(node)).join(twice, node, "left_anti")
    out = docs.join(materialise(gone), docs[id_col] == F.col(node), "left_anti")
    if not twice.limit(1).count():
        return out

    # ids that are given twice: one row of each set that is the first of its component
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([xxhash.xxh3_128_digest(u.tobytes()) if len(u) else None for u in (shingle_set(t, k) for t in s)], dtype=object)

    digests.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    first = rows.join(twice, rows["id"] == twice[node], "left_semi").where("id = component") \
        .groupBy("root", F.when(F.col("root").isNull(), F.col("id")).alias("bare")).agg(F.min("id").alias("keep"), F.min("digest").alias("d"))
    first = materialise(first.select(F.col("keep").alias(node), F.coalesce("d", F.lit(b"")).alias("d")))
    some = docs.join(twice, docs[id_col] == twice[node], "left_semi") \
        .withColumn(mark, F.coalesce(F.pandas_udf(digests, "binary")(F.col(text_col)), F.lit(b"")))
    some = some.dropDuplicates([id_col, mark])
    return out.join(twice, out[id_col] == twice[node], "left_anti") \
        .unionByName(some.join(first, (some[id_col] == first[node]) & (some[mark] == first["d"]), "left_semi").drop(mark))


def oracle(k: int = 3, num: int = 90, den: int = 100) -> str:
    blanks = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{blanks}') AS w
                     FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i + 1, i + least(len(w), {k})) AS g
      FROM (SELECT doc_id, w, unnest(range(0, len(w) - least(len(w), {k}) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY ALL
"""
