"""Embedding near-duplicates by lattice hashing (operator 6).

``TABLES`` tables each take ``BLOCKS`` random orthonormal projections to eight
dimensions and decode them to the nearest point of the E8 lattice; the points
of a table make up the vector's home cell.  A vector also visits the
``PROBES`` neighbouring cells it is nearest to in each table (one point moved by
one of the 240 shortest lattice vectors).  Vectors meet where one is at home and
the other is at home or visits, and every meeting is verified by the cosine in
double precision.

A pair that meets several times is counted only at its first meeting, which both
rows of hashed cells show, so no pairs are written: a cell gives a count of links
per vector and an edge to the smallest vector it reaches there.  Equal vectors
are one class with a weight.  Cells of more than ``BLOCK_ROWS`` rows are cut into
blocks, each pair of blocks a group of its own, so a dense cell spreads over
many tasks and no task holds more than two blocks.

The hash may miss pairs near the threshold (the tests hold recall at 0.99 and more
for pairs of cosine 0.97, 0.95 at the threshold itself); it never adds any.

Cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and are their own component; vectors of different lengths never
link; repeated ids are vectors of their own with one component; an empty table
gives an empty one; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import components, materialise

TABLES = 10
BLOCKS = 3
PROBES = 3
CELL = 0.36  # scale of the lattice, for 64 dimensions
BLOCK_ROWS = 1024
SEED = 20240501
_MUL = np.uint64(0x9E3779B97F4A7C15)


@cache
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((-1.0, 1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    f = np.rint(x)
    odd = np.nonzero(f.sum(-1) % 2)[0]
    d = x[odd] - f[odd]
    worst = np.abs(d).argmax(-1)
    step = np.where(d[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    f[odd, worst] += step
    return f


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of every row of eight."""
    a, b = decode_d8(x), decode_d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1)
    return np.where(near[:, None], a, b)


@cache
def projections(dim: int) -> np.ndarray:
    """``(dim, TABLES * BLOCKS * 8)``: columns of random rotations, scaled to lattice units."""
    rng = np.random.default_rng(SEED + dim)
    need, parts = TABLES * BLOCKS * 8, []
    while sum(p.shape[1] for p in parts) < need:
        q, r = np.linalg.qr(rng.standard_normal((max(dim, 8), max(dim, 8))))
        parts.append((q * np.sign(np.diag(r)))[:dim])
    return np.concatenate(parts, 1)[:, :need] * (np.sqrt(dim) / 8 / CELL)


def _hash(points: np.ndarray, table: int) -> np.ndarray:
    """One number for the BLOCKS points of a table, ``(n, BLOCKS * 8)`` in half units."""
    p = (2 * points).astype(np.int64).view(np.uint64)
    h = np.full(len(p), np.uint64(table + 1))
    for j in range(p.shape[1]):
        h = (h ^ p[:, j]) * _MUL
        h ^= h >> np.uint64(29)
    return h


def cells(unit: np.ndarray) -> np.ndarray:
    """``(n, TABLES, 1 + PROBES)`` cell numbers of unit vectors: the home cell, then those visited."""
    n, dim = unit.shape
    x = (unit @ projections(dim)).reshape(n, TABLES, BLOCKS, 8)
    out = np.empty((n, TABLES, 1 + PROBES), np.uint64)
    short = shortest()
    for t in range(TABLES):
        point = decode_e8(x[:, t].reshape(-1, 8)).reshape(n, BLOCKS, 8)
        out[:, t, 0] = _hash(point.reshape(n, -1), t)
        # the gain of moving a block's point by v grows with the residual's product with v
        gain = np.einsum("nbi,vi->nbv", x[:, t] - point, short).reshape(n, -1)
        best = np.argpartition(-gain, PROBES - 1, axis=1)[:, :PROBES]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(gain, best, 1), axis=1, kind="stable"), 1)
        for k in range(PROBES):
            moved = point.copy()
            b, v = np.divmod(best[:, k], len(short))
            moved[np.arange(n), b] += short[v]
            out[:, t, 1 + k] = _hash(moved.reshape(n, -1), t)
    return out


def _vectors(batch_column) -> list[np.ndarray | None]:
    out = []
    for v in batch_column:
        x = v.as_py()
        a = None if not x or any(y is None for y in x) else np.array(x, np.float64)
        out.append(a if a is not None and np.isfinite(a).all() and a.any() else None)
    return out


def hashed(vecs: DataFrame) -> DataFrame:
    """``(id, digest, vec, keys)``: valid vectors as doubles, their cells as 32-bit numbers; nulls otherwise."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                vs = _vectors(b.column(1))
                keys: list = [None] * len(vs)
                by: dict[int, list[int]] = {}
                for i, v in enumerate(vs):
                    if v is not None:
                        by.setdefault(len(v), []).append(i)
                for where in by.values():
                    m = np.array([vs[i] / np.abs(vs[i]).max() for i in where])
                    c = cells(m / np.linalg.norm(m, axis=1)[:, None]) ^ np.uint64(len(m[0]))
                    for i, row in zip(where, c):
                        keys[i] = row.tobytes()
                raw = [None if v is None else v.tobytes() for v in vs]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([None if r is None else xxhash.xxh3_128_digest(r) for r in raw], pa.binary()),
                     pa.array(raw, pa.binary()), pa.array(keys, pa.binary())], names=["id", "digest", "vec", "keys"])

    return vecs.mapInArrow(run, "id bigint, digest binary, vec binary, keys binary")


def _visits(classes: DataFrame) -> DataFrame:
    """``(cell, id, home)`` light rows of all home and visited cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = TABLES * (1 + PROBES)
        for b in batches:
            if b.num_rows:
                c = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
                home = np.tile(np.arange(1 + PROBES) == 0, TABLES * b.num_rows)
                ids = np.repeat(b.column(0).to_numpy(), per)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(ids), pa.array(home)], names=["cell", "id", "home"])

    return classes.select("id", "keys").mapInArrow(run, "cell bigint, id bigint, home boolean")


def _meet(rows: dict[str, np.ndarray], least_cos: float) -> tuple[np.ndarray, ...] | None:
    """Links of one group that are counted here: arrays of the ends' places."""
    home, block, ids = rows["home"], rows["block"], rows["id"]
    if not home.any() or len(ids) < 2:
        return None
    dims = {len(v) for v in rows["vec"]}
    if len(dims) > 1:  # cells of different lengths differ but for hash collisions
        return None
    v = np.frombuffer(b"".join(rows["vec"]), np.float64).reshape(len(ids), -1)
    norm = np.sqrt((v * v).sum(1))
    at_home = np.nonzero(home)[0]
    cos = (v[at_home] @ v.T) / (norm[at_home][:, None] * norm)
    a, b = np.nonzero(cos >= least_cos)
    a = at_home[a]
    # each pair once; of two at home the smaller place; in a group of two blocks only across them
    ok = (a < b) | ~home[b]
    if rows["two"]:
        ok &= block[a] != block[b]
    ok &= ids[a] != ids[b]
    a, b = a[ok], b[ok]
    if not len(a):
        return None
    keys = np.frombuffer(b"".join(rows["keys"]), np.uint64).reshape(len(ids), TABLES, 1 + PROBES)
    small, large = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
    keep = np.zeros(len(a), bool)
    for k in range(0, len(a), 50_000):
        s, g = keys[small[k:k + 50_000]], keys[large[k:k + 50_000]]
        # kinds of meeting in a table: both at home, the larger visits, the smaller visits
        kinds = np.stack([s[:, :, 0] == g[:, :, 0], (s[:, :, :1] == g[:, :, 1:]).any(2), (g[:, :, :1] == s[:, :, 1:]).any(2)], 2)
        first = kinds.reshape(len(s), -1).argmax(1)
        table, kind = np.divmod(first, 3)
        host = np.where(kind == 2, g[np.arange(len(s)), table, 0], s[np.arange(len(s)), table, 0])
        both = home[a[k:k + 50_000]] & home[b[k:k + 50_000]]
        host_is_large = large[k:k + 50_000] == a[k:k + 50_000]  # the end at home
        here = np.where(both, 0, np.where(host_is_large, 2, 1))
        keep[k:k + 50_000] = (host == rows["cell"]) & (kind == here)
    return (a[keep], b[keep]) if keep.any() else None


def _group(rows: dict[str, np.ndarray], least_cos: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(ids, links counted, smallest id reached) of one group."""
    got = _meet(rows, least_cos)
    if got is None:
        return None
    a, b = got
    ids, w, n = rows["id"], rows["weight"], len(rows["id"])
    count = np.bincount(a, w[b], n) + np.bincount(b, w[a], n)
    root = ids.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            break
        root = new
    on = np.nonzero(count)[0]
    return ids[on], count[on].astype(np.int64), root[on]


def near_duplicates(vecs: DataFrame, least_cos: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vecs``: ``(id_col, n_links, component_id, kept)``."""
    h = materialise(hashed(vecs.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))))
    good = h.where("digest is not null and id is not null")
    classes = good.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    body = materialise(good.join(classes.select("digest", "id", "weight"), ["digest", "id"]).dropDuplicates(["digest"]))
    visits = _visits(body)
    size = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home") \
        .select("cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    v = visits.join(size, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a block meets itself and every other block
    v = v.withColumn("other", F.explode_outer(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("id", "cell", "home", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = v.join(body.select("id", "weight", "vec", "keys"), "id").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    names = ["cell", "i", "j", "id", "home", "block", "weight", "vec", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = ["id", "n", "root"]
        held: list[pa.RecordBatch] = []

        def groups(t: pa.Table, last: bool):
            """Finished groups of the sorted rows, and the rows of the one that may go on."""
            c = [t.column(x).to_numpy() for x in ("cell", "i", "j")]
            new = np.concatenate([[True], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])])
            cut = np.append(np.nonzero(new)[0], len(new))
            out, end = [], len(cut) - 1 if last else len(cut) - 2
            for s, e in zip(cut[:end], cut[1:end + 1]):
                if e - s > 1:
                    g = t.slice(s, e - s)
                    got = _group({"cell": c[0][s].view(np.uint64), "two": bool(c[1][s] != c[2][s]), "id": g.column("id").to_numpy(),
                                  "home": g.column("home").to_numpy(zero_copy_only=False), "block": g.column("block").to_numpy(),
                                  "weight": g.column("weight").to_numpy(), "vec": g.column("vec").to_pylist(),
                                  "keys": g.column("keys").to_pylist()}, least_cos)
                    if got:
                        out.append(got)
            return out, t.slice(cut[end])

        def batch(out) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(3)], names=schema)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            first, last_row = held[0], b.num_rows - 1
            if all(first.column(k)[0] == b.column(k)[last_row] for k in range(3)):
                continue  # still the group that is held
            out, rest = groups(pa.Table.from_batches(held), False)
            held = rest.to_batches()
            if out:
                yield batch(out)
        if held:
            out, _ = groups(pa.Table.from_batches(held), True)
            if out:
                yield batch(out)

    found = materialise(rows.select(*names).mapInArrow(run, "id bigint, n bigint, root bigint"))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of = classes.join(links, "id", "left").join(roots, classes["id"] == roots["node"], "left") \
        .select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = h.select("id", "digest").join(of, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
