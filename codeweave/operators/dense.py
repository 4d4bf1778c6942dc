"""Graphs whose nodes fit the driver: labels of all nodes are broadcast, arcs stay distributed in packed blocks.

A node is its place among the graph's ids, so labels, cluster weights and sizes are plain arrays
of at most ``DENSE_NODES`` entries (about 100 bytes a node on the driver, 20 in a task's process).  A pass reads the blocks where they lie, sums
arcs with numpy and gives at most a row a node; nothing is shuffled.  Larger graphs,
and nodes of more arcs than a block holds, go by ``communities.Blocks``, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.session import cut_lineage

DENSE_NODES = 10_000_000
BLOCK_ARCS = 500_000  # about, of a block
_PACKED = "nodes binary, counts binary, k binary, dst binary, w binary, ways binary, n_arcs long, sum_w double"
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxhash64(ids: np.ndarray, number: int) -> np.ndarray:
    """``F.xxhash64(ids, F.lit(number))`` of longs and an int."""
    with np.errstate(over="ignore"):
        h = (np.uint64(42) + _P5 + np.uint64(8)) ^ (_rotl(ids.astype(np.int64).view(np.uint64) * _P2, 31) * _P1)
        h = _mixed(_rotl(h, 27) * _P1 + _P4)
        h = (h + _P5 + np.uint64(4)) ^ (np.uint64(number) * _P1)
        return _mixed(_rotl(h, 23) * _P2 + _P3).view(np.int64)


@dataclass(frozen=True)
class Dense:
    """Arcs both ways between nodes ``0 .. len(ids) - 1``, ``ids`` ascending; ``k`` are the nodes' strengths, ``degree`` their arcs."""

    ids: np.ndarray
    k: np.ndarray
    degree: np.ndarray | None
    packed: DataFrame
    n_arcs: int
    sum_w: float

    def sums(self, shared: dict[str, np.ndarray], pick: Callable, schema: str, value: str = "w") -> DataFrame:
        """What ``pick(nodes, k, src, start, dst, w, shared)`` gives of every block.

        ``src`` are places in ``nodes``, ascending, ``start`` the first arc of each; ``dst`` are nodes.
        ``value`` may ask for the ``ways`` of arcs instead of their weights.
        """
        told = self.packed.sparkSession.sparkContext.broadcast(shared)

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    nodes, counts, dst = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in ("nodes", "counts", "dst"))
                    k, w = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("k", np.float64), (value, np.int8 if value == "ways" else np.float64)))
                    start = np.cumsum(counts, dtype=np.int64) - counts
                    yield from pick(nodes, k, np.repeat(np.arange(len(nodes)), counts), start, dst, w, told.value).to_batches()

        return self.packed.select("nodes", "counts", "k", "dst", value).mapInArrow(one, schema)

    def collected(self, shared: dict[str, np.ndarray], pick: Callable, schema: str, value: str = "w") -> dict[str, np.ndarray]:
        t = self.sums(shared, pick, schema, value).toArrow()
        return {c: t.column(c).to_numpy() for c in t.column_names}


@contextmanager
def _whole_batches(spark: SparkSession) -> Iterator[None]:
    """Without a look at a batch's bytes for every row sent to Python, four times the work of sending it; for rows of a few numbers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(2 ** 31 - 1))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def both_ways(a: str, b: str) -> Column:
    way = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    return F.array(way(a, b), way(b, a))


def _packed(rows: DataFrame, total: int, place: Callable, strength: np.ndarray | None) -> DataFrame:
    """``rows(src, dst, w[, way])`` of a table, ``total`` at most, as blocks; weights of equal ends are added.

    ``way`` is 1 or 2 by the direction of the edge, and ``ways`` of an arc 2 where edges go both ways; the arcs between clusters have none.
    """
    known = None if strength is None else rows.sparkSession.sparkContext.broadcast(strength)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        src, dst, w = (t.column(c).to_numpy() for c in ("src", "dst", "w"))
        src, dst = place(src), place(dst)
        key = (src << 32) | dst
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        w = np.add.reduceat(w[order], first)
        src, dst = key[first] >> 32, key[first] & 0xFFFFFFFF
        start = np.flatnonzero(np.diff(src, prepend=-1))
        nodes, counts = src[start], np.diff(start, append=len(src))
        k = np.add.reduceat(w, start) if known is None else known.value[nodes]
        ways = None
        if "way" in t.column_names:
            way = np.bitwise_or.reduceat(t.column("way").to_numpy()[order], first)
            ways = ((way & 1) + (way >> 1)).astype(np.int8).tobytes()
        yield pa.RecordBatch.from_pylist([{
            "nodes": nodes.astype(np.int32).tobytes(), "counts": counts.astype(np.int32).tobytes(), "k": k.tobytes(),
            "dst": dst.astype(np.int32).tobytes(), "w": w.tobytes(), "ways": ways, "n_arcs": len(dst), "sum_w": float(w.sum())}], schema=pa.schema(
            [*[(c, pa.binary()) for c in ("nodes", "counts", "k", "dst", "w", "ways")], ("n_arcs", pa.int64()), ("sum_w", pa.float64())]))

    with _whole_batches(rows.sparkSession):
        return cut_lineage(rows.repartition(total // BLOCK_ARCS + 1, "src").mapInArrow(pack, _PACKED))


def _totals(packed: DataFrame) -> tuple[int, float]:
    n, w = packed.agg(F.sum("n_arcs"), F.sum("sum_w")).first()
    return n or 0, w or 0.0


def dense(ends: DataFrame, names: DataFrame, hub_arcs: int) -> Dense | None:
    """The graph of ``ends(s, t, w)``, each the ``nid`` of ``names``; None if it has too many nodes or hubs.

    A ``nid`` is a partition and a row in it, so its place follows from the rows of the partitions before it.
    """
    parts = names.groupBy(F.shiftright("nid", 33).alias("part")).count().toArrow()   # a row a partition
    rows = dict(zip(parts.column("part").to_pylist(), parts.column("count").to_pylist()))
    n = sum(rows.values())
    if n > DENSE_NODES:
        return None
    arcs = ends.select(F.explode(both_ways("s", "t")).alias("x"), "w", F.when(F.col("s") < F.col("t"), 1).otherwise(2).alias("way")).select("x.src", "x.dst", "w", "way")
    if n > hub_arcs and not arcs.groupBy("src").count().where(F.col("count") > hub_arcs).isEmpty():
        return None
    base = np.zeros(max(rows, default=0) + 2, np.int64)
    for part, size in rows.items():
        base[part + 1] = size
    base = np.cumsum(base)
    ids = np.concatenate([np.zeros(0, np.int64), *[(part << 33) + np.arange(rows[part]) for part in sorted(rows)]])
    packed = _packed(arcs, 2 * ends.count(), lambda x: base[x >> 33] + (x & ((1 << 33) - 1)), None)
    k, degree = np.zeros(n), np.zeros(n, np.int32)
    t = Dense(ids, k, None, packed, 0, 0.0).collected(
        {}, lambda nodes, k, src, *rest: pa.table({"node": nodes, "k": k, "degree": np.bincount(src, minlength=len(nodes))}), "node int, k double, degree long")
    k[t["node"]], degree[t["node"]] = t["k"], t["degree"]
    return Dense(ids, k, degree, packed, *_totals(packed))


def by_label(src: np.ndarray, lab: np.ndarray, w: np.ndarray, n_labels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sources and labels that occur together, ascending, and the weight of their arcs."""
    key = src * n_labels + lab
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // n_labels, key[first] % n_labels, np.add.reduceat(w[order], first) if len(first) else w[:0]


def _ranks(group: np.ndarray) -> np.ndarray:
    """Places within runs of equal values, from 0."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group)))


def looks(g: Dense, c: np.ndarray, turn: np.ndarray, m2: float, cap: int | None) -> tuple[float, dict[str, np.ndarray]]:
    """The weight inside clusters, and ``node, better, to`` of the class's nodes that gain by moving."""
    n = len(g.ids)
    shared = {"c": c, "big": np.bincount(c, g.k, n), "turn": turn}
    if cap is not None:
        shared["size"] = np.bincount(c, minlength=n).astype(np.int32)

    def pick(nodes, k, src, start, dst, w, t):
        lab, mine = t["c"][dst], t["c"][nodes]
        inside = float(w[lab == mine[src]].sum())
        on = t["turn"][nodes][src]
        at, d, near = by_label(src[on], lab[on].astype(np.int64), w[on], len(t["c"]))
        same = d == mine[at]
        stay = np.zeros(len(nodes))
        stay[at[same]] = near[same]
        gain = near - k[at] * t["big"][d] / m2
        fits = ~same if cap is None else ~same & (1 + t["size"][d] <= cap)
        at, d, gain = at[fits], d[fits], gain[fits]
        # the best gain of a node, of equal ones that of the smallest cluster
        first = np.flatnonzero(np.diff(at, prepend=-1))
        most = np.maximum.reduceat(gain, first) if len(first) else gain
        top = np.flatnonzero(gain == np.repeat(most, np.diff(first, append=len(at))))
        one = top[np.flatnonzero(np.diff(at[top], prepend=-1))]
        at, d, gain = at[one], d[one], gain[one]
        better = gain - (stay[at] - k[at] * (t["big"][mine[at]] - k[at]) / m2)
        go = better > 1e-9
        return pa.table({"node": np.append(nodes[at[go]], np.int32(-1)), "better": np.append(better[go], inside), "to": np.append(d[go], 0).astype(np.int32)})

    t = g.collected(shared, pick, "node int, better double, to int")
    move = t["node"] >= 0
    return float(t["better"][~move].sum()), {x: y[move] for x, y in t.items()}


def admitted(moves: dict[str, np.ndarray], c: np.ndarray, cap: int) -> dict[str, np.ndarray]:
    """Moves into clusters while they have room, the best first."""
    order = np.lexsort((moves["node"], -moves["better"], moves["to"]))
    to = moves["to"][order]
    kept = order[_ranks(to) < cap - np.bincount(c, minlength=len(c))[to]]
    return {x: y[kept] for x, y in moves.items()}


def hanging(g: Dense, of: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Clusters split into what hangs together, as the smallest node; a pass hooks roots to the smallest root next to them.

    ``label`` are smallest nodes of what is together from the start.
    """
    label = np.arange(len(of), dtype=np.int32) if label is None else label.copy()

    def pick(nodes, k, src, start, dst, w, t):
        near = np.where(t["of"][dst] == t["of"][nodes][src], t["label"][dst], np.iinfo(np.int32).max)
        low = np.minimum.reduceat(near, start) if len(start) else near
        less = low < t["label"][nodes]
        return pa.table({"node": nodes[less], "low": low[less]})

    while True:
        t = g.collected({"of": of, "label": label}, pick, "node int, low int")
        if not len(t["node"]):
            return label
        np.minimum.at(label, label[t["node"]], t["low"])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def beside_hubs(g: Dense, of: np.ndarray, max_size: int) -> np.ndarray:
    """``of`` with lone nodes put together by their heaviest neighbour, ``max_size`` at most."""
    lone = (np.bincount(of, minlength=len(of)) == 1)[of]

    def pick(nodes, k, src, start, dst, w, t):
        most = np.maximum.reduceat(w, start) if len(start) else w
        hub = np.minimum.reduceat(np.where(w == most[src], dst, np.iinfo(np.int32).max), start) if len(start) else dst
        alone = t["lone"][nodes]
        return pa.table({"node": nodes[alone], "hub": hub[alone]})

    t = g.collected({"lone": lone}, pick, "node int, hub int")
    order = np.lexsort((t["node"], t["hub"]))
    node, rank = t["node"][order], _ranks(t["hub"][order])
    lead = np.flatnonzero(rank % max_size == 0)
    out = of.copy()
    out[node] = np.repeat(node[lead], np.diff(lead, append=len(node)))
    return out


def contracted(g: Dense, of: np.ndarray) -> tuple[Dense, np.ndarray]:
    """Clusters as nodes, with the arcs between them, and the new node of every old one."""
    labels, place = np.unique(of, return_inverse=True)
    place = place.astype(np.int32)

    def pick(nodes, k, src, start, dst, w, t):
        a, b = t["place"][nodes][src], t["place"][dst]
        out = a != b
        key = (a[out].astype(np.int64) << 32) | b[out]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return pa.table({"src": key[first] >> 32, "dst": key[first] & 0xFFFFFFFF, "w": np.add.reduceat(w[out][order], first) if len(first) else w[:0]})

    k = np.bincount(place, g.k, len(labels))
    between = cut_lineage(g.sums({"place": place}, pick, "src long, dst long, w double"))
    packed = _packed(between, g.n_arcs, lambda x: x, k)
    return Dense(g.ids[labels], k, None, packed, *_totals(packed)), place


def best_labels(g: Dense, h: np.ndarray, rounds: int) -> np.ndarray:
    """Labels by propagation, one half of the nodes a round; of equal votes the label with the largest ``h`` wins."""
    label = np.arange(len(g.ids), dtype=np.int32)

    def pick(nodes, k, src, start, dst, w, t):
        on = t["turn"][nodes][src]
        at, d, near = by_label(src[on], t["label"][dst[on]].astype(np.int64), w[on], len(t["label"]))
        best = np.lexsort((t["h"][d], near, at))
        last = best[np.flatnonzero(np.diff(at[best], append=len(nodes)))]
        return pa.table({"node": nodes[at[last]], "to": d[last].astype(np.int32)})

    for r in range(rounds):
        t = g.collected({"label": label, "h": h, "turn": h % 2 == r % 2}, pick, "node int, to int")
        label = label.copy()
        label[t["node"]] = t["to"]
    return label


def modularity(g: Dense, part: np.ndarray) -> float:
    """Weighted modularity of a partition; arcs of nodes without a part (-1) are left out of its sums."""

    def pick(nodes, k, src, start, dst, w, t):
        a, b = t["part"][nodes], t["part"][dst]
        own = (a[src] >= 0) & (b >= 0)
        inside = own & (a[src] == b)
        return pa.table({"part": a, "k": np.bincount(src, w * own, len(nodes)), "inside": np.bincount(src, w * inside, len(nodes))}) \
            .filter(pa.array(a >= 0))

    t = g.collected({"part": part}, pick, "part int, k double, inside double")
    m2 = g.sum_w or 1.0
    k, inside = (np.bincount(t["part"], t[x]) for x in ("k", "inside"))
    return float((inside / m2 - k * k / m2 ** 2).sum())


def levels(paths: list[np.ndarray], max_size: int) -> list[dict[str, np.ndarray]]:
    """``level`` (-1: left out), ``least`` node of the community and of the one ``above``, for each of ``paths`` from the top down.

    Nested clusters of one size are one; pieces of a small enough community aren't wanted.
    """
    out, before, level, above = [], None, None, None
    for path in paths:
        n = len(path)
        least = np.zeros(n, np.int32)
        least[path[::-1]] = np.arange(n - 1, -1, -1, dtype=np.int32)
        least, size = least[path], np.bincount(path, minlength=n)[path].astype(np.int32)
        kept = np.ones(n, bool) if before is None else (size < before) & (before > max_size)
        level = np.zeros(n, np.int8) if level is None else level + kept.astype(np.int8)
        up = np.full(n, -1, np.int32) if above is None else above
        out.append({"level": np.where(kept, level, -1).astype(np.int8), "least": least, "above": up})
        above = np.where(kept, least, up)
        before = size
    return out


def _place_maps(ids: np.ndarray) -> tuple[Callable, Callable]:
    """From ``nid`` to place and back; they run on within a partition of the names."""
    starts = np.flatnonzero(np.diff(ids >> 33, prepend=-1))
    first = ids[starts]

    def places(nid: np.ndarray) -> np.ndarray:
        part = np.searchsorted(first, nid, "right") - 1
        return starts[part] + nid - first[part]

    def nids(place: np.ndarray) -> np.ndarray:
        part = np.searchsorted(starts, place, "right") - 1
        return first[part] + place - starts[part]

    return places, nids


def rows_of(g: Dense, names: DataFrame, told: list[dict[str, np.ndarray]]) -> DataFrame:
    """``(node, level, least, above)`` by name and ``nid``, a row a node and kept level."""
    places, nids = _place_maps(g.ids)
    out = None
    for t in told:
        shared = names.sparkSession.sparkContext.broadcast(t)

        def one(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            t = shared.value
            for batch in batches:
                ids = batch.column("nid").to_numpy()
                at = places(ids)
                kept = t["level"][at] >= 0
                at = at[kept]
                least, above = t["least"][at], t["above"][at]
                yield pa.RecordBatch.from_arrays([
                    batch.column("node").filter(pa.array(kept)), pa.array(t["level"][at].astype(np.int32)), pa.array(nids(least)),
                    pa.array(nids(np.maximum(above, 0)), mask=above < 0)], names=["node", "level", "least", "above"])

        rows = names.select("node", "nid").mapInArrow(one, "node string, level int, least long, above long")
        out = rows if out is None else out.unionByName(rows)
    return out


def apart(g: Dense, cids: list[np.ndarray], leaf: np.ndarray) -> int:
    """Communities that don't hang together, their leaves taken as units; ``cids`` are nested levels (-1: none), from the top."""
    n, out = len(leaf), 0
    first = np.zeros(max(n, int(leaf.max(initial=0)) + 1), np.int32)
    first[leaf[::-1]] = np.arange(n - 1, -1, -1, dtype=np.int32)
    label = first[leaf]
    for cid in reversed(cids):   # what hangs together below does so above
        label = hanging(g, np.where(cid >= 0, cid, leaf + np.int32(cid.max(initial=-1) + 1)), label)   # others are leaves for themselves
        on = np.flatnonzero(cid >= 0)
        some = np.zeros(int(cid.max(initial=0)) + 1, np.int32)
        some[cid[on]] = label[on]
        out += len(np.unique(cid[on][label[on] != some[cid[on]]]))
    return out


def loose(g: Dense, leaf: np.ndarray) -> int:
    """Leaves that neither hang together nor are neighbours of one node."""
    size = np.bincount(leaf)
    label = hanging(g, leaf)
    some = np.zeros(len(size), np.int32)
    some[leaf] = label
    split = np.zeros(len(size), bool)
    split[leaf[label != some[leaf]]] = True

    def pick(nodes, k, src, start, dst, w, t):
        at = t["leaf"][dst]
        on = t["split"][at]
        key, n = np.unique((src[on].astype(np.int64) << 32) | at[on], return_counts=True)
        all_of = key & 0xFFFFFFFF
        return pa.table({"leaf": np.unique(all_of[n == t["size"][all_of]])})

    t = g.collected({"leaf": leaf, "split": split, "size": size.astype(np.int32)}, pick, "leaf long")
    split[t["leaf"]] = False
    return int(split.sum())


def inner_ways(g: Dense, cid: np.ndarray) -> np.ndarray:
    """For every node the directed edges between it and others of its community."""

    def pick(nodes, k, src, start, dst, ways, t):
        own = t["cid"][nodes]
        n = np.bincount(src, ways * ((own[src] == t["cid"][dst]) & (own[src] >= 0)), len(nodes))
        return pa.table({"node": nodes[n > 0], "n": n[n > 0]})

    out = np.zeros(len(cid))
    t = g.collected({"cid": cid}, pick, "node int, n double", "ways")
    out[t["node"]] = t["n"]
    return out


def report_numbers(g: Dense, cids: list[np.ndarray], hashes: list[np.ndarray], looped: np.ndarray, communities: DataFrame) -> DataFrame:
    """``communities(level, community, size)`` with ``h``, the edges inside and the strength (``rank``) of each."""
    told = {}
    for level, (cid, h) in enumerate(zip(cids, hashes)):
        on = cid >= 0
        ways = inner_ways(g, cid)[on] / 2 + looped[on]   # an edge between two nodes is seen from both
        told[level] = (h, np.bincount(cid[on], ways, len(h)).astype(np.int64), np.bincount(cid[on], g.k[on], len(h)))
    shared = communities.sparkSession.sparkContext.broadcast(told)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level, h = (batch.column(c).to_numpy() for c in ("level", "h"))
            n_edges, rank = np.zeros(len(h), np.int64), np.zeros(len(h))
            for x in np.unique(level):
                found, n, k = shared.value[int(x)]
                here = level == x
                at = np.searchsorted(found, h[here])
                n_edges[here], rank[here] = n[at], k[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_edges), pa.array(rank)], names=[*batch.schema.names, "n_edges", "rank"])

    rows = communities.select("level", "community", "size", F.xxhash64("level", "community").alias("h"))
    return rows.mapInArrow(one, f"level {dict(rows.dtypes)['level']}, community string, size long, h long, n_edges long, rank double")


def top_members(g: Dense, names: DataFrame, cids: list[np.ndarray], hashes: list[np.ndarray], top_k: int) -> DataFrame:
    """``(level, h, place, node, degree)`` of the ``top_k`` members of most arcs of every community, by name where they are equal."""
    places, _ = _place_maps(g.ids)
    out = None
    for level, (cid, h) in enumerate(zip(cids, hashes)):
        on = np.flatnonzero(cid >= 0)
        most = int(g.degree.max(initial=0))
        order = on[np.argsort(cid[on].astype(np.int64) * (most + 1) + most - g.degree[on], kind="stable")]
        place = np.zeros(len(cid), np.int32)
        place[order] = _ranks(cid[order]) + 1
        shared = names.sparkSession.sparkContext.broadcast((cid, place, h, g.degree))

        def one(batches: Iterator[pa.RecordBatch], shared=shared, level=level) -> Iterator[pa.RecordBatch]:
            cid, place, h, degree = shared.value
            for batch in batches:
                ids = batch.column("nid").to_numpy()
                at = places(ids)
                kept = (place[at] > 0) & (place[at] <= top_k)
                at = at[kept]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), level, np.int32)), pa.array(h[cid[at]]), pa.array(place[at]),
                    batch.column("node").filter(pa.array(kept)), pa.array(degree[at].astype(np.int64))], names=["level", "h", "place", "node", "degree"])

        rows = names.select("node", "nid").mapInArrow(one, "level int, h long, place int, node string, degree long")
        out = rows if out is None else out.unionByName(rows)
    return out
