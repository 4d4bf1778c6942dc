"""Graph operators over an edge DataFrame ``(source, target[, weight])``.

All loops keep the data distributed: each round is a join + aggregate over
DataFrames, and the driver only reads one change count per round.  Loops are
*semi-naive*: only rows that changed last round are propagated, so late rounds
touch a shrinking frontier instead of the whole graph.  Loop state is written
each round as a parquet table under ``spark.checkpoint.dir`` and read back
(never ``localCheckpoint``): that bounds both lineage and the logical plan
(state derived from state would otherwise grow the plan tree every round),
and an executor loss replays at most one round.

Skew: a hub node with a huge in- or out-degree is handled by partial
aggregation (``min`` / ``count`` combine map-side before the shuffle) and by
AQE's skew-join splitting, because the side joined against is always one row
per node.  A frontier is broadcast only when its counted size is below
``BROADCAST_ROWS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.session import cut_lineage

BROADCAST_ROWS = 200_000
ROWS_A_TASK = 2_000_000  # edges that a task sorts to join them with the names
NAMES_A_TASK = 1_000_000  # names that a task keeps in a hash table


def _maybe_broadcast(df: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def _persist(df: DataFrame) -> DataFrame:
    """Loop state is always materialised as a table: bounded plan, bounded lineage."""
    return cut_lineage(df)


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct directed (src, dst) pairs, null endpoints dropped."""
    return (edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
            .where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct())


def nodes_of(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()


def join_spread(rows: DataFrame, names: DataFrame, on: str, n_rows: int) -> DataFrame:
    """``rows`` joined with ``names``; as many rows need more than the usual number of tasks, about ``ROWS_A_TASK`` in one."""
    tasks = n_rows // ROWS_A_TASK + 1
    if tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows.join(names, on)
    return rows.repartition(tasks, on).join(names.repartition(tasks, on), on)


def join_hashed(rows: DataFrame, names: DataFrame, on: str, n_names: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``n_names`` names, without a sort of the rows while a task's share of the names is small enough to hash."""
    small = n_names <= NAMES_A_TASK * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(names.hint("shuffle_hash") if small else names, on, how)


def encode_nodes(edges: DataFrame):
    """Distinct edges and nodes on ``long`` ids, with the dictionary back to names.

    Returns ``(edges(src, dst), nodes(node), dictionary)``.  A range-partitioned
    sort then ``monotonically_increasing_id`` (partition index in the high bits)
    gives ids that increase with the name, so "min id" is "min name" and loop
    results decode to the same answers while every round shuffles 8-byte keys
    instead of paths.
    """
    e = _persist(simple_edges(edges))
    nodes = nodes_of(e)
    dic = _persist(nodes.orderBy("node").select("node", F.monotonically_increasing_id().alias("nid")))
    n = e.count()
    ids = _persist(join_spread(join_spread(e, dic.select(F.col("node").alias("src"), F.col("nid").alias("s")), "src", n),
                               dic.select(F.col("node").alias("dst"), F.col("nid").alias("d")), "dst", n)
                   .select(F.col("s").alias("src"), F.col("d").alias("dst")))
    return ids, dic.select(F.col("nid").alias("node")), dic


def decode_nodes(df: DataFrame, dic: DataFrame, cols: list[str]) -> DataFrame:
    """Replace id columns by node names (one join per column against the dictionary)."""
    for c in cols:
        df = df.join(dic.select(F.col("nid").alias(c), F.col("node").alias(f"_{c}_name")), c) \
            .drop(c).withColumnRenamed(f"_{c}_name", c)
    return df


# ------------------------------------------------------------------- degree
def degree(edges: DataFrame) -> DataFrame:
    """In/out/total degree and weighted strength per node, one shuffle with map-side combine."""
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    e = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull())
    out_side = e.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"),
                        F.lit(0.0).alias("iw"), w.alias("ow"))
    in_side = e.select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"),
                       w.alias("iw"), F.lit(0.0).alias("ow"))
    g = out_side.unionByName(in_side).groupBy("node").agg(
        F.sum("i").cast("bigint").alias("in_degree"), F.sum("o").cast("bigint").alias("out_degree"),
        F.sum("iw").alias("in_weight"), F.sum("ow").alias("out_weight"))
    return g.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


# ----------------------------------------------------- min-label propagation
def propagate_min_label(nodes: DataFrame, arcs: DataFrame, max_rounds: int | None = None,
                        shortcut: bool = True) -> DataFrame:
    """Label every node with the smallest node id that reaches it along ``arcs(src, dst)``.

    Semi-naive hooking: round r only pushes labels of nodes that changed in
    round r-1 (``changed`` flag).  With ``shortcut`` each round also jumps
    pointers, ``label(v) <- min(label(v), label(label(v)))`` -- valid because
    ``label(v)`` reaches ``v`` and reachability is transitive -- so a chain of
    length d settles in O(log d) rounds instead of d.  One table is written per
    round.  Returns ``(node, label)``.
    """
    lab = _persist(nodes.select("node", F.col("node").alias("label"), F.lit(True).alias("changed")))
    n_front = lab.count()
    rnd = 0
    while n_front > 0 and (max_rounds is None or rnd < max_rounds):
        rnd += 1
        front = lab.where("changed").select(F.col("node").alias("src"), F.col("label").alias("fl"))
        cand = arcs.join(_maybe_broadcast(front, n_front), "src").groupBy(F.col("dst").alias("node")) \
            .agg(F.min("fl").alias("cl"))
        hooked = lab.join(cand, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("cl", "label")).alias("label"))
        if shortcut:
            # label of my label (one row per node on the right: AQE splits a hot label)
            via = lab.select(F.col("node").alias("label"), F.col("label").alias("ll"))
            hooked = hooked.join(via, "label", "left").select(
                "node", "old", F.least("label", F.coalesce("ll", "label")).alias("label"))
        lab = _persist(hooked.select("node", "label", (F.col("label") < F.col("old")).alias("changed")))
        n_front = lab.where("changed").count()
    return lab.select("node", "label")


def connected_components(edges: DataFrame) -> DataFrame:
    """Weakly connected components: ``(node, component, component_size)``, component = min node id."""
    e, nodes, dic = encode_nodes(edges)
    und = _persist(e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    lab = propagate_min_label(nodes, und)
    sizes = lab.groupBy("label").agg(F.count(F.lit(1)).alias("component_size"))
    out = lab.join(sizes, "label").select("node", F.col("label").alias("component"), "component_size")
    return decode_nodes(out, dic, ["node", "component"]).select("node", "component", "component_size")


# ------------------------------------------------------------------------ SCC
def _restrict(e_all: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` -- derived from materialised inputs, so no plan growth."""
    return (e_all.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
            .join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))


def _trim(nodes: DataFrame, e_all: DataFrame) -> DataFrame:
    """Repeatedly drop nodes without an in-edge or an out-edge: they lie on no cycle."""
    n_before = nodes.count()
    while True:
        e = _restrict(e_all, nodes)
        has_in = e.select(F.col("dst").alias("node"))
        has_out = e.select(F.col("src").alias("node"))
        nodes = _persist(nodes.join(has_in, "node", "left_semi").join(has_out, "node", "left_semi"))
        n_after = nodes.count()
        if n_after == n_before:
            return nodes
        n_before = n_after


def strongly_connected_components(edges: DataFrame) -> DataFrame:
    """``(node, scc, scc_size, self_loop)`` for every node; ``scc`` = min node name of its SCC.

    Trim, then forward colouring + backward reach inside each colour
    (the colouring SCC algorithm); each outer round removes at least one SCC
    per colour.  Trimmed nodes are singleton SCCs.  Runs on dense ids.
    """
    e_ids, nodes, dic = encode_nodes(edges)
    out = _scc_ids(e_ids, nodes)
    return decode_nodes(out, dic, ["node", "scc"]).select("node", "scc", "scc_size", "self_loop")


def _scc_ids(e_all: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """SCC on already-distinct, already-materialised ``(src, dst)`` and ``(node)`` tables."""
    active = _trim(all_nodes, e_all)
    found = None
    n_active = active.count()
    while n_active > 0:
        e = _restrict(e_all, active)
        color = propagate_min_label(active, e)
        csrc = color.select(F.col("node").alias("src"), F.col("label").alias("cs"))
        cdst = color.select(F.col("node").alias("dst"), F.col("label").alias("cd"))
        ec = _persist(e.join(csrc, "src").join(cdst, "dst").where(F.col("cs") == F.col("cd"))
                      .select("src", "dst", F.col("cs").alias("scc")))
        vis = _persist(color.where(F.col("node") == F.col("label"))
                       .select("node", F.col("label").alias("scc"), F.lit(0).alias("hop")))
        n_front, rnd = vis.count(), 0
        while n_front > 0:
            rnd += 1
            f = vis.where(F.col("hop") == rnd - 1).select(F.col("node").alias("dst"), "scc")
            nxt = (ec.join(_maybe_broadcast(f, n_front), ["dst", "scc"])
                   .select(F.col("src").alias("node"), "scc").distinct()
                   .join(vis.select("node"), "node", "left_anti").withColumn("hop", F.lit(rnd)))
            vis = _persist(vis.unionByName(nxt))
            n_front = vis.where(F.col("hop") == rnd).count()
        found = vis.select("node", "scc") if found is None else _persist(found.unionByName(vis.select("node", "scc")))
        active = _persist(active.join(vis.select("node"), "node", "left_anti"))
        n_active = active.count()
    if found is None:
        found = all_nodes.limit(0).select("node", F.col("node").alias("scc"))
    singletons = all_nodes.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("scc"))
    scc = found.unionByName(singletons)
    sizes = scc.groupBy("scc").agg(F.count(F.lit(1)).alias("scc_size"))
    loops = e_all.where(F.col("src") == F.col("dst")).select(F.col("src").alias("node"), F.lit(True).alias("self_loop"))
    return (scc.join(sizes, "scc").join(loops, "node", "left")
            .select("node", "scc", "scc_size", F.coalesce("self_loop", F.lit(False)).alias("self_loop")))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on at least one directed cycle, with their SCC id and size."""
    s = strongly_connected_components(edges)
    return s.where((F.col("scc_size") > 1) | F.col("self_loop")).select("node", "scc", "scc_size", "self_loop")


def short_cycles(edges: DataFrame) -> DataFrame:
    """Self-loops (length 1) and mutual dependencies a<->b (length 2), one row per cycle.

    An equi-join on the reversed pair -- linear in edges, never all pairs of a hub.
    """
    e = simple_edges(edges)
    loops = e.where(F.col("src") == F.col("dst")).select(
        F.col("src").alias("node_a"), F.col("dst").alias("node_b"), F.lit(1).alias("length"))
    rev = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = (e.where(F.col("src") < F.col("dst")).join(rev, ["src", "dst"], "left_semi")
              .select(F.col("src").alias("node_a"), F.col("dst").alias("node_b"), F.lit(2).alias("length")))
    return loops.unionByName(mutual)


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """One shortest cycle of every strongly connected component: ``(scc, length, cycle)``.

    ``cycle`` lists its nodes from the smallest one on; of all shortest cycles of a component
    it is the first in the order of these lists.  A breadth-first search runs from every node
    ``s`` of the components at once, over nodes above ``s`` alone (a cycle is found from its
    smallest node); a component leaves as soon as it closes, so the pairs ``(s, node)``
    reach no farther than its shortest cycle.  The cycle is then walked forward by the
    distances back to its start, a step a round.
    """
    e, nodes, dic = encode_nodes(edges)
    scc = _scc_ids(e, nodes).where("scc_size > 1 or self_loop").select("node", "scc")
    scc = _persist(scc)
    inner = _persist(e.join(scc.select(F.col("node").alias("src"), "scc"), "src")
                     .join(scc.select(F.col("node").alias("dst"), F.col("scc").alias("other")), "dst").where("scc = other").select("src", "dst", "scc"))
    found = _persist(inner.where("src = dst").groupBy("scc").agg(F.min("src").alias("s"), F.lit(1).alias("length")))
    alive = _persist(inner.join(found.select("scc"), "scc", "left_anti"))
    front = _persist(alive.where("dst > src").select(F.col("src").alias("s"), F.col("dst").alias("node"), "scc"))
    seen, length = front, 1
    while not front.isEmpty():
        length += 1
        step = front.select("s", F.col("node").alias("src"), "scc").join(alive, ["src", "scc"])
        closed = _persist(step.where("dst = s").groupBy("scc").agg(F.min("s").alias("s"), F.lit(length).alias("length")))
        found = _persist(found.unionByName(closed))
        alive = _persist(alive.join(closed.select("scc"), "scc", "left_anti"))
        front = _persist(step.where("dst > s").select("s", F.col("dst").alias("node"), "scc").distinct()
                         .join(closed.select("scc"), "scc", "left_anti").join(seen, ["s", "node"], "left_anti"))
        seen = _persist(seen.join(closed.select("scc"), "scc", "left_anti").unionByName(front))
    longest = found.agg(F.max("length")).first()[0] or 0
    # distances back to the start, within the found components
    ring = _persist(inner.join(found, "scc").where("src >= s and dst >= s"))
    dist = back = _persist(found.select("scc", F.col("s").alias("node"), F.lit(0).alias("d")))
    for d in range(1, longest):
        back = _persist(ring.where(F.col("length") > d).join(back.select("scc", F.col("node").alias("dst")), ["scc", "dst"]).select("scc", F.col("src").alias("node")).distinct()
                        .join(dist.select("scc", "node"), ["scc", "node"], "left_anti").withColumn("d", F.lit(d)))
        dist = _persist(dist.unionByName(back))
    walk = _persist(found.select("scc", "s", "length", F.col("s").alias("at"), F.array("s").alias("path")))
    for left in range(longest - 1, 0, -1):
        on = walk.where(F.col("length") - F.size("path") == left)
        step = on.join(ring.select("scc", F.col("src").alias("at"), F.col("dst").alias("next")), ["scc", "at"]) \
            .join(dist.where(F.col("d") == left).select("scc", F.col("node").alias("next")), ["scc", "next"]) \
            .groupBy("scc", "s", "length", "path").agg(F.min("next").alias("at"))
        walk = _persist(walk.where(F.col("length") - F.size("path") != left)
                        .unionByName(step.select("scc", "s", "length", "at", F.concat("path", F.array("at")).alias("path"))))
    places = walk.select("scc", "length", F.posexplode("path").alias("i", "node"))
    named = decode_nodes(places, dic, ["node", "scc"])
    return named.groupBy("scc", "length").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "node"))), lambda x: x["node"]).alias("cycle"))


# -------------------------------------------------------------- reachability
def impact_set(edges: DataFrame, target: str, max_hops: int | None = None) -> DataFrame:
    """All modules that (transitively) depend on ``target``: ``(module, hop)``, min hop.

    Reverse breadth-first frontier loop; ``left_anti`` against the visited set;
    one table written per hop.  ``target`` itself is excluded (even on a cycle).
    """
    e, _, dic = encode_nodes(edges)
    start = (dic.where(F.col("node") == F.lit(target)).select(F.col("nid").alias("node")) if dic is not None
             else e.sparkSession.createDataFrame([(target,)], "node string")).withColumn("hop", F.lit(0))
    vis = _persist(start)
    n_front, hop = vis.count(), 0
    while n_front > 0 and (max_hops is None or hop < max_hops):
        hop += 1
        f = vis.where(F.col("hop") == hop - 1).select(F.col("node").alias("dst"))
        nxt = (e.join(_maybe_broadcast(f, n_front), "dst").select(F.col("src").alias("node")).distinct()
               .join(vis.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
        vis = _persist(vis.unionByName(nxt))
        n_front = vis.where(F.col("hop") == hop).count()
    out = vis.where(F.col("hop") > 0)
    return decode_nodes(out, dic, ["node"]).select(F.col("node").alias("module"), "hop")


def _longest_chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(a, wave)``: the longest chain below every node of an acyclic graph ``edges(a, b)`` over ``nodes(a)``.

    ``wave(a)`` is the greatest of ``wave(b) + 1``.  In a round

    * nodes with a single open dependency are contracted: each is ``max(base, wave(b) + w)``,
      such functions compose, and pointer doubling takes all of a chain to its end at once;
    * nodes without open dependencies are final; they are passed on to those above.

    Only what is still open is rewritten, so a chain of n nodes takes about log n steps, and
    the contracted nodes are filled in from the end, round by round backwards.
    """
    left = _persist(nodes.select("a", F.lit(0).cast("long").alias("base")))
    open_ = _persist(edges.select("a", "b", F.lit(1).cast("long").alias("w")))
    final, chains = None, []
    while True:
        n = open_.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"), F.max("w").alias("w"))
        state = _persist(left.join(n, "a", "left"))
        done = state.where("n is null").select("a", F.col("base").alias("wave"))
        final = _persist(done if final is None else final.unionByName(done))
        if open_.isEmpty():
            break
        jump = _persist(state.where("n = 1").select("a", F.col("b").alias("to"), "base", "w"))
        while True:
            nxt = jump.select(F.col("a").alias("to"), F.col("to").alias("to2"), F.col("base").alias("base2"), F.col("w").alias("w2"))
            moved = _persist(jump.join(nxt, "to", "left"))
            if moved.where("to2 is not null").isEmpty():
                break
            jump = _persist(moved.select("a", F.coalesce("to2", "to").alias("to"), F.greatest("base", F.coalesce(F.col("base2") + F.col("w"), "base")).alias("base"),
                                         (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w")))
        chains.append(jump)
        # what is above sees the ends of chains, and final nodes as bases
        ends = jump.select(F.col("a").alias("b"), "to", F.col("base").alias("cb"), F.col("w").alias("cw"))
        rest = _persist(open_.join(jump.select("a"), "a", "left_anti").join(ends, "b", "left").select(
            "a", F.coalesce("to", "b").alias("b"), (F.col("w") + F.coalesce("cw", F.lit(0))).alias("w"), (F.col("cb") + F.col("w")).alias("base")))
        below = rest.join(done.withColumnRenamed("a", "b"), "b", "left")
        below = _persist(below.select("a", "b", "w", F.greatest(F.coalesce("base", F.lit(0)), F.coalesce(F.col("wave") + F.col("w"), F.lit(0))).alias("base"),
                                      F.col("wave").isNotNull().alias("final")))
        raised = below.groupBy("a").agg(F.max("base").alias("raised"))
        left = _persist(state.where("n > 1").select("a", "base").join(raised, "a", "left")
                        .select("a", F.greatest("base", F.coalesce("raised", "base")).alias("base")))
        open_ = _persist(below.where("not final").groupBy("a", "b").agg(F.max("w").alias("w")))
    for c in reversed(chains):
        ends = final.select(F.col("a").alias("to"), "wave")
        final = _persist(final.unionByName(c.join(ends, "to").select("a", F.greatest("base", F.col("wave") + F.col("w")).alias("wave"))))
    return final


def _condensed(e: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``scc(node, scc, scc_size)`` and the distinct edges ``(a, b)`` between components."""
    scc = _persist(_scc_ids(e, nodes).select("node", "scc", "scc_size"))
    ce = _persist(e.join(scc.select(F.col("node").alias("src"), F.col("scc").alias("a")), "src")
                  .join(scc.select(F.col("node").alias("dst"), F.col("scc").alias("b")), "dst")
                  .where(F.col("a") != F.col("b")).select("a", "b").distinct())
    return scc, ce


def migration_waves(edges: DataFrame) -> DataFrame:
    """Order modules so that dependencies migrate first: ``(module, scc, wave)``.

    Cycles are collapsed to their SCC; wave 0 holds SCCs with no dependency on
    another SCC, wave k those whose dependencies all sit in waves < k (the
    longest dependency chain below them).
    """
    e, nodes, dic = encode_nodes(edges)
    scc, ce = _condensed(e, nodes)
    waves = _longest_chains(scc.select(F.col("scc").alias("a")).distinct(), ce)
    out = scc.join(waves.select(F.col("a").alias("scc"), F.col("wave").cast("int").alias("wave")), "scc").select("node", "scc", "wave")
    return decode_nodes(out, dic, ["node", "scc"]).select(F.col("node").alias("module"), "scc", "wave")


#: Sketch size of reach estimates: 2 ** 14 registers, a standard error of 0.8 %.
REACH_LG_K = 14


def reach_sizes(edges: DataFrame) -> DataFrame:
    """``(module, reach)``: about how many other modules depend on a module, directly or not.

    A component's sketch holds its members and all that its dependents' sketches hold, so
    each edge of the condensation merges one sketch; components go in the order of the
    longest chain above them.  Standard error 0.8 % (exact for small sets).
    """
    e, nodes, dic = encode_nodes(edges)
    scc, ce = _condensed(e, nodes)
    up = _persist(_longest_chains(scc.select(F.col("scc").alias("a")).distinct(), ce.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    rounds = up.agg(F.max("wave")).first()[0]
    own = _persist(scc.groupBy("scc").agg(F.hll_sketch_agg("node", F.lit(REACH_LG_K)).alias("s")).join(up.withColumnRenamed("a", "scc"), "scc"))
    done = None
    for k in range((rounds if rounds is not None else -1) + 1):
        mine = own.where(F.col("wave") == k).select("scc", "s")
        if done is not None:
            above = ce.join(mine.select(F.col("scc").alias("b")), "b", "left_semi").join(done.withColumnRenamed("scc", "a"), "a").select(F.col("b").alias("scc"), "s")
            mine = mine.unionByName(above).groupBy("scc").agg(F.hll_union_agg("s").alias("s"))
        done = _persist(mine if done is None else done.unionByName(mine))
    if done is None:
        return dic.select(F.col("node").alias("module"), F.lit(0).cast("long").alias("reach"))
    size = done.select("scc", (F.hll_sketch_estimate("s") - 1).alias("reach"))
    return decode_nodes(scc.join(size, "scc").select("node", "reach"), dic, ["node"]).select(F.col("node").alias("module"), "reach")


def risk_rank(edges: DataFrame, k: int = 20, ascending: bool = False) -> DataFrame:
    """Refactoring risk: fan-in, fan-out, strength and cycle membership -> integer score.

    ``risk_score = (fan_in + 1) * (fan_out + 1) * scc_size``; top ``k`` by score
    (``ascending=True`` gives the least risky first).
    """
    edges = _persist(edges.select("source", "target", *[c for c in ("weight",) if c in edges.columns]))
    ids, nodes, dic = encode_nodes(edges)  # distinct pairs: a count of them counts distinct neighbours
    fo = ids.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))
    fi = ids.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))
    fans = _scc_ids(ids, nodes).select("node", "scc_size").join(fo, "node", "left").join(fi, "node", "left")
    w, none = (F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)), F.lit(None).cast("double")
    side = lambda end, ow, iw: F.struct(F.col(end).alias("module"), ow.alias("ow"), iw.alias("iw"))
    strength = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull()) \
        .select(F.inline(F.array(side("source", w, none), side("target", none, w)))).groupBy("module").agg(F.sum("ow").alias("ow"), F.sum("iw").alias("iw"))
    m = (fans.join(dic.select(F.col("nid").alias("node"), F.col("node").alias("module")), "node").join(strength, "module", "left")
         .select("module",
                 F.coalesce("fan_in", F.lit(0)).cast("bigint").alias("fan_in"),
                 F.coalesce("fan_out", F.lit(0)).cast("bigint").alias("fan_out"),
                 (F.coalesce("iw", F.lit(0.0)) + F.coalesce("ow", F.lit(0.0))).alias("strength"),
                 "scc_size"))
    m = m.withColumn("risk_score", (F.col("fan_in") + 1) * (F.col("fan_out") + 1) * F.col("scc_size"))
    order = ([F.col("risk_score").asc(), F.col("strength").asc(), F.col("module").asc()] if ascending
             else [F.col("risk_score").desc(), F.col("strength").desc(), F.col("module").asc()])
    return m.orderBy(*order).limit(k)
