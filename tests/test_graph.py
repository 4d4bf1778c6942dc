"""Graph operators against brute force on small graphs (fixed cases + hypothesis)."""
from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st

from codeweave.operators import graph as G
from codeweave.operators import communities as CM
from codeweave.operators import dense as D


def reach_sets(nodes, edges):
    adj = {n: set() for n in nodes}
    for a, b in edges:
        adj[a].add(b)
    out = {}
    for n in nodes:
        seen, stack = set(), list(adj[n])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack.extend(adj[x])
        out[n] = seen
    return out


def brute_scc(edges):
    nodes = sorted({x for e in edges for x in e})
    r = reach_sets(nodes, edges)
    res = {}
    for n in nodes:
        comp = {m for m in nodes if (m in r[n] and n in r[m])} | {n}
        res[n] = (min(comp), len(comp), n in r[n])
    return res


def edf(spark, edges):
    return spark.createDataFrame([(a, b, 1) for a, b in edges] or [("x", "x", 1)][:0],
                                 "source string, target string, weight long")


def test_cycles_cases(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "x"), ("x", "y"), ("c", "d"), ("d", "c")]
    got = {r.node: (r.scc, r.scc_size) for r in G.cycle_nodes(edf(spark, e)).collect()}
    assert got == {"a": ("a", 4), "b": ("a", 4), "c": ("a", 4), "d": ("a", 4), "x": ("x", 1)}
    short = {(r.node_a, r.node_b, r.length) for r in G.short_cycles(edf(spark, e)).collect()}
    assert short == {("x", "x", 1), ("c", "d", 2)}


small_graphs = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=14)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(small_graphs)
def test_scc_matches_brute_force(spark, raw):
    edges = sorted({(f"n{a}", f"n{b}") for a, b in raw})
    want = brute_scc(edges)
    got = {r.node: (r.scc, r.scc_size) for r in G.strongly_connected_components(edf(spark, edges)).collect()}
    assert got == {n: (s, k) for n, (s, k, _) in want.items()}
    waves = {r.module: r.wave for r in G.migration_waves(edf(spark, edges)).collect()}
    for a, b in edges:                       # dependencies migrate no later than their dependents
        if want[a][0] != want[b][0]:
            assert waves[b] < waves[a]
        else:
            assert waves[a] == waves[b]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(small_graphs)
def test_components_and_impact(spark, raw):
    edges = sorted({(f"n{a}", f"n{b}") for a, b in raw})
    nodes = sorted({x for e in edges for x in e})
    und = edges + [(b, a) for a, b in edges]
    r = reach_sets(nodes, und)
    want = {n: min(r[n] | {n}) for n in nodes}
    got = {x.node: x.component for x in G.connected_components(edf(spark, edges)).collect()}
    assert got == want
    target = nodes[0]
    rev = reach_sets(nodes, [(b, a) for a, b in edges])[target] - {target}
    got_imp = {x.module for x in G.impact_set(edf(spark, edges), target).collect()}
    assert got_imp == rev


def test_community_invariants(spark):
    # two dense blocks of 15 joined by a bridge, plus a separate triangle
    e = [(f"a{i}", f"a{j}") for i in range(15) for j in range(15) if i < j and (i + j) % 3]
    e += [(f"b{i}", f"b{j}") for i in range(15) for j in range(15) if i < j and (i * j) % 4 != 1]
    e += [("a0", "b0"), ("t1", "t2"), ("t2", "t3"), ("t3", "t1")]
    m = CM.hierarchical_communities(edf(spark, e), max_size=10).toPandas()
    nodes = {x for pair in e for x in pair}
    assert set(m[m.level == 0].node) == nodes
    for lvl, g in m.groupby("level"):
        assert g.node.is_unique                      # one community per node per level
    deepest = m.sort_values("level").groupby("node").tail(1)
    assert deepest.groupby(["level", "community"]).size().max() <= 10
    parents = set(m.community)
    assert set(m[m.level > 0].parent) <= parents
    counts = {r.measure: r.n for r in CM.community_invariants(CM.hierarchical_communities(edf(spark, e), 10), edf(spark, e)).collect()}
    assert counts.pop("nodes_at_level_0") == len(nodes) and counts.pop("communities_at_level_0") == 2
    assert set(counts.values()) == {0}
    rep = CM.community_reports(CM.hierarchical_communities(edf(spark, e), max_size=10), edf(spark, e)).toPandas()
    assert set(rep.community) == set(m.community)


def test_long_chain_few_rounds(spark):
    # a 64-node path plus a back edge: one SCC, one component; shortcuts keep rounds logarithmic
    n = 64
    e = [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(n - 1)] + [(f"v{n - 1:03d}", "v000")]
    import codeweave.operators.graph as GG
    calls = []
    orig = GG._persist

    def counting(df):
        calls.append(1)
        return orig(df)
    GG._persist = counting
    try:
        lab = GG.propagate_min_label(GG.nodes_of(GG.simple_edges(edf(spark, e))), GG.simple_edges(edf(spark, e)))
        assert {r.label for r in lab.collect()} == {"v000"}
        assert len(calls) < 16                     # ~log2(64) rounds, not 64
    finally:
        GG._persist = orig
    got = {r.node: (r.scc, r.scc_size) for r in G.strongly_connected_components(edf(spark, e)).collect()}
    assert set(got.values()) == {("v000", n)}
    comp = {r.component for r in G.connected_components(edf(spark, e[:-1])).collect()}
    assert comp == {"v000"}


def test_dense_id_encoding_matches_names(spark):
    import codeweave.operators.graph as GG
    e = [("b", "c"), ("c", "b"), ("a", "b"), ("d", "d"), ("e", "a")]
    got = {r.node: (r.scc, r.scc_size) for r in GG.strongly_connected_components(edf(spark, e)).collect()}
    comp = {r.node: r.component for r in GG.connected_components(edf(spark, e)).collect()}
    imp = {r.module: r.hop for r in GG.impact_set(edf(spark, e), "b").collect()}
    waves = {r.module: r.wave for r in GG.migration_waves(edf(spark, e)).collect()}
    assert got == {"a": ("a", 1), "b": ("b", 2), "c": ("b", 2), "d": ("d", 1), "e": ("e", 1)}
    assert comp == {"a": "a", "b": "a", "c": "a", "e": "a", "d": "d"}
    assert imp == {"c": 1, "a": 1, "e": 2}
    assert waves["b"] == 0 and waves["a"] == 1 and waves["e"] == 2


def brute_cycles(edges):
    """The shortest cycle of every component, first in order, from its smallest node."""
    scc = brute_scc(edges)
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    best = {}

    def walk(path):
        for n in sorted(adj.get(path[-1], ())):
            if n == path[0]:
                c = scc[n][0]
                best[c] = min(best.get(c, (99, [])), (len(path), list(path)))
            elif n > path[0] and n not in path and len(path) < best.get(scc[path[0]][0], (99,))[0]:
                walk([*path, n])

    for n in sorted(adj):
        walk([n])
    return {(c, k, tuple(p)) for c, (k, p) in best.items()}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=16))
def test_shortest_cycles_match_brute_force(spark, raw):
    edges = sorted({(f"n{a}", f"n{b}") for a, b in raw})
    got = {(r.scc, r.length, tuple(r.cycle)) for r in G.shortest_cycles(edf(spark, edges)).collect()}
    assert got == brute_cycles(edges)


def test_shortest_cycles_cases(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    two = [("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("a2", "a4"), ("a4", "a1"), ("s", "s"), ("s", "t"), ("t", "s"), ("t", "u")]
    got = {(r.scc, r.length, tuple(r.cycle)) for r in G.shortest_cycles(edf(spark, ring + two)).collect()}
    assert got == {("r0", 9, tuple(f"r{i}" for i in range(9))), ("a1", 3, ("a1", "a2", "a3")), ("s", 1, ("s",))}
    assert G.shortest_cycles(edf(spark, [("a", "b"), ("b", "c")])).count() == 0
    assert G.shortest_cycles(edf(spark, [])).count() == 0


def chains(edges):
    below = {}
    for a, b in edges:
        below.setdefault(a, set()).add(b)
        below.setdefault(b, set())
    wave = {}

    def of(n):
        if n not in wave:
            wave[n] = max((of(x) + 1 for x in below[n]), default=0)
        return wave[n]

    for n in sorted(below):
        of(n)
    return wave


def test_waves_of_long_chains(spark, monkeypatch):
    """A chain of 10,000 modules takes a few dozen state tables, with side branches and rejoining paths."""
    n = 10_000
    edges = [(f"m{i:05d}", f"m{i - 1:05d}") for i in range(1, n)]
    tables = []
    persist = G._persist
    monkeypatch.setattr(G, "_persist", lambda df: tables.append(1) or persist(df))
    nodes = spark.range(n).withColumnRenamed("id", "a")
    got = G._longest_chains(nodes, spark.range(1, n).selectExpr("id as a", "id - 1 as b"))
    assert got.where("a = wave").count() == n and len(tables) < 60
    side = edges[:40] + [("m00040", "m00010"), ("x", "m00025"), ("x", "m00039"), ("y", "x"), ("y", "m00001"), ("m00005", "z"), ("z", "w"), ("w", "v")]
    got = {r.module: r.wave for r in G.migration_waves(edf(spark, side)).collect()}
    assert got == chains(side)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=30))
def test_waves_are_longest_chains(spark, raw):
    edges = sorted({(f"n{max(a, b):02d}", f"n{min(a, b):02d}") for a, b in raw if a != b})
    assert {r.module: r.wave for r in G.migration_waves(edf(spark, edges)).collect()} == chains(edges)


def test_reach_sizes(spark):
    """Within 5 % of the exact number of dependents; exact for small sets."""
    from codeweave.plans import fixtures as X
    edges = [(f"a{i}", "hub") for i in range(30)] + [("hub", "low"), ("low", "hub"), ("low", "end")]
    got = {r.module: r.reach for r in G.reach_sizes(edf(spark, edges)).collect()}
    assert got["a0"] == 0 and got["hub"] == got["low"] == 31 and got["end"] == 32
    graph = X.module_edges(spark, "/root/testdata/sf0.01")
    pairs = [(r.target, r.source) for r in graph.collect()]
    exact = {n: len(s - {n}) for n, s in reach_sets({x for p in pairs for x in p}, pairs).items()}
    got = {r.module: r.reach for r in G.reach_sizes(graph).collect()}
    assert got.keys() == exact.keys() and max(exact.values()) > 1000
    assert all(abs(got[n] - k) <= 0.05 * k for n, k in exact.items())
    assert G.reach_sizes(edf(spark, [])).count() == 0


def _random_edges(n, seed):
    import random
    rng = random.Random(seed)
    e = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", float(rng.randrange(1, 4))) for _ in range(5 * n)]
    return e + [("hub", f"n{i}", 1.0) for i in range(n)]


def test_local_moves_write_a_row_a_node(spark, monkeypatch):
    df = spark.createDataFrame(_random_edges(60, 1), "source string, target string, weight double")
    nodes, arcs, _ = CM._weighted_ids(df)
    m2 = arcs.agg({"w": "sum"}).first()[0]
    written, seen = CM.cut_lineage, []

    def counted(x):
        out = written(x)
        seen.append(out.count())
        return out

    monkeypatch.setattr(CM, "cut_lineage", counted)
    got = CM._local_moves(nodes, arcs, m2, 0.0, cap=10)
    assert max(seen) <= nodes.count() + 1 < arcs.count()
    # in many blocks, and with hubs whose arcs are summed by joins
    monkeypatch.setattr(CM, "BLOCK_ARCS", 50)
    monkeypatch.setattr(CM, "HUB_ARCS", 20)
    again = CM._local_moves(nodes, arcs, m2, 0.0, cap=10)
    assert abs(got[1] - again[1]) < 1e-12 and sorted(got[0].collect()) == sorted(again[0].collect())


def test_labels_summed_by_blocks(spark, monkeypatch):
    rows = _random_edges(40, 2)
    df = spark.createDataFrame(rows, "source string, target string, weight double")
    w = {}
    for a, b, x in rows:
        if a != b:
            for pair in ((a, b), (b, a)):
                w[pair] = w.get(pair, 0.0) + x
    names = sorted({a for a, _ in w})
    h = {r["n"]: r["h"] for r in spark.createDataFrame([(x,) for x in names], "n string").selectExpr("n", "xxhash64(n) h").collect()}
    lab = {x: x for x in names}
    for r in range(2):
        votes = {}
        for (a, b), x in w.items():
            if h[a] % 2 == r % 2:
                votes.setdefault(a, {}).setdefault(lab[b], []).append(x)
        lab |= {a: max(v, key=lambda c: (sum(v[c]), h[c])) for a, v in votes.items()}
    calls = []
    sums = CM.Blocks.sums
    monkeypatch.setattr(CM.Blocks, "sums", lambda self, *a: calls.append(1) or sums(self, *a))
    for block, hub in ((500_000, 2_000_000), (30, 15)):
        monkeypatch.setattr(CM, "BLOCK_ARCS", block)
        monkeypatch.setattr(CM, "HUB_ARCS", hub)
        assert {r["node"]: r["community"] for r in CM.label_propagation(df, rounds=2).collect()} == lab
    assert len(calls) == 4


def test_invariants_of_broken_hierarchies(spark):
    e = [("a", "b"), ("b", "c"), ("d", "e"), ("e", "f"), ("c", "d"), ("x", "y")]
    top = [(0, "0:a", None, n) for n in "abcdef"] + [(0, "0:x", None, n) for n in "xy"]

    def counts(rows):
        m = spark.createDataFrame(rows, "level int, community string, parent string, node string")
        return {r["measure"]: r["n"] for r in CM.community_invariants(m, edf(spark, e), 3).collect() if r["n"]}

    sound = [(1, "1:a", "0:a", n) for n in "abc"] + [(1, "1:d", "0:a", n) for n in "def"]
    assert {k: v for k, v in counts(top + sound).items() if k.startswith(("disc", "leav", "amb", "over"))} == {}
    # two leaves whose nodes don't hang together, one of them with a common neighbour; leaves count as units above
    loose = [(1, "1:a", "0:a", n) for n in "ac"] + [(1, "1:b", "0:a", n) for n in "bf"] + [(1, "1:d", "0:a", n) for n in "de"]
    got = counts(top + loose)
    assert got["leaves_without_common_neighbour"] == 1 and "disconnected_communities" not in got
    # a level 0 of two components
    apart = [(0, "0:a", None, n) for n in "abcdefxy"] + [(1, "1:x", "0:a", n) for n in "xy"]
    assert counts(apart + sound)["disconnected_communities"] == 1
    # a community that lies in two above it
    crossed = top + [(1, "1:a", "0:a", n) for n in "ab"] + [(1, "1:q", "0:a", "f"), (1, "1:q", "0:x", "x")]
    got = counts(crossed)
    assert got["ambiguous_parents"] == 1 and "disconnected_communities" not in got


def test_risk_rank_counts_pairs_once(spark, monkeypatch):
    rows = [("a", "b", 2.0), ("a", "b", 3.0), ("b", "a", None), ("a", "c", 1.5), ("c", "c", 1.0), ("d", "a", None), (None, "a", 9.0), ("a", None, 9.0)]
    df = spark.createDataFrame(rows, "source string, target string, weight double")
    want = [("a", 2, 2, 6.5, 2, 18), ("b", 1, 1, 5.0, 2, 8), ("c", 2, 1, 3.5, 1, 6), ("d", 0, 1, 0.0, 1, 2)]
    got = G.risk_rank(df, 9)
    assert [tuple(r) for r in got.collect()] == want
    # no table of all pairs of names in a task for distinct counts
    assert "distinct" not in got._jdf.queryExecution().executedPlan().toString().lower()
    monkeypatch.setattr(G, "ROWS_A_TASK", 1)
    assert [tuple(r) for r in G.risk_rank(df, 9).collect()] == want
    assert [r["module"] for r in G.risk_rank(df.drop("weight"), 2, ascending=True).collect()] == ["d", "c"]


def test_dense_labels_match_blocks(spark, monkeypatch):
    """Communities and invariants with all labels broadcast: the same as by blocks and joins, without a table or a shuffle a round."""
    rows = _random_edges(120, 3) + [("lone", "lone", 2.0), ("p", "q", None), (None, "q", 1.0), ("n1", "n2", 1.0), ("n2", "n1", 1.0)]
    df = spark.createDataFrame(rows, "source string, target string, weight double")
    written, calls = CM.cut_lineage, []
    for module in (CM, D):
        monkeypatch.setattr(module, "cut_lineage", lambda x: calls.append(1) or written(x))
    monkeypatch.setattr(D, "BLOCK_ARCS", 50)
    graph = CM.graph_of(df)
    got = CM.hierarchical_communities(df, 4, graph)
    assert graph.dense is not None and len(calls) < 12
    counts = sorted(map(tuple, CM.community_invariants(got, df, 4, graph).collect()))
    # a part of the leaves joined with others of their parent
    rows = got.collect()
    deep = max(r["level"] for r in rows)
    first = {}
    merged = spark.createDataFrame([(r["level"], first.setdefault(r["parent"], r["community"]) if r["level"] == deep else r["community"], r["parent"], r["node"]) for r in rows], got.schema)
    broken = sorted(map(tuple, CM.community_invariants(merged, df, 4, graph).collect()))
    assert dict(broken)["oversized_leaves"] > 0
    # too many nodes, or a node of too many arcs
    for module, name in ((D, "DENSE_NODES"), (CM, "HUB_ARCS")):
        with monkeypatch.context() as m:
            m.setattr(module, name, 20)
            assert CM.graph_of(df).dense is None
    joined = CM.Graph(graph.edges, graph.ends, graph.names, None)
    assert sorted(map(str, CM.hierarchical_communities(df, 4, joined).collect())) == sorted(map(str, rows))
    assert sorted(map(tuple, CM.community_invariants(got, df, 4, joined).collect())) == counts
    assert sorted(map(tuple, CM.community_invariants(merged, df, 4, joined).collect())) == broken


def test_dense_hash_and_order(spark):
    import numpy as np
    ids = np.array([0, 1, (3 << 33) + 7, -4, 2 ** 62])
    for number in (0, 23):
        assert [r[0] for r in spark.createDataFrame([(int(i),) for i in ids], "n long").selectExpr(f"xxhash64(n, {number})").collect()] == D.xxhash64(ids, number).tolist()
    # a cluster admits the best moves while there is room, of equal ones the smallest node
    moves = {"node": np.array([5, 2, 3, 4]), "better": np.array([1.0, 2.0, 1.0, 9.0]), "to": np.array([0, 0, 0, 1])}
    got = D.admitted(moves, np.array([0, 0, 1, 3, 4, 5]), 4)
    assert sorted(got["node"].tolist()) == [2, 3, 4]


def test_levels_leave_out_equal_and_small(spark):
    import numpy as np
    paths = [np.array(x, np.int32) for x in ([0, 0, 0, 0, 4, 4], [0, 0, 0, 0, 4, 4], [0, 0, 2, 2, 4, 4], [0, 1, 2, 3, 4, 5])]
    got = D.levels(paths, 2)
    assert [t["level"].tolist() for t in got] == [[0] * 6, [-1] * 6, [1, 1, 1, 1, -1, -1], [-1] * 6]
    assert got[2]["least"].tolist()[:4] == [0, 0, 2, 2] and got[2]["above"].tolist()[:4] == [0, 0, 0, 0]


def test_dense_reports_match_joins(spark, monkeypatch):
    rows = _random_edges(80, 4) + [("lone", "lone", 2.0), ("n1", "n1", 1.0), ("n1", "n2", 1.0), ("n2", "n1", None), ("n2", "n1", 3.0)]
    df = spark.createDataFrame(rows, "source string, target string, weight double")
    monkeypatch.setattr(D, "BLOCK_ARCS", 60)
    graph = CM.graph_of(df)
    m = CM.hierarchical_communities(df, 4, graph)
    pairs, calls = CM._end_pairs, []
    monkeypatch.setattr(CM, "_end_pairs", lambda e: calls.append(1) or pairs(e))
    got = CM.community_reports(m, df, 3, graph)
    assert not calls   # no join of edges with communities
    exp = CM.community_reports(m, df, 3)
    assert got.schema == exp.schema and sorted(map(str, got.collect())) == sorted(map(str, exp.collect())) and calls
    # a node outside the graph or twice at a level goes by joins
    for more in ([(0, "0:x", None, "outside")], [(0, "0:x", None, "n1")]):
        other = m.unionByName(spark.createDataFrame(more, m.schema))
        assert sorted(map(str, CM.community_reports(other, df, 3, graph).collect())) == sorted(map(str, CM.community_reports(other, df, 3).collect()))
