"""The graph kept up by signed counts equals a full rebuild after any edits, replays and compactions."""
import os
import random

from pyspark.sql import functions as F

from codeweave.operators import delta_graph as DG
from codeweave.operators import indexing as IX
from codeweave.session import cut_lineage

SCHEMA = "file_path string, package string, imports array<string>, classes array<string>, method_name string, callees array<string>"


def _rows(rng, files):
    return [(f, rng.choice([None, "", "pkg", "Org"]), rng.sample(["lib1", "lib2", " lib3", f], rng.randint(0, 3)), rng.sample(["C1", "C2", "c3"], rng.randint(0, 2)),
             rng.choice([None, "m1", "m2", "m3"]), rng.choices(["m1", "m2", "m9"], k=rng.randint(0, 3))) for f in files for _ in range(rng.randint(1, 2))]


def _same(spark, md, counts, degrees):
    ents = {(r.title, r.type): r.frequency for r in IX.structural_entities(md).collect()}
    assert {(r.title, r.type): r.frequency for r in DG.entities(counts).collect()} == ents
    rels = {(r.source, r.target, r.type): (r.weight, r.n_files) for r in IX.structural_relationships(md).collect()}
    assert {(r.source, r.target, r.type): (r.weight, r.n_files) for r in DG.relationships(counts).collect()} == rels
    want = {}
    for s, t, _ in rels:
        want[s] = want.get(s, 0) + 1
        want[t] = want.get(t, 0) + 1
    assert {r.node: r.degree for r in degrees.collect()} == want


def test_edits_equal_a_rebuild(spark, tmp_dir):
    rng = random.Random(7)
    log = os.path.join(tmp_dir, "log")
    state = {f"f{i}.py": _rows(rng, [f"f{i}.py"]) for i in range(12)}
    md = lambda s: spark.createDataFrame([r for rows in s.values() for r in rows], SCHEMA)
    assert DG.current(spark, log).count() == 0
    DG.append(log, 0, DG.counts_of(md(state)))
    counts = DG.current(spark, log)
    degrees = cut_lineage(DG.degrees(counts))
    _same(spark, md(state), counts, degrees)
    for version in (1, 2, 3):
        new = dict(state)
        for f in rng.sample(sorted(state), 3):
            if rng.random() < 0.4:
                del new[f]
            else:
                new[f] = _rows(rng, [f])
        new[f"n{version}.py"] = _rows(rng, [f"n{version}.py"])
        old_rows, new_rows = DG.changed_rows(md(state), md(new))
        touched = {f for f in {*state, *new} if sorted(map(str, state.get(f, []))) != sorted(map(str, new.get(f, [])))}
        assert {r.file_path for r in old_rows.union(new_rows).collect()} == touched  # nothing else is read on
        delta = DG.signed(old_rows, new_rows)
        for _ in range(2):  # a replayed batch writes the same version
            DG.append(log, version, delta)
        counts = DG.current(spark, log)
        degrees = cut_lineage(DG.refresh_degrees(degrees, counts, delta))
        _same(spark, md(new), counts, degrees)
        state = new
        if version == 2:
            before = sorted(map(str, counts.collect()))
            DG.compact(spark, log, 2)
            assert sorted(map(str, DG.current(spark, log).collect())) == before
            DG.append(log, 2, delta)  # late replay of a compacted version
            assert sorted(map(str, DG.current(spark, log).collect())) == before
            DG.compact(spark, log, 1)
    assert DG.current(spark, log).where((F.col("files") <= 0) | (F.col("weight") < 0)).count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert DG.counts_of(none).count() == 0 and DG.signed(none, none).count() == 0
    old, new = DG.changed_rows(none, none)
    assert old.count() == new.count() == 0
