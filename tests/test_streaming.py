"""Streaming upkeep: two drops, a change, a deletion, and an unchanged re-send."""
import os

from codeweave.streaming import upkeep as U


def test_upkeep_two_drops(spark, tmp_dir):
    drop, state, ck = (os.path.join(tmp_dir, x) for x in ("drop", "state", "ck"))
    first = spark.createDataFrame([(1, "a b c", False, 0), (2, "d e", False, 0), (3, "f", False, 0)], U.DROP_SCHEMA)
    first.write.parquet(os.path.join(drop, "batch1"))
    U.start_upkeep(spark, drop, state, ck, chunk_size=2, chunk_overlap=0).awaitTermination()
    snap = {r.doc_key: r.text for r in U.current_snapshot(spark, state).collect()}
    assert snap == {1: "a b c", 2: "d e", 3: "f"}
    second = spark.createDataFrame([(1, "a b c", False, 0), (2, "d e x", False, 0), (3, None, True, 0), (4, "g", False, 0)],
                                   U.DROP_SCHEMA)
    second.write.parquet(os.path.join(drop, "batch2"))
    U.start_upkeep(spark, drop, state, ck, chunk_size=2, chunk_overlap=0).awaitTermination()
    snap = {r.doc_key: r.text for r in U.current_snapshot(spark, state).collect()}
    assert snap == {1: "a b c", 2: "d e x", 4: "g"}
    changes = {(r.epoch, r.doc_key): r.status for r in spark.read.parquet(os.path.join(state, "changes")).collect()}
    assert changes[(1, 1)] == "same" and changes[(1, 2)] == "changed"
    assert changes[(1, 3)] == "deleted" and changes[(1, 4)] == "added"
    units = {(r.doc_key, r.chunk_index): r.text for r in U.current_units(spark, state).collect()}
    assert units == {(1, 0): "a b", (1, 1): "c", (2, 0): "d e", (2, 1): "x", (4, 0): "g"}


def test_replay_after_a_crash_keeps_units(spark, tmp_dir):
    """The batch died after the snapshot was written: its replay must still write the units."""
    import shutil
    state = os.path.join(tmp_dir, "state")
    run = U.apply_batch(state, chunk_size=2, chunk_overlap=0)
    one = spark.createDataFrame([(1, "old", False, 1), (1, "a b c", False, 2)], U.DROP_SCHEMA)
    run(one, 0)
    shutil.move(os.path.join(state, "units"), os.path.join(tmp_dir, "lost"))
    run(one, 0)
    units = {(r.doc_key, r.chunk_index): r.text for r in U.current_units(spark, state).collect()}
    assert units == {(1, 0): "a b", (1, 1): "c"}
    run(one, 0)
    assert U.current_units(spark, state).count() == 2 and U.current_snapshot(spark, state).count() == 1
