"""Keep an index's corpus and text units current as files arrive (I16, streaming form).

``readStream`` watches a drop folder of parquet files ``(doc_key, text[, deleted])``;
each micro-batch is applied by ``foreachBatch``:

* the batch is reduced to one row per key: the highest ``seq``, then a tombstone, then
  the greatest text;
* a ``snapshot_diff`` against the snapshot of *earlier epochs* classifies keys as
  added / changed / same / deleted -- only for keys in the batch (semi-join);
* added/changed documents are re-chunked; the new snapshot rows and units are
  appended to append-only logs partitioned by ``epoch``.

Writes use dynamic partition overwrite of ``epoch=<id>``, so a replayed epoch
(after a failure anywhere in the batch) compares with the same earlier epochs and
rewrites the same partitions: exactly-once state even with at-least-once batches.  The current state is "latest epoch per key"
(a partial/final ``max_by`` aggregate, skew-safe), never a driver-side merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.operators import indexing as IX
from codeweave.session import read_if_there

DROP_SCHEMA = "doc_key bigint, text string, deleted boolean, seq bigint"


def _latest(log: DataFrame, key: str = "doc_key") -> DataFrame:
    cols = [c for c in log.columns if c not in (key, "epoch")]
    agg = log.groupBy(key).agg(F.max_by(F.struct(*cols, "epoch"), "epoch").alias("_r"))
    return agg.select(key, "_r.*")


def current_snapshot(spark: SparkSession, state_dir: str, before: int | None = None) -> DataFrame:
    """Live documents; with ``before``, as of the epochs below it."""
    log = read_if_there(spark, f"{state_dir}/snapshot")
    if log is None:
        return spark.createDataFrame([], "doc_key bigint, text string")
    if before is not None:
        log = log.where(F.col("epoch") < before)
    return _latest(log).where(~F.col("deleted")).select("doc_key", "text")


def current_units(spark: SparkSession, state_dir: str) -> DataFrame:
    snap_log = spark.read.parquet(f"{state_dir}/snapshot")
    live = _latest(snap_log).where(~F.col("deleted")).select("doc_key", F.col("epoch").alias("_e"))
    units = spark.read.parquet(f"{state_dir}/units")
    return (units.join(live, "doc_key").where(F.col("epoch") == F.col("_e"))
            .drop("_e", "epoch"))


def apply_batch(state_dir: str, chunk_size: int = 1200, chunk_overlap: int = 100):
    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        b = (batch.withColumn("deleted", F.coalesce("deleted", F.lit(False)))
             .groupBy("doc_key").agg(F.max_by(F.struct("deleted", "text"), F.struct(
                 F.coalesce("seq", F.lit(-1)), "deleted", F.coalesce("text", F.lit("")))).alias("_r"))
             .select("doc_key", "_r.deleted", "_r.text"))
        cur = current_snapshot(spark, state_dir, epoch_id).join(b.select("doc_key"), "doc_key", "left_semi")
        diff = IX.snapshot_diff(cur, b.where(~F.col("deleted")).select("doc_key", "text"))
        tomb = b.where(F.col("deleted")).select("doc_key")
        status = (diff.join(tomb, "doc_key", "left_anti")
                  .unionByName(tomb.join(cur, "doc_key", "left_semi").withColumn("status", F.lit("deleted"))))
        touched = status.where(F.col("status") != "same").select("doc_key")
        snap_rows = b.join(touched, "doc_key", "left_semi").withColumn("epoch", F.lit(epoch_id))
        (snap_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch").parquet(f"{state_dir}/snapshot"))
        redo = b.where(~F.col("deleted")).join(status.where(F.col("status").isin("added", "changed")),
                                               "doc_key", "left_semi")
        units = IX.chunk_text(redo, "text", "doc_key", chunk_size, chunk_overlap).withColumn("epoch", F.lit(epoch_id))
        (units.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch").parquet(f"{state_dir}/units"))
        (status.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{state_dir}/changes"))
    return run


def start_upkeep(spark: SparkSession, drop_dir: str, state_dir: str, checkpoint_location: str,
                 available_now: bool = True, chunk_size: int = 1200, chunk_overlap: int = 100):
    """Start the watcher; with ``available_now`` it processes what is there and stops."""
    stream = spark.readStream.schema(DROP_SCHEMA).option("recursiveFileLookup", "true").parquet(drop_dir)
    w = (stream.writeStream.foreachBatch(apply_batch(state_dir, chunk_size, chunk_overlap))
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
