"""Orphan state maintained by Structured Streaming, one fold per micro-batch.

Events carry ``kind`` ('parent' or 'reference') beside the columns of both layouts. Batch n starts from what stood
after batch n - 1 and writes segments of its own, so a batch that is run again gives the same state (exactly once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.operators.orphans import BUCKETS, OrphanState, snapshot

EVENTS = (
    "kind string, child_table string, ref_column string, parent_table string, row_id bigint, ref_key string, "
    "loaded_at timestamp_ntz, deleted_at timestamp_ntz"
)


class OrphanStream:
    """Use `fold` as the foreachBatch function of a stream of EVENTS. Every `snapshot_every` batches the counts are written."""

    def __init__(self, state_dir: str, buckets: int = BUCKETS, snapshot_every: int = 1):
        self.state_dir, self.buckets, self.snapshot_every = state_dir.rstrip("/"), buckets, snapshot_every

    def load(self, spark: SparkSession, batch: int) -> OrphanState:
        return OrphanState(spark, self.state_dir, self.buckets, batch)

    def fold(self, events: DataFrame, batch_id: int) -> None:
        state = self.load(events.sparkSession, batch_id - 1)
        new_parents = events.where("kind = 'parent'").select("parent_table", "ref_key", "row_id", "loaded_at", "deleted_at")
        new_refs = events.where("kind = 'reference'").select("child_table", "ref_column", "parent_table", "row_id", "ref_key", "loaded_at")
        state.fold(new_parents, new_refs)
        if batch_id % self.snapshot_every == 0:
            snapshot(state.pending()).write.mode("overwrite").parquet(f"{self.state_dir}/counts/batch={batch_id}")
