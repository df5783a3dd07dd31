"""Snapshot deltas of a stream of snapshot folders: each micro-batch is compared with the last published state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.delta import new_rows, resolved_rows
from cairn.operators.store import _exists
from cairn.session import drop_path


def stream_deltas(snapshots: DataFrame, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write new and resolved rows of each micro-batch below out/new and out/resolved, by epoch (repeats overwrite).

    Snapshots are kept below the checkpoint by epoch, so a restarted query goes on from the last one; those before
    the last two are deleted. A missing snapshot of the epoch before is an error: without it every row would count as new.
    """
    spark, root = snapshots.sparkSession, f"{checkpoint.rstrip('/')}/snapshots"

    def step(batch: DataFrame, epoch: int) -> None:
        at = lambda n: f"{root}/epoch={n}"
        batch.write.mode("overwrite").parquet(at(epoch))
        read = lambda n: spark.read.schema(batch.schema).parquet(at(n))
        now = read(epoch)
        if epoch > 0 and not _exists(spark, at(epoch - 1)):
            raise FileNotFoundError(f"the snapshot of epoch {epoch - 1} is missing at {at(epoch - 1)}")
        before = read(epoch - 1) if epoch > 0 else now.limit(0)
        new_rows(before, now, key).write.mode("overwrite").parquet(f"{out}/new/epoch={epoch}")
        resolved_rows(before, now, key).write.mode("overwrite").parquet(f"{out}/resolved/epoch={epoch}")
        drop_path(spark, at(epoch - 2))

    return snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
