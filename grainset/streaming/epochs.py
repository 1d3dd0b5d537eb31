"""Infinite epochs as a Structured Streaming query.

A ``rate-micro-batch`` source emits one tick per micro-batch; each tick is an
epoch number, joined (stream-static) with the dataset, so every micro-batch is one
more pass over all rows. Stateless library operators (projections, predicates,
casts) apply unchanged to the resulting streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import order_key


def infinite_epochs(spark: SparkSession, dataset: DataFrame, seed: int | None = None,
                    order_cols: list[str] | None = None) -> DataFrame:
    """Streaming DataFrame: the dataset repeated once per micro-batch, with ``epoch``.

    With ``seed``, rows carry ``order_key`` = md5(seed, epoch, keys): sorting a
    micro-batch by it gives that epoch's reproducible shuffle.
    """
    ticks = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", 1)
        .option("numPartitions", 1)
        .load()
        .select(F.col("value").cast("int").alias("epoch"))
    )
    out = F.broadcast(ticks).crossJoin(dataset)  # one tick a batch
    if seed is not None:
        keys = [F.col(c) for c in (order_cols or dataset.columns)]
        out = out.withColumn("order_key", order_key(seed, F.col("epoch"), *keys))
    return out


def run_epochs(stream: DataFrame, sink, max_epochs: int, checkpoint_dir: str, timeout_s: float = 300.0):
    """Drive at least ``max_epochs`` micro-batches into ``sink(batch_df, batch_id)``, then stop.

    The checkpoint folder must be on shared storage on a cluster (query restarts resume).
    """
    import threading
    import time

    done = threading.Event()
    seen = {"n": 0}

    def counting_sink(batch_df, batch_id):
        if seen["n"] < max_epochs:
            sink(batch_df, batch_id)
            seen["n"] += 1
        if seen["n"] >= max_epochs:
            done.set()

    q = (
        stream.writeStream.foreachBatch(counting_sink)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(processingTime="100 milliseconds")
        .start()
    )
    deadline = time.monotonic() + timeout_s
    try:
        while not done.wait(0.2):
            if q.exception() is not None:
                raise q.exception()
            if time.monotonic() > deadline:
                raise TimeoutError(f"only {seen['n']} of {max_epochs} epochs ran in {timeout_s}s")
    finally:
        q.stop()
    return seen["n"]


class _Enough(Exception):
    """Raised in the sink so that the micro-batch behind the last one wanted isn't committed."""


def epochs_to_table(stream: DataFrame, path: str, epochs: int, checkpoint_dir: str, timeout_s: float = 300.0) -> int:
    """Writes epochs 0 to ``epochs - 1`` below ``path``, each once, and stops; called again with
    the same folders (after a stop, a failure or for more epochs) it goes on where it was.

    A micro-batch is an epoch with a folder of its own, named by the batch, which a replay
    overwrites: a batch that was written but not committed when the query ended is written
    again, not added. The batch behind the last one wanted is refused, so it stays uncommitted
    and is the first of a later call. Returns how many epochs this call wrote."""
    import threading
    import time

    done, wrote = threading.Event(), []

    def sink(batch: DataFrame, number: int) -> None:
        if number >= epochs:
            done.set()
            raise _Enough(f"epoch {number} is not wanted")
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")
        wrote.append(number)

    query = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(processingTime="100 milliseconds")
        .start()
    )
    deadline = time.monotonic() + timeout_s
    try:
        while not done.wait(0.1):
            if query.exception() is not None:
                if done.wait(1.0):
                    break
                raise query.exception()
            if time.monotonic() > deadline:
                raise TimeoutError(f"only {len(wrote)} epochs ran in {timeout_s}s")
    finally:
        query.stop()
    return len(wrote)
