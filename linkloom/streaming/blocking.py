"""Streaming extension: arriving records matched against a standing reference, batch by batch.

The batch operators have no counterpart of this; it is the exact blocker run on
each micro-batch. Reference keys are read from a table, so that nothing is held
between batches, and results carry their batch's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.operators import blocking
from linkloom.operators import keys as K


def match_stream(arriving: DataFrame, reference: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the candidates of each batch below ``out`` (Parquet, one folder for each batch; a batch that runs again replaces its own)."""
    left = K.exact_keys(reference)

    def batch(df: DataFrame, number: int) -> None:
        found = blocking.match(left, K.exact_keys(df, "source"))
        found.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals(events: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Records by event-time window; what comes later than ``late`` falls away."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))
