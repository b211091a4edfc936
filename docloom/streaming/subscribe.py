"""Subscriptions: a selection run again over the documents of each batch of updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..spec import Select


def subscribe(spark: SparkSession, updates: DataFrame, plan: Callable[[Select, DataFrame], DataFrame], select: Select, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """updates: a stream of whole documents, one for each change. Of several changes of a document in a batch the latest
    (by _height where there is one) counts. Results that are empty are not sent."""

    def batch(df: DataFrame, number: int) -> None:
        latest = df
        if "_height" in df.columns:
            latest = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), "_height").alias("d")).select("d.*").drop("_height")
        if "_deleted" not in latest.columns:
            latest = latest.withColumn("_deleted", F.lit(False))
        out = plan(select, latest)
        if not out.isEmpty():
            sink(out, number)

    writer = updates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
