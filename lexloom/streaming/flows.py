"""Stateless rewriting of a stream of lines, and an append-and-recompute rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators import usage
from ..sources import sinks


def rewrite_lines(lines: DataFrame, fields: tuple[str, ...] = ("description",)) -> DataFrame:
    """Descriptions of list responses compressed, all other fields kept; other lines pass as they are."""
    return lines.select(jsonx.rewriter(fields)(F.col("value")).alias("value"))


def merge_batch(batch: DataFrame, number: int, history: str, latest: str, summary: str) -> None:
    """A batch's rows go to the history under the batch's number; the latest row of each session is the merge of the last
    version and the batch, written as the batch's own version; totals come from it. A batch that is replayed after a
    failure finds the version before it and writes the same again, so nothing counts twice, and no batch reads more than
    the sessions' latest rows."""
    spark = batch.sparkSession
    version = lambda n: f"{latest}/version={n}"
    batch = batch.persist()
    try:
        sinks.overwrite(batch, f"{history}/batch={number}")
        before = next((n for n in range(number - 1, max(-1, number - 3), -1) if sinks.exists(spark, version(n))), None)
        known = spark.read.schema(batch.schema).parquet(version(before)) if before is not None else None
        merged = usage.latest_per_session(known.unionByName(batch) if known is not None else batch).select(*batch.columns)
        sinks.overwrite(merged, version(number))
        now = spark.read.schema(batch.schema).parquet(version(number))
        sinks.overwrite(usage.totals(usage.latest_per_session(now)), summary)
        sinks.remove(spark, version(number - 2))
    finally:
        batch.unpersist()


def rollup(snapshots: DataFrame, history: str, latest: str, summary: str, checkpoint: str):
    """Each batch is appended to the history once, merged into the latest rows of all sessions, and the totals published."""

    def publish(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, history, latest, summary)

    return snapshots.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
