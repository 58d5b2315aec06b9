"""The mode of each session as a stream: keyed state, one value a session, in the state store."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import commands
from ..operators.state import change

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "session_id string, seq bigint, active_mode string, emits boolean"


class ModeTracker(StatefulProcessor):
    """Applies set, clear and keep in the order of a micro-batch's messages; emits each message's mode."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mode = handle.getValueState("mode", "mode string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = self.mode.get()[0] if self.mode.exists() else None
        for row in sorted(rows, key=lambda r: r["seq"]):
            if row["command"] is not None:
                now = None if row["command"] == "off" else row["command"]
            speaks = now is not None and now not in commands.INDEPENDENT and row["event_type"] == "message"
            yield Row(session_id=key[0], seq=row["seq"], active_mode=now, emits=speaks)
        if now is None:
            self.mode.clear()
        else:
            self.mode.update((now,))

    def close(self) -> None:
        pass


def mode_stream(events: DataFrame, default: str = "full", dialect: str = "hook", word: str = commands.WORD) -> DataFrame:
    """(session_id, seq, active_mode, emits) of a stream (session_id, seq, event_type, prompt). Commands are parsed by
    expressions before the rows are dealt out by session; only the state itself is kept by the processor."""
    parsed = events.select("session_id", "seq", "event_type", change("event_type", "prompt", default, dialect, word).alias("command"))
    return parsed.groupBy("session_id").transformWithState(statefulProcessor=ModeTracker(), outputStructType=OUT, outputMode="append", timeMode="none")


def run_available(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> DataFrame:
    """All that is there, once, into a table."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    query = stream.writeStream.format(form).outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).format(form).load(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts by window and kind; a watermark bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count(F.lit(1)).alias("n"))
