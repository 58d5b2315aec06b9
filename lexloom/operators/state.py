"""The mode of each session after each message, in batch form (the streaming form is in ``streaming.modes``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import commands


def change(event: str, prompt: str, default: str, dialect: str, word: str):
    """The mode that an event sets: a session's start the default, a message its command, anything else nothing."""
    parse = commands.hook_command if dialect == "hook" else commands.plugin_command
    return F.when(F.col(event) == "session.created", F.lit(default)).when(F.col(event) == "message", parse(F.col(prompt), default, word))


#: Numbers of a session's order that one task runs along.
STRETCH = 100_000


def modes(events: DataFrame, session: str = "session_id", order: str = "seq", event: str = "event_type", prompt: str = "prompt", default: str = "full", dialect: str = "hook", word: str = commands.WORD) -> DataFrame:
    """Adds active_mode (null: off) and emits. The state runs along a session's own order (a number).

    The last command wins, so a session is cut into stretches: the last command of each stretch is an aggregate, the
    stretches' states are few rows, and only a stretch's own rows are sorted together. A session with a third of all rows
    is as many tasks as it has stretches."""
    rows = events.withColumn("__command", change(event, prompt, default, dialect, word)).withColumn("__stretch", F.floor(F.col(order) / STRETCH))
    ends = rows.groupBy(F.col(session).alias("__session"), F.col("__stretch").alias("__at")).agg(F.max_by("__command", F.when(F.col("__command").isNotNull(), F.col(order))).alias("__last"))
    # A stretch begins with the last command of the nearest stretch before it that has one.
    before = Window.partitionBy("__session").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("__before", F.last("__last", ignorenulls=True).over(before))
    whole = rows.join(starts, F.col(session).eqNullSafe(F.col("__session")) & F.col("__stretch").eqNullSafe(F.col("__at")))
    along = Window.partitionBy(session, "__stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.nullif(F.coalesce(F.last("__command", ignorenulls=True).over(along), F.col("__before")), F.lit("off"))
    out = whole.withColumn("active_mode", state).select(*events.columns, "active_mode")
    return out.withColumn("emits", commands.emits(F.col("active_mode")) & (F.col(event) == "message"))
