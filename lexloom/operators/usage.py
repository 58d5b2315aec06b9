"""Usage analytics: sessions rolled up from transcripts, savings and cost, the latest snapshot of each session, totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import falsy_zero, half_up

# Output prices in USD a million tokens by model prefix, the most specific first; saving ratios by mode.
PRICES = (
    ("claude-opus-4-0", 75.0),
    ("claude-opus-4-1", 75.0),
    ("claude-opus-4-2025", 75.0),
    ("claude-opus-4", 25.0),
    ("claude-sonnet-4", 15.0),
    ("claude-haiku-4", 5.0),
    ("claude-3-5-sonnet", 15.0),
    ("claude-3-5-haiku", 4.0),
    ("claude-3-opus", 75.0),
)
RATIOS = {"full": 0.65}


def price_of(model: Column, prices=PRICES) -> Column:
    """The first prefix that matches, in order; null without a match. A short fixed list, so no join is needed."""
    first, *rest = prices
    return reduce(lambda chain, p: chain.when(model.startswith(p[0]), p[1]), rest, F.when(model.startswith(first[0]), first[1]))


def price_join(rows: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """The same against a price table (rank, prefix, usd_per_million) of any length: the longest of the first ranks wins.

    Prefixes are matched by equality: each distinct model is joined with its own prefixes, so no row meets every price.
    """
    models = rows.select(model).where(F.col(model).isNotNull()).distinct()
    parts = models.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length(model)), lambda n: F.substring(F.col(model), F.lit(1), n))))
    found = parts.join(prices, "prefix").groupBy(model).agg(F.min_by("usd_per_million", "rank").alias("usd_per_million"))
    return rows.join(found, model, "left")


def ratio_of(mode: Column, ratios=RATIOS) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in ratios.items() for x in kv)), mode)


def savings(tokens: Column, mode: Column, model: Column) -> tuple[Column, Column]:
    """(tokens saved, USD saved), 0 where there is no ratio or price."""
    saved = F.coalesce(half_up(tokens / (1 - ratio_of(mode))) - tokens, F.lit(0).cast("long"))
    return saved, F.coalesce(saved / 1e6 * price_of(model), F.lit(0.0))


def is_counted() -> Column:
    return (F.col("type") == "assistant") & F.col("message").isNotNull() & F.col("message.usage").isNotNull()


def counted(rows: DataFrame) -> DataFrame:
    """Assistant rows with a usage record."""
    return rows.where(is_counted())


def session_rollup(rows: DataFrame, session: str = "session_id", order: str = "pos") -> DataFrame:
    """Tokens, turns and the first model named in each session; a session without a counted turn has 0 of all. Partial
    sums before the one shuffle."""
    usage, model, is_turn = F.col("message.usage"), F.col("message.model"), F.coalesce(is_counted(), F.lit(False))
    tokens = lambda c: F.sum(F.when(is_turn, falsy_zero(usage[c])).otherwise(F.lit(0).cast("long")))
    return rows.groupBy(session).agg(
        tokens("output_tokens").alias("output_tokens"),
        tokens("cache_read_input_tokens").alias("cache_read_tokens"),
        F.count_if(is_turn).alias("turns"),
        F.min_by(F.when(is_turn, model), F.when(is_turn & (F.coalesce(model, F.lit("")) != ""), F.col(order))).alias("model"),
    )


def session_key(column: Column) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit("_"))


def in_window(history: DataFrame, now_ms: int, since_ms: int | None) -> DataFrame:
    """Rows of the last ``since_ms``; none or 0 keeps all."""
    return history.where(F.coalesce("ts", F.lit(0)) >= F.lit(now_ms - since_ms)) if since_ms else history


def latest_per_session(history: DataFrame, line: str = "line_no") -> DataFrame:
    """The row of the largest ts of each session, the later line winning ties. An aggregate, not a sort: rows combine
    before the shuffle, so a session with a third of all rows is no hot spot."""
    keyed = history.withColumn("session_key", session_key(F.col("session_id")))
    return keyed.groupBy("session_key").agg(F.max_by(F.struct(*history.columns), F.struct(F.coalesce("ts", F.lit(0)), F.col(line))).alias("r")).select("session_key", "r.*")


def totals(latest: DataFrame) -> DataFrame:
    zero = lambda c, t: F.coalesce(F.sum(c), F.lit(0)).cast(t)
    return latest.agg(F.count(F.lit(1)).alias("sessions"), zero("output_tokens", "long").alias("output_tokens"), zero("est_saved_tokens", "long").alias("est_saved_tokens"), zero("est_saved_usd", "double").alias("est_saved_usd"))


def pairs(files: DataFrame, shrunk_only: bool = True) -> DataFrame:
    """X.original.md with X.md of the same folder, from a listing (dir, name, size)."""
    originals = files.where(F.col("name").endswith(".original.md")).select("dir", F.regexp_replace("name", "\\.original\\.md$", "").alias("base"), F.col("size").alias("original_size"))
    small = files.where(F.col("name").endswith(".md") & ~F.col("name").endswith(".original.md")).select("dir", F.regexp_replace("name", "\\.md$", "").alias("base"), F.col("size").alias("compressed_size"))
    both = originals.join(small, ["dir", "base"])
    return both.where("original_size > compressed_size") if shrunk_only else both


def pairs_of(files: DataFrame, folders: list[str], shrunk_only: bool = True) -> DataFrame:
    """The pairs of some folders, with the folder's place in the list; a folder that is named again counts once."""
    order = F.array_distinct(F.array(*(F.lit(x) for x in folders)))
    place = F.array_position(order, F.col("dir"))
    return pairs(files.where(F.col("dir").isin(*folders)), shrunk_only).withColumn("place", place.cast("int"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Counts, bytes and estimated tokens (a quarter of the bytes); nulls without pairs."""
    saved = F.sum("original_size") - F.sum("compressed_size")
    return pairs.agg(F.count(F.lit(1)).alias("files"), F.sum("original_size").alias("original_bytes"), F.sum("compressed_size").alias("compressed_bytes"), half_up(saved / 4).alias("tokens_saved"))
