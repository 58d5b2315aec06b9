"""The driver's tables seen as the inputs of the operators. Each expression is plain SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown
from ..functions.spaces import SPACES

#: A fixed now, so that results do not depend on the day.
NOW_MS = 1_706_659_200_000  # 2024-01-31

#: White space taken from both ends, in DuckDB.
STRIP = lambda x: f"trim({x}, '{SPACES}')"

MODEL = "CASE conv_id % 6 WHEN 0 THEN 'claude-opus-4-1' WHEN 1 THEN 'claude-opus-4-5' WHEN 2 THEN 'claude-sonnet-4-20250514' WHEN 3 THEN 'claude-haiku-4-5' WHEN 4 THEN 'mystery-1' END"
MODE = "CASE conv_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'ultra' END"

HISTORY_MODE = "CASE event_type WHEN 'click' THEN 'full' WHEN 'view' THEN 'lite' WHEN 'error' THEN NULL ELSE 'full' END"
HISTORY_SESSION = "CASE WHEN user_id % 50 = 0 THEN NULL WHEN user_id % 50 = 1 THEN '' ELSE concat('s', CAST(user_id AS VARCHAR(20))) END"

PROMPT = (
    "CASE event_id % 27 WHEN 0 THEN '/terse' WHEN 1 THEN '/terse lite' WHEN 2 THEN '/terse ultra please' WHEN 3 THEN 'stop terse now' WHEN 4 THEN 'Activate terse mode' "
    "WHEN 5 THEN '/terse wenyan-full' WHEN 6 THEN '/terse unknown' WHEN 7 THEN '/terse-commit' WHEN 8 THEN '/terse-review x' WHEN 9 THEN '/terse:terse off' WHEN 10 THEN 'please be brief' "
    "WHEN 11 THEN '/terse-stats --share --since 7d' WHEN 12 THEN '/terse-stats' WHEN 13 THEN 'normal mode' WHEN 14 THEN '\"/terse ultra\"' WHEN 15 THEN 'activate terse mode: wenyan-lite' "
    "WHEN 16 THEN 'activate terse mode: off' WHEN 17 THEN 'activate terse mode:' WHEN 18 THEN 'dont stop, be terse' WHEN 19 THEN '/terse off' WHEN 20 THEN NULL WHEN 21 THEN 'talk like terse' WHEN 22 THEN concat(chr(9), '/terse lite') WHEN 23 THEN concat(chr(10), '/terse ultra', chr(10), chr(9)) WHEN 24 THEN concat('stop it', chr(10), 'and start terse') WHEN 25 THEN concat(chr(9), chr(10)) ELSE concat('hello ', CAST(event_id AS VARCHAR(20))) END"
)

_NL = "chr(10)"
_FENCE = f"concat('```python', {_NL}, 'x = 1', {_NL}, '# no heading', {_NL}, '```', {_NL})"
#: A markdown text for each part, and a shorter version that loses or adds something now and then.
ORIGINAL = f"concat('---', {_NL}, 'name: ', p_brand, {_NL}, 'tools:', {_NL}, '  - one', {_NL}, '---', {_NL}, '# ', p_name, {_NL}, 'The item is just a really good part in order to use. ', {_NL}, '- item ', CAST(p_partkey AS VARCHAR(20)), {_NL}, '* second', {_NL}, '+ third', {_NL}, '## More', {_NL}, {_FENCE}, 'Call `', p_brand, '` and `', p_brand, '` or `', p_type, '` at https://ex.org/', CAST(p_partkey AS VARCHAR(20)), '/a). See ./src/', CAST(p_size AS VARCHAR(20)), '/main.py', {_NL})"
SHORTER = f"concat('---', {_NL}, 'name: ', p_brand, {_NL}, 'tools:', {_NL}, '  - one', {_NL}, '---', {_NL}, '# ', CASE WHEN p_partkey % 7 = 1 THEN 'Other' ELSE p_name END, {_NL}, 'Item good part to use.', {_NL}, '- item ', CAST(p_partkey AS VARCHAR(20)), {_NL}, CASE WHEN p_partkey % 7 = 2 THEN '' ELSE concat('* second', {_NL}) END, '+ third', {_NL}, CASE WHEN p_partkey % 7 = 3 THEN '' ELSE concat('## More', {_NL}) END, CASE WHEN p_partkey % 11 = 1 THEN '' ELSE {_FENCE} END, 'Call `', p_brand, CASE WHEN p_partkey % 7 = 4 THEN '` or `' ELSE concat('` and `', p_brand, '` or `') END, p_type, CASE WHEN p_partkey % 7 = 5 THEN '` `new' ELSE '' END, '` at https://ex.org/', CASE WHEN p_partkey % 7 = 6 THEN '0' ELSE CAST(p_partkey AS VARCHAR(20)) END, '/a). See ./src/', CAST(p_size AS VARCHAR(20)), '/main.py', {_NL})"
PATH = "CASE p_partkey % 12 WHEN 0 THEN concat('/w/', p_brand, '/README.md') WHEN 1 THEN '/w/src/a.py' WHEN 2 THEN '/home/u/.ssh/notes.md' WHEN 3 THEN '/w/.env' WHEN 4 THEN '/w/api-key_notes.md' WHEN 5 THEN '/w/LICENSE' WHEN 6 THEN '/w/conf.yaml' WHEN 7 THEN '/w/id_rsa.pub' WHEN 8 THEN '/w/x.unknown' WHEN 9 THEN '/w/a.original.md' WHEN 10 THEN '/w/server.PEM' ELSE '/w/notes.txt' END"
JSONC = f"concat('{{', {_NL}, '  // about ', p_name, {_NL}, '  \"name\": \"', p_name, ' // kept\", /* and ', p_brand, ' */', {_NL}, '  \"sizes\": [', CAST(p_size AS VARCHAR(20)), ', 2,],', {_NL}, '}}')"
SUBJECT = "CASE o_orderkey % 8 WHEN 0 THEN 'fix: repair join of empty sides' WHEN 1 THEN 'feat(parser)!: read nested lists' WHEN 2 THEN 'update stuff' WHEN 3 THEN 'docs: added more words.' WHEN 4 THEN concat('perf: ', repeat('x', 60)) WHEN 5 THEN concat('fix: ', repeat('y', 90)) WHEN 6 THEN 'chore: ' ELSE concat('test(api): cover order ', CAST(o_orderkey AS VARCHAR(20))) END"
REVIEW = "CASE o_orderkey % 5 WHEN 0 THEN 'no findings here' ELSE concat('src/f', CAST(o_custkey % 7 AS VARCHAR(20)), '.py:', CAST(o_orderkey % 90 AS VARCHAR(20)), ': ! ', CASE o_orderkey % 3 WHEN 0 THEN 'bug' WHEN 1 THEN 'risk' ELSE 'nit' END, ': value is null. check it first.') END"
LOCATOR = "CASE o_orderkey % 4 WHEN 0 THEN 'No match.' ELSE concat('src/g', CAST(o_custkey % 5 AS VARCHAR(20)), '.py:', CAST(o_orderkey % 70 AS VARCHAR(20)), '-', CAST(o_orderkey % 70 + 3 AS VARCHAR(20)), ' — `sym', CAST(o_orderkey % 9 AS VARCHAR(20)), '` — caller of it') END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key to as many tasks as a shuffle has. A small file is one task's split, whatever is made of its rows."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as (session_id, pos, type, message, mode): words as tokens, characters as cached tokens."""
    usage = F.struct(markdown.words(F.col("text")).alias("output_tokens"), F.length("text").cast("long").alias("cache_read_input_tokens"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), F.col("role").alias("type"), F.struct(F.expr(MODEL).alias("model"), usage.alias("usage")).alias("message"), F.expr(MODE).alias("mode"))


SESSIONS_SQL = f"""sessions AS (
  SELECT conv_id AS session_id, coalesce(sum(w) FILTER (WHERE a), 0)::BIGINT AS output_tokens, coalesce(sum(length(text)) FILTER (WHERE a), 0)::BIGINT AS cache_read_tokens,
         count(*) FILTER (WHERE a) AS turns, arg_min(model, turn) FILTER (WHERE a AND model <> '') AS model, any_value(mode) AS mode
  FROM (SELECT *, role = 'assistant' AS a, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w, {MODEL} AS model, {MODE} AS mode FROM conversations)
  GROUP BY conv_id)"""
PRICE_SQL = "CASE WHEN model LIKE 'claude-opus-4-0%' OR model LIKE 'claude-opus-4-1%' OR model LIKE 'claude-opus-4-2025%' THEN 75.0 WHEN model LIKE 'claude-opus-4%' THEN 25.0 WHEN model LIKE 'claude-sonnet-4%' THEN 15.0 WHEN model LIKE 'claude-haiku-4%' THEN 5.0 WHEN model LIKE 'claude-3-5-sonnet%' THEN 15.0 WHEN model LIKE 'claude-3-5-haiku%' THEN 4.0 WHEN model LIKE 'claude-3-opus%' THEN 75.0 END"
DERIVED_SQL = f"{SESSIONS_SQL}, derived AS (SELECT *, CASE WHEN mode = 'full' THEN (floor(output_tokens / (1 - 0.65::DOUBLE) + 0.5))::BIGINT - output_tokens ELSE 0 END AS saved, {PRICE_SQL}::DOUBLE AS price FROM sessions), priced AS (SELECT *, coalesce(saved / 1e6 * price, 0.0) AS usd FROM derived)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as history rows; every hundredth without a time."""
    ts = F.when(F.col("event_id") % 100 != 99, F.unix_millis(F.col("ts").cast("timestamp")))
    tokens = F.floor(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(ts.alias("ts"), F.expr(HISTORY_SESSION).alias("session_id"), F.expr(HISTORY_MODE).alias("mode"), tokens.alias("output_tokens"), F.floor(tokens / 2).cast("long").alias("est_saved_tokens"), (tokens / 1000000).alias("est_saved_usd"), F.col("event_id").alias("line_no"))


HISTORY_SQL = f"""history AS (
  SELECT CASE WHEN event_id % 100 <> 99 THEN epoch_us(ts) // 1000 END AS ts, {HISTORY_SESSION} AS session_id, {HISTORY_MODE} AS mode, t AS output_tokens,
         floor(t / 2)::BIGINT AS est_saved_tokens, t / 1000000 AS est_saved_usd, event_id AS line_no
  FROM (SELECT *, floor(value * 100)::BIGINT AS t FROM events))"""


def latest_sql(since_ms: int | None = None) -> str:
    where = f"WHERE coalesce(ts, 0) >= {NOW_MS - since_ms}" if since_ms else ""
    return f"{HISTORY_SQL}, latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, coalesce(nullif(session_id, ''), '_') AS session_key, row_number() OVER (PARTITION BY coalesce(nullif(session_id, ''), '_') ORDER BY coalesce(ts, 0) DESC, line_no DESC) AS rn FROM history {where}) WHERE rn = 1)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages of sessions: every 41st starts its session anew, every 37th is idle."""
    kind = "CASE WHEN event_id % 41 = 0 THEN 'session.created' WHEN event_id % 37 = 0 THEN 'session.idle' ELSE 'message' END"
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.expr(kind).alias("event_type"), F.expr(PROMPT).alias("prompt"))


def markdown_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are narrow and their texts are not, so rows are dealt out before the texts are made."""
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    return parts.select("p_partkey", F.expr(ORIGINAL).alias("original"), F.expr(SHORTER).alias("compressed"), F.expr(PATH).alias("path"))
