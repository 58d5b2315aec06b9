"""Readers with declared schemas: JSON lines that skip bad rows, folder listings, manifests, dotenv and line lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commands, jsonx
from ..functions.markdown import unix_lines
from ..functions.spaces import blank, stripped

TRANSCRIPT = "type string, message struct<model:string, usage:struct<output_tokens:bigint, cache_read_input_tokens:bigint>>"
HISTORY = "ts bigint, session_id string, mode string, model string, output_tokens bigint, est_saved_tokens bigint, est_saved_usd double"
SNAPSHOT = "metadata struct<generated_at:string, model:string, n_prompts:int, terse_prefix:string>, prompts array<string>, arms map<string,array<string>>"
TRIAL = "struct<input_tokens:bigint, output_tokens:bigint, text:string, stop_reason:string>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of the solid lines of text files. A large file is read in splits: ``line_no`` is a struct of
    the split's place in the file and the line's in its task, which sorts as the lines stand."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = spark.read.option("ignoreMissingFiles", "true").text(path).select(F.col("_metadata.file_path").alias("path"), place.alias("line_no"), "value")
    return rows.where(~blank(F.col("value")))


def objects(rows: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Parsed JSON objects; a line that is bad, null or not an object goes."""
    ok = jsonx.valid(F.col(column)) & stripped(F.col(column)).startswith("{")
    return rows.where(ok).withColumn("o", F.from_json(column, schema)).select(*(c for c in rows.columns if c != column), "o.*")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Session transcripts, a file each; the session's id is the file's name."""
    name = F.regexp_extract("path", "([^/]+?)(\\.jsonl)?$", 1)
    return objects(lines(spark, path), TRANSCRIPT).withColumnRenamed("line_no", "pos").withColumn("session_id", name)


def history(spark: SparkSession, path: str) -> DataFrame:
    return objects(lines(spark, path), HISTORY)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, dir, name, size, modified) below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def newest(files: DataFrame) -> DataFrame:
    """The file changed last; of equals the first by path."""
    return files.orderBy(F.desc("modified"), "path").limit(1)


def within(files: DataFrame, root: str, depth: int) -> DataFrame:
    """Files whose folder lies at most so many levels below the root."""
    return files.where(F.size(F.split("dir", "/")) - len(root.rstrip("/").split("/")) <= depth)


def skills(files: DataFrame) -> DataFrame:
    """Names of folders that hold a SKILL.md, sorted."""
    return files.where(F.col("name") == "SKILL.md").select(F.element_at(F.split("dir", "/"), -1).alias("skill")).distinct().orderBy("skill")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, n_bytes) with line ends made one; bytes that are no UTF-8 are left out (n_bytes counts all)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    sound = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")))
    return raw.select("path", unix_lines(sound).alias("text"), F.octet_length("value").cast("long").alias("n_bytes"))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).json(path, multiLine=True)


def prompt_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(stripped(F.col("value")).alias("prompt"), F.row_number().over(_order()).alias("pos"))


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("line_no")


def settings(rows: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``settings`` (VARIANT): strict JSON, else JSON with comments, else null."""
    return rows.withColumn("settings", jsonx.parsed(F.col(column)))


def dotenv(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(key, value) of KEY=VALUE lines; comments go, the first = splits, keys that exist win."""
    line = stripped(F.col("value"))
    parts = F.split(line, "=", 2)
    pairs = rows.where(~line.startswith("#") & F.col("value").contains("=")).select(stripped(parts[0]).alias("key"), stripped(parts[1]).alias("value"))
    return pairs.join(existing.select("key"), "key", "left_anti") if existing is not None else pairs


def flag(rows: DataFrame, column: str = "value") -> DataFrame:
    """Stored modes, null where they are too long or unknown."""
    return rows.withColumn("mode", commands.valid(F.col(column)))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Newline-framed text as a stream; blank lines go."""
    return spark.readStream.text(path).where(~blank(F.col("value")))


def stream_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects as a stream, a file each, of any number of lines; a file that is no object goes."""
    whole = spark.readStream.text(path, wholetext=True)
    return objects(whole.select("value"), schema)
