"""Sinks: append, atomic overwrite, JSON, reports, and a writer that verifies its backup first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formatting import utc_stamp


def append_rows(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("append").format(form).save(path)


def overwrite(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Readers see the old rows or the new ones; the commit protocol renames."""
    df.write.mode("overwrite").format(form).save(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def fingerprint(df: DataFrame) -> tuple:
    """Rows and two sums of row hashes: equal for equal rows in any order, without a shuffle of the rows."""
    row = lambda seed: F.sum(F.xxhash64(F.lit(seed), *sorted(df.columns)).cast("decimal(38,0)"))
    return tuple(df.agg(F.count(F.lit(1)), row(1), row(2)).first())


def publish(original: DataFrame, changed: DataFrame, backup: str, target: str, key: str = "path") -> int:
    """Write the originals as backup, read them back and compare, then publish the changed texts. Fails if a backup is
    there, or if it does not read back as written. Returns how many documents were published."""
    original.write.mode("errorifexists").parquet(backup)
    if fingerprint(original) != fingerprint(original.sparkSession.read.parquet(backup)):
        raise ValueError("the backup does not read back as written")
    changed.write.mode("overwrite").parquet(target)
    return original.sparkSession.read.parquet(target).select(key).count()


def write_result(metadata: DataFrame, summary: DataFrame, rows: DataFrame, raw: DataFrame, folder: str, at_ms: int, name: str = "benchmark") -> str:
    """A run's result as one nested JSON object {metadata, summary, rows, raw} under a name stamped with the time, in UTC.
    The tables are a report's: a row of metadata, a row of summary, a row for each prompt. Returns the path."""
    one = lambda df, c: df.limit(1).select(F.struct(*df.columns).alias(c))
    many = lambda df, c: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(c))
    whole = one(metadata, "metadata").join(one(summary, "summary")).join(many(rows, "rows")).join(many(raw, "raw"))
    stamp = rows.sparkSession.range(1).select(utc_stamp(F.lit(at_ms))).first()[0]
    path = f"{folder.rstrip('/')}/{name}_{stamp}"
    whole.coalesce(1).select(F.to_json(F.struct("metadata", "summary", "rows", "raw"), {"pretty": "true"}).alias("value")).write.mode("errorifexists").text(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """A folder of the shared store and all in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def summary_suffix(totals: DataFrame) -> DataFrame:
    """The short text shown beside a prompt: saved tokens, or nothing."""
    from ..functions.formatting import humanize

    return totals.select(F.when(F.col("est_saved_tokens") > 0, F.concat(F.lit("▼ "), humanize(F.col("est_saved_tokens")))).otherwise("").alias("suffix"))
