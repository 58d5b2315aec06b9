"""Sharding by sampled splitters, with DataFrame functions only.

Records lie in the order of the hash of the text, so equal texts are neighbours. A size-weighted sample of the hash (of
bounded expected size) gives quantile boundaries of 64 ranges a shard, whatever the table's size. Every range is then
measured over all rows; a range that holds too many bytes or rows is subdivided, first by the text's hash inside the
range, then, where one text fills a part alone, by a hash of the key and the row's place in the table. Cells in order fill
the shards to equal bytes, so the law is ``bytes``. A row's slot is its cell's offset plus its rank in the cell; cells have
a bounded number of rows, so no task ranks a shard; offsets are summed over ranges first, then inside each range.

Defined cases: a null text counts as empty (size 1, CRC 0); null keys and repeated rows get slots of their own; very long
texts count by their bytes and are never cut; an empty table gives no rows; other columns are ignored, whatever their
names. ``grown_shard`` is null, as this law moves rows when a shard is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 16
#: Ranges for each shard; a shard's bytes differ from the mean by about one of its cells.
RANGES = 64
#: Sampled keys for each range, as expected.
SAMPLED = 32
#: A range with many more rows than this is subdivided, however large the table is.
ROWS_PER_CELL = 200_000


def _unit(hashed):
    """A 64-bit hash as a number from 0 to 1."""
    return hashed.cast("double") / F.lit(2.0**64) + F.lit(0.5)


def _search(key, bounds: list[int]):
    """How many of the sorted bounds are at most the key: first among every k-th, then among the k that follow."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    coarse = F.array(*(F.lit(x).cast("long") for x in bounds[step - 1 :: step])) if len(bounds) >= step else F.array().cast("array<long>")
    fine = F.array(*(F.lit(x).cast("long") for x in bounds))
    block = F.size(F.filter(coarse, lambda x: x <= key))
    return block * step + F.size(F.filter(F.slice(fine, block * step + 1, F.lit(step)), lambda x: x <= key))


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for each row."""
    body = common.utf8(text)
    base = common.written(
        docs.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"), F.xxhash64(body).alias("place"), F.xxhash64(F.col(key).cast("string"), F.monotonically_increasing_id()).alias("spread")),
        "shard-base",
    )
    n, total = base.agg(F.count(F.lit(1)), F.sum("size")).first()
    names = {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    if not n:
        return base.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), names["law"].alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), names["grown_shard"].alias("grown_shard"))
    ranges = shards * RANGES
    # Size-weighted Poisson sample: ranges * SAMPLED keys are expected, whatever the table's size.
    chance = F.col("size") * F.lit(ranges * SAMPLED / total)
    sample = base.where(_unit(F.xxhash64("spread", F.lit(7))) < chance)
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = sample.agg(F.percentile_approx("place", cuts, 100_000)).first()[0]
    bounds = sorted(set(bounds or []))
    limits = [-(1 << 63), *bounds, (1 << 63) - 1]
    ends = F.array(*(F.lit(float(x)) for x in limits))
    mean_bytes, mean_rows = total / ranges, min(n / ranges, ROWS_PER_CELL)

    def subdivided(df: DataFrame, by: list[str], name: str, at) -> DataFrame:
        """Adds the part of a range that a row belongs to: one part for each mean range that the range is over full by."""
        sizes = df.groupBy(*by).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
        parts = F.ceil(F.greatest(F.col("b") / F.lit(mean_bytes), F.col("n") / F.lit(max(mean_rows, 1.0))))
        over = sizes.where((F.col("b") > F.lit(1.5 * mean_bytes)) | (F.col("n") > F.lit(1.5 * max(mean_rows, 1.0) + 16))).select(*by, parts.alias("parts"))
        return df.join(over, by, "left").withColumn(name, F.coalesce(F.least(F.col("parts") - 1, F.floor(F.col("parts") * at)), F.lit(0)).cast("long")).drop("parts")

    placed = base.withColumn("r", _search(F.col("place"), bounds))
    low, high = F.get(ends, F.col("r")), F.get(ends, F.col("r") + 1)
    inside = F.greatest(F.lit(0.0), (F.col("place").cast("double") - low) / (high - low))
    placed = subdivided(placed, ["r"], "p", inside)
    placed = subdivided(placed, ["r", "p"], "q", _unit(F.col("spread")))
    cells = common.written(placed.groupBy("r", "p", "q").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")), "shard-cells")
    # Bytes and rows before each range (their number is fixed), then before each cell of a range.
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    along = Window.orderBy("r")
    starts = cells.groupBy("r").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).select("r", before("b", along).alias("b0"), before("n", along).alias("n0"))
    inner = Window.partitionBy("r").orderBy("p", "q")
    cells = cells.join(starts, "r").withColumn("b0", F.col("b0") + before("b", inner)).withColumn("n0", F.col("n0") + before("n", inner))
    shard_of = F.least(F.lit(shards - 1), F.floor((F.col("b0") + F.col("b") / 2) * F.lit(shards) / F.lit(float(total)))).cast("int")
    cells = common.written(cells.select("r", "p", "q", "n0", shard_of.alias("shard")), "shard-plan")
    firsts = cells.groupBy("shard").agg(F.min("n0").alias("first"))
    cells = cells.join(firsts, "shard").select("r", "p", "q", "shard", (F.col("n0") - F.col("first")).alias("from"))
    rank = F.row_number().over(Window.partitionBy("r", "p", "q").orderBy("place", "spread", "key"))
    ranked = placed.withColumn("rank", rank)
    return ranked.join(cells, ["r", "p", "q"]).select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), names["law"].alias("law"), "shard", (F.col("from") + F.col("rank") - 1).cast("long").alias("slot"), names["grown_shard"].alias("grown_shard"))
