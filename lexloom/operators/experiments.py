"""Experiments with several arms: positional pairing, savings, distributions, trial medians, box plots, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_even, ratio


def combine(prompts: DataFrame, arms: DataFrame, trials: int = 1) -> DataFrame:
    """Every prompt under every arm and trial. The arms are a parameter list, so prompts are exploded, not joined."""
    names = [tuple(r) for r in arms.select("arm", "arm_pos").collect()]
    cells = F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(p).alias("arm_pos")) for a, p in names))
    out = prompts.withColumn("cell", F.explode(cells)).select(*prompts.columns, "cell.*")
    return out.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))) if trials > 1 else out


def positional(left: DataFrame, right: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """The i-th of one list with the i-th of another, up to the shorter."""
    return left.join(right, [*keys, pos])


def from_snapshot(snapshot: DataFrame) -> DataFrame:
    """(arm, arm_pos, pos, prompt, output) from {prompts, arms: {arm: outputs}}, arms in their order: arrays zipped, not joined."""
    arms = snapshot.select("prompts", F.posexplode("arms").alias("arm_pos", "arm", "outputs"))
    zipped = arms.select("arm", "arm_pos", F.posexplode(F.slice(F.arrays_zip("prompts", "outputs"), F.lit(1), F.least(F.size("prompts"), F.size("outputs")))).alias("pos", "z"))
    return zipped.select("arm", "arm_pos", "pos", F.col("z.prompts").alias("prompt"), F.col("z.outputs").alias("output"))


def saving(tokens, control):
    """1 - tokens / control, 0 where the control is 0."""
    return F.when(F.coalesce(control, F.lit(0)) != 0, 1 - tokens / control).otherwise(0.0)


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, mean, minimum, maximum and sample deviation (0 for a single value)."""
    x = F.col(value)
    return df.groupBy(*by).agg(F.percentile(x, F.lit(0.5)).alias("median"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stdev"), F.count(x).alias("n"))


def box(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The five numbers of a box plot, and the mean."""
    x = F.col(value)
    q = lambda p: F.percentile(x, F.lit(p))
    return df.groupBy(*by).agg(F.min(x).alias("low"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(x).alias("high"), F.avg(x).alias("mean"))


def arm_totals(df: DataFrame, baseline: str, value: str = "tokens") -> DataFrame:
    """Tokens of each arm, and the saving of the sums against the baseline's (a ratio of totals)."""
    sums = df.groupBy("arm").agg(F.sum(value).alias("total"), F.max(F.when(F.col("arm") == baseline, 1).otherwise(0)).alias("base"))
    base = F.max(F.when(F.col("base") == 1, F.col("total"))).over(Window.partitionBy(F.lit(0)))  # a row for each arm
    return sums.select("arm", "total", saving(F.col("total"), base).alias("saving"))


def trial_medians(trials: DataFrame, arms: tuple[str, str], key: str = "id", value: str = "tokens") -> DataFrame:
    """The median of the trials of both arms for each prompt, the saving, and both as shown (cut, half-even)."""
    m = lambda arm: F.percentile(F.when(F.col("arm") == arm, F.col(value)), F.lit(0.5))
    both = trials.groupBy(key).agg(m(arms[0]).alias("normal"), m(arms[1]).alias("short"))
    share = F.when(F.col("normal") > 0, 1 - F.col("short") / F.col("normal")).otherwise(0.0)
    return both.where("normal is not null and short is not null").select(key, F.col("normal").cast("long").alias("normal_median"), F.col("short").cast("long").alias("short_median"), share.alias("saving"), half_even(share * 100).cast("long").alias("savings_pct"))


def benchmark_summary(medians: DataFrame) -> DataFrame:
    """Means of ratios (not of totals), shown half-even; means of cut medians."""
    pct = lambda x: half_even(x * 100).cast("long")
    return medians.agg(pct(F.avg("saving")).alias("avg_savings"), pct(F.min("saving")).alias("min_savings"), pct(F.max("saving")).alias("max_savings"), half_even(F.avg("normal_median")).cast("long").alias("avg_normal"), half_even(F.avg("short_median")).cast("long").alias("avg_short"))


def file_pairs(df: DataFrame) -> DataFrame:
    """Percent saved for each pair of word counts (before, after)."""
    return df.withColumn("pct", 100 * ratio(F.col("before") - F.col("after"), F.when(F.col("before") > 0, F.col("before"))))


def calls(prompts: DataFrame, arms: int, trials: int) -> DataFrame:
    return prompts.agg((F.count(F.lit(1)) * arms * trials).alias("calls"))
