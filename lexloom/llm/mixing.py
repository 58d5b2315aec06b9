"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Tokens are summed over (source, language, topic). Raking scales the cells' weights to the target shares of each margin in
turn until all three hold. The sample is to have ``keep`` of all tokens in expectation, and no document can be taken more
than once: so a category's target is at most its tokens over those of the sample (what is over goes to the other
categories in proportion), and no weight goes beyond its cell's. A document's probability is its cell's weight in tokens
over its cell's tokens: at most one, and a rare cell takes no more than itself from the sample. The expected tokens have
the target shares wherever cells allow it. A document is taken if the hash of its key lies below its probability: the same
documents on every run and every layout.

The targets default to the corpus's own shares raised to a power below one, which lifts small sources and lowers large
ones; topics come from ordered patterns. Cells and margins stay in tables: the planner broadcasts them only where their
known size is below its limit and else joins by shuffle, with hot cells split by adaptive execution.

Defined cases: null source or language is a category of its own; a null or empty text has no tokens, belongs to the last
topic and takes its cell's probability (a cell without tokens is taken whole); repeated rows share their fate; an empty
table gives no rows; other columns pass untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Topics by the first pattern that a text holds; "prose" if none does. ASCII only, alike in both engines.
TOPICS = (("legal", "[Ll]icensed under "), ("contact", "@[A-Za-z0-9-]+[.]|[+][0-9]+ [(]"), ("table", " [|] "), ("symbols", "(%%%|&&&|###|[*][*][*]) "))
DEFAULT_TOPIC = "prose"
WORD = "[^\\x20\\x09-\\x0D]+"
POWER = 0.7
#: The sample's tokens as a share of all, as expected.
KEEP = 0.5
MARGINS = ("source", "lang", "topic")
#: Rounds of raking; after every LOOK rounds the loop ends if every margin is within TOLERANCE of its target share.
ROUNDS, TOLERANCE, LOOK = 60, 1e-11, 5
#: Cells up to which raking may gather them in one task (about 60 bytes each).
GATHERED = 100_000
_OWN = "__mix_"


def topic_of(text: Column) -> Column:
    return reduce(lambda chain, x: chain.when(text.rlike(x[1]), x[0]), TOPICS[1:], F.when(text.rlike(TOPICS[0][1]), TOPICS[0][0])).otherwise(DEFAULT_TOPIC)


def described(docs: DataFrame, text: str, source: str, lang: str) -> DataFrame:
    """Adds the tokens and the three categories of each document under names of its own."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kind = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    return docs.withColumns({_OWN + "tokens": F.regexp_count(body, F.lit(WORD)).cast("long"), _OWN + "source": kind(source), _OWN + "lang": kind(lang), _OWN + "topic": topic_of(body)})


def default_targets(cells: DataFrame, margin: str, power: float = POWER) -> DataFrame:
    """(category, target share): the corpus's shares to a power, made to sum to one."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens"))
    share = F.pow(F.col("tokens").cast("double"), F.lit(power))
    total = sums.agg(F.sum(share)).first()[0] or 1.0
    return sums.select(margin, (share / F.lit(total)).alias("target"))


def attainable(cells: DataFrame, margin: str, targets: DataFrame, total: float, keep: float) -> DataFrame:
    """Targets that the tokens allow: a category's is at most its own share over ``keep``, the others share the rest in
    proportion. Their factor grows until no more categories are at their limit."""
    sums = cells.groupBy(margin).agg((F.sum("tokens") / F.lit(total) / F.lit(keep)).alias("limit"))
    rows, factor = common.written(targets.join(sums, margin), "targets"), 1.0
    while True:
        at_limit = F.col("limit") <= F.col("target") * F.lit(factor)
        taken, rest = rows.agg(F.sum(F.when(at_limit, F.col("limit")).otherwise(0.0)), F.sum(F.when(at_limit, 0.0).otherwise(F.col("target")))).first()
        if not rest or (1 - taken) / rest <= factor:
            break
        factor = (1 - taken) / rest
    return rows.select(margin, F.least("limit", F.col("target") * F.lit(factor)).alias("target"))


def _scaled_in_one(cells: DataFrame, rounds: int) -> DataFrame:
    """Rounds of raking where all cells lie in one partition: running sums by window, no shuffle between them."""
    for _ in range(rounds):
        for m in MARGINS:
            own = F.sum("weight").over(Window.partitionBy(m))
            cells = cells.withColumn("weight", F.least("limit", F.col("weight") * F.col(f"target_{m}") / own))
    errors = [F.abs(F.sum("weight").over(Window.partitionBy(m)) / F.col(f"target_{m}") - 1) for m in MARGINS]
    return cells.withColumn("error", F.greatest(*errors))


def _scaled(cells: DataFrame) -> DataFrame:
    """One round where the cells are many: sums by margin combine before the shuffle and are joined back, so a category
    with a third of all cells is no hot spot."""
    for m in MARGINS:
        sums = cells.groupBy(m).agg(F.sum("weight").alias("got"))
        cells = cells.join(sums, m).withColumn("weight", F.least("limit", F.col("weight") * F.col(f"target_{m}") / F.col("got"))).drop("got")
        cells = common.written(cells, "raking")
    return cells


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``weight`` (a share of the sample's tokens) and its ``limit`` to the cells, raked to the targets (shares of
    one). Both ways of a round give the same weights."""
    cells = cells.where("tokens > 0")
    total, n = cells.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    total, whole = float(total or 1), cells
    for m in MARGINS:
        cells = cells.join(attainable(whole, m, targets[m], total, keep).withColumnRenamed("target", f"target_{m}"), m)
    weighted = cells.withColumn("weight", F.col("tokens") / F.lit(total)).withColumn("limit", F.col("weight") / F.lit(keep))
    few = n <= GATHERED
    for turn in range(0, rounds or ROUNDS, LOOK):
        if few:
            weighted = common.written(_scaled_in_one(weighted.coalesce(1), LOOK), "raked")
            worst = weighted.agg(F.max("error")).first()[0]
        else:
            for _ in range(LOOK):
                weighted = _scaled(weighted)
            errors = [weighted.groupBy(m).agg(F.abs(F.sum("weight") / F.first(f"target_{m}") - 1).alias("e")).select("e") for m in MARGINS]
            worst = reduce(DataFrame.union, errors).agg(F.max("e")).first()[0]
        if worst is None or worst < tolerance:
            break
    return weighted.drop("error", *(f"target_{m}" for m in MARGINS))


def probabilities(base: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    """(source, lang, topic, weight, probability) of the cells of a described table."""
    cells = common.written(base.groupBy(*(F.col(_OWN + m).alias(m) for m in MARGINS)).agg(F.sum(_OWN + "tokens").alias("tokens")), "cells")
    raked = rake(cells, targets or {m: default_targets(cells, m) for m in MARGINS}, keep)
    return common.written(raked.select(*MARGINS, "weight", (F.col("weight") / F.col("limit")).alias("probability")), "mix")


def chance(key: str) -> Column:
    """A number from 0 to 1 that the key alone decides."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _joined(base: DataFrame, mix: DataFrame) -> DataFrame:
    mix = mix.select(*(F.col(m).alias(_OWN + m) for m in MARGINS), F.col("weight").alias(_OWN + "weight"), F.col("probability").alias(_OWN + "p"))
    return base.join(mix, [_OWN + m for m in MARGINS], "left").withColumn(_OWN + "p", F.coalesce(F.col(_OWN + "p"), F.lit(1.0)))


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    """One row for each document: key, categories, tokens, its cell's weight, its probability and whether it is taken."""
    narrow = docs.select(F.col(key).alias(key), F.col(text).alias(_OWN + "body"), F.col(source).alias(_OWN + "s"), F.col(lang).alias(_OWN + "l"))
    base = common.written(described(narrow, _OWN + "body", _OWN + "s", _OWN + "l").drop(_OWN + "body", _OWN + "s", _OWN + "l"), "mix-base")
    out = _joined(base, probabilities(base, targets, keep))
    own = lambda c, name: F.col(_OWN + c).alias(name)
    return out.select(key, own("source", "source"), own("lang", "lang"), own("topic", "topic"), own("tokens", "n_tokens"), F.round(own("weight", "w"), 9).alias("cell_weight"), F.round(own("p", "p"), 9).alias("probability"), (chance(key) < F.col(_OWN + "p")).alias("sampled"))


def sample(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    """The documents that are taken, with their own columns only. The text is read twice and never shuffled while the cells are few."""
    base = described(docs, text, source, lang)
    out = _joined(base, probabilities(base, targets, keep))
    return out.where(chance(key) < F.col(_OWN + "p")).select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle() -> str:
    """The same in DuckDB's SQL: the factors of the targets are written out, the rounds are a recursion."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in TOPICS) + f" ELSE '{DEFAULT_TOPIC}' END"
    parts = [
        f"base AS (SELECT doc_id, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens, source, lang, {topic} AS topic FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang FROM documents))",
        "cells AS (SELECT *, tokens / sum(tokens) OVER () AS share FROM (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM base GROUP BY ALL HAVING sum(n_tokens) > 0))",
    ]
    for m in MARGINS:
        parts.append(f"s_{m} AS MATERIALIZED (SELECT {m}, s / {KEEP} AS high, pow(t, {POWER}) / sum(pow(t, {POWER})) OVER () AS target FROM (SELECT {m}, sum(share) AS s, sum(tokens) AS t FROM cells GROUP BY {m}))")
        parts.append(f"f_{m}_0 AS (SELECT 1.0::DOUBLE AS f)")
        for i in range(12):
            parts.append(f"f_{m}_{i + 1} AS MATERIALIZED (SELECT greatest(any_value(f), coalesce((1 - sum(CASE WHEN high <= target * f THEN high ELSE 0 END)) / nullif(sum(CASE WHEN high <= target * f THEN 0 ELSE target END), 0), any_value(f))) AS f FROM s_{m}, f_{m}_{i})")
        parts.append(f"t_{m} AS MATERIALIZED (SELECT {m}, least(high, target * f) AS target_{m} FROM s_{m}, f_{m}_12)")
    keys, step = ", ".join(MARGINS), "SELECT * FROM raked"
    for m in MARGINS:
        step = f"SELECT * REPLACE (least(high, weight * target_{m} / sum(weight) OVER (PARTITION BY {m})) AS weight) FROM ({step})"
    parts.append(f"raked AS (SELECT 0 AS turn, {keys}, share / {KEEP} AS high, share AS weight, {', '.join('target_' + m for m in MARGINS)} FROM cells {' '.join(f'JOIN t_{m} USING ({m})' for m in MARGINS)} UNION ALL SELECT * REPLACE (turn + 1 AS turn) FROM ({step}) WHERE turn < {ROUNDS})")
    parts.append(f"mix AS (SELECT {keys}, weight, weight / high AS p FROM raked WHERE turn = {ROUNDS})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\nSELECT b.doc_id, b.source, b.lang, b.topic, b.n_tokens, round(weight, 9) AS cell_weight, round(coalesce(p, 1.0), 9) AS probability, ('0x' || substr(md5(b.doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < coalesce(p, 1.0) AS sampled FROM base b LEFT JOIN mix USING (source, lang, topic)"
