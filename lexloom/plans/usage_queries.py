"""Usage, reports, experiments and relational queries, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import commands, formatting, markdown, rounding
from ..operators import experiments, usage
from . import adapters as A

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _sessions(spark, d):
    rows = A.transcripts(spark, d)
    modes = rows.groupBy("session_id").agg(F.any_value("mode").alias("mode"))
    return usage.session_rollup(rows).join(modes, "session_id")


def _priced(spark, d):
    saved, dollars = usage.savings(F.col("output_tokens"), F.col("mode"), F.col("model"))
    return _sessions(spark, d).withColumn("saved", saved).withColumn("usd", dollars).withColumn("price", usage.price_of(F.col("model")))


@query(f"WITH {A.DERIVED_SQL} SELECT session_id, turns, output_tokens, cache_read_tokens, model, mode, saved AS est_saved_tokens, round(usd, 9) AS est_saved_usd FROM priced")
def session_usage(spark, d):
    p = _priced(spark, d)
    return p.select("session_id", "turns", "output_tokens", "cache_read_tokens", "model", "mode", F.col("saved").alias("est_saved_tokens"), F.round("usd", 9).alias("est_saved_usd"))


@query(f"WITH {A.latest_sql()} SELECT count(*) AS sessions, sum(output_tokens)::BIGINT AS output_tokens, sum(est_saved_tokens)::BIGINT AS est_saved_tokens, round(sum(est_saved_usd), 6) AS est_saved_usd FROM latest")
def lifetime_totals(spark, d):
    return usage.totals(usage.latest_per_session(A.history(spark, d))).withColumn("est_saved_usd", F.round("est_saved_usd", 6))


@query(f"WITH {A.latest_sql(7 * 86_400_000)} SELECT count(*) AS sessions, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(est_saved_tokens), 0)::BIGINT AS est_saved_tokens, round(coalesce(sum(est_saved_usd), 0), 6) AS est_saved_usd FROM latest")
def lifetime_window_7d(spark, d):
    rows = usage.in_window(A.history(spark, d), A.NOW_MS, 7 * 86_400_000)
    return usage.totals(usage.latest_per_session(rows)).withColumn("est_saved_usd", F.round("est_saved_usd", 6))


@query(f"WITH {A.latest_sql()} SELECT session_key, ts, mode, output_tokens, line_no FROM latest")
def latest_per_session(spark, d):
    return usage.latest_per_session(A.history(spark, d)).select("session_key", "ts", "mode", "output_tokens", "line_no")


@query(f"SELECT model, count(*) AS rows, max({A.PRICE_SQL})::DOUBLE AS usd_per_million FROM (SELECT {A.MODEL} AS model FROM conversations) GROUP BY model")
def price_lookup(spark, d):
    prices = spark.createDataFrame([(i, *p) for i, p in enumerate(usage.PRICES)], "rank int, prefix string, usd_per_million double")
    rows = A.table(spark, d, "conversations").select(F.expr(A.MODEL).alias("model")).groupBy("model").agg(F.count(F.lit(1)).alias("rows"))
    return usage.price_join(rows, prices).select("model", "rows", "usd_per_million")


@query("SELECT s AS spec, CASE WHEN regexp_matches(s, '^[0-9]+[dh]$') THEN CAST(regexp_extract(s, '^([0-9]+)', 1) AS BIGINT) * CASE WHEN s LIKE '%d' THEN 86400000 ELSE 3600000 END END AS ms FROM (SELECT DISTINCT CASE n_nationkey % 5 WHEN 0 THEN concat(n_nationkey, 'd') WHEN 1 THEN concat(n_nationkey, 'h') WHEN 2 THEN 'sometime' WHEN 3 THEN concat(n_nationkey, 'm') ELSE '' END AS s FROM nation)")
def durations(spark, d):
    s = F.expr("CASE n_nationkey % 5 WHEN 0 THEN concat(n_nationkey, 'd') WHEN 1 THEN concat(n_nationkey, 'h') WHEN 2 THEN 'sometime' WHEN 3 THEN concat(n_nationkey, 'm') ELSE '' END")
    return A.table(spark, d, "nation").select(s.alias("spec")).distinct().withColumn("ms", commands.duration_ms(F.col("spec")))


_HUMAN = "CASE WHEN n IS NULL OR n <= 0 THEN '0' WHEN n >= 1000000 THEN concat(floor(floor(n / 1000000.0::DOUBLE * 10 + 0.5) / 10)::BIGINT, '.', floor(n / 1000000.0::DOUBLE * 10 + 0.5)::BIGINT % 10, 'M') WHEN n >= 1000 THEN concat(floor(floor(n / 1000.0::DOUBLE * 10 + 0.5) / 10)::BIGINT, '.', floor(n / 1000.0::DOUBLE * 10 + 0.5)::BIGINT % 10, 'k') ELSE floor(n + 0.5)::BIGINT::VARCHAR END"


def _fixed_sql(x: str, digits: int) -> str:
    unit = 10**digits
    return f"concat(floor(floor({x} * {unit}.0::DOUBLE + 0.5) / {unit})::BIGINT, '.', lpad((floor({x} * {unit}.0::DOUBLE + 0.5)::BIGINT % {unit})::VARCHAR, {digits}, '0'))"


def _usd_sql(x: str) -> str:
    return f"concat('$', CASE WHEN {x} >= 1 THEN {_fixed_sql(x, 2)} WHEN {x} >= 0.01 THEN {_fixed_sql(x, 3)} ELSE {_fixed_sql(x, 4)} END)"


@query(f"SELECT line_no, {_HUMAN} AS short, {_usd_sql('u')} AS usd, format('{{:,}}', n) AS grouped FROM (SELECT event_id AS line_no, floor(value * 100)::BIGINT * (event_id % 700) AS n, value / 100 AS u FROM events)")
def humanized_report(spark, d):
    n, u = (F.floor(F.col("value") * 100).cast("long") * (F.col("event_id") % 700)).alias("n"), (F.col("value") / 100).alias("u")
    return A.table(spark, d, "events").select(F.col("event_id").alias("line_no"), n, u).select("line_no", formatting.humanize(F.col("n")).alias("short"), formatting.usd(F.col("u")).alias("usd"), formatting.thousands(F.col("n")).alias("grouped"))


_RULE = "repeat('─', 34)"
_NL = "chr(10)"


@query(f"WITH {A.latest_sql()}, t AS (SELECT count(*) AS sessions, sum(output_tokens)::BIGINT AS o, sum(est_saved_tokens)::BIGINT AS s, sum(est_saved_usd) AS u FROM latest) SELECT concat({_NL}, 'Stats — Lifetime (last 30d)', {_NL}, {_RULE}, {_NL}, 'Sessions:   ', format('{{:,}}', sessions), {_NL}, {_RULE}, {_NL}, 'Output tokens:         ', format('{{:,}}', o), {_NL}, 'Est. tokens saved:     ', format('{{:,}}', s), {_NL}, CASE WHEN u > 0 THEN concat('Est. saved (USD):      ~', {_usd_sql('u')}, {_NL}) ELSE '' END, {_RULE}, {_NL}) AS report FROM t")
def lifetime_report(spark, d):
    t = usage.totals(usage.latest_per_session(A.history(spark, d)))
    return t.select(formatting.lifetime_report(F.col("sessions"), F.col("output_tokens"), F.col("est_saved_tokens"), F.col("est_saved_usd"), F.lit("30d")).alias("report"))


_SHARE = f"CASE WHEN turns = 0 THEN 'no turns yet' WHEN mode = 'full' THEN concat('Saved ', format('{{:,}}', saved), ' output tokens', CASE WHEN price IS NULL THEN '' ELSE concat(' (~', {_usd_sql('usd')}, ')') END, ' across ', turns, ' turns this session') ELSE concat(turns, ' turns, ', format('{{:,}}', output_tokens), ' output tokens this session') END"
_BLOCK = f"CASE WHEN mode = 'full' THEN concat('Est. without:          ', format('{{:,}}', output_tokens + saved), {_NL}, 'Est. tokens saved:     ', format('{{:,}}', saved), ' (~65%)', CASE WHEN price IS NULL THEN '' ELSE concat({_NL}, 'Est. saved (USD):      ~', {_usd_sql('usd')}) END) WHEN coalesce(mode, 'off') <> 'off' THEN concat('No savings estimate for ''', mode, ''' mode') ELSE 'Not active this session.' END"


@query(f"WITH {A.DERIVED_SQL} SELECT session_id, {_SHARE} AS share, CASE WHEN turns = 0 THEN concat({_NL}, 'Stats', {_NL}, {_RULE}, {_NL}, 'No conversation yet', {_NL}, {_RULE}, {_NL}) ELSE concat({_NL}, 'Stats', {_NL}, {_RULE}, {_NL}, 'Session:  ...', right(path, 45), {_NL}, 'Turns:    ', turns, {_NL}, {_RULE}, {_NL}, 'Output tokens:         ', format('{{:,}}', output_tokens), {_NL}, 'Cache-read tokens:     ', format('{{:,}}', cache_read_tokens), {_NL}, {_RULE}, {_NL}, {_BLOCK}, {_NL}) END AS report FROM (SELECT *, concat('/home/someone/projects/a-long-folder-name/sessions/', session_id, '.jsonl') AS path FROM priced)")
def session_report(spark, d):
    p = _priced(spark, d).withColumn("path", F.concat(F.lit("/home/someone/projects/a-long-folder-name/sessions/"), F.col("session_id").cast("string"), F.lit(".jsonl"))).withColumn("ratio", usage.ratio_of(F.col("mode")))
    dollars = F.when(F.col("price").isNotNull(), F.col("usd"))
    share = formatting.share_line(F.col("output_tokens"), F.col("turns"), F.col("saved"), dollars, F.col("ratio").isNotNull())
    report = formatting.session_report(F.col("path"), F.col("turns"), F.col("output_tokens"), F.col("cache_read_tokens"), F.col("mode"), F.col("ratio"), F.col("saved"), dollars)
    return p.select("session_id", share.alias("share"), report.alias("report"))


_FILES = "concat('d', CAST(doc_id % 7 AS VARCHAR(20)))"


@query("SELECT count(*) AS files, sum(o)::BIGINT AS original_bytes, sum(c)::BIGINT AS compressed_bytes, floor((sum(o) - sum(c)) / 4 + 0.5)::BIGINT AS tokens_saved FROM (SELECT strlen(text) AS o, CASE WHEN doc_id % 5 = 0 THEN strlen(text) + 1 ELSE strlen(text) // 2 END AS c FROM documents WHERE doc_id % 3 <> 0) WHERE o > c")
def compressed_pairs(spark, d):
    """A listing of originals and (for two thirds of them) shorter copies, some of which are longer."""
    docs = A.table(spark, d, "documents").select(F.expr(_FILES).alias("dir"), F.col("doc_id").cast("string").alias("id"), "doc_id", F.octet_length("text").alias("n"))
    originals = docs.select("dir", F.concat("id", F.lit(".original.md")).alias("name"), F.col("n").cast("long").alias("size"))
    small = docs.where("doc_id % 3 <> 0").select("dir", F.concat("id", F.lit(".md")).alias("name"), F.when(F.col("doc_id") % 5 == 0, F.col("n") + 1).otherwise(F.floor(F.col("n") / 2)).cast("long").alias("size"))
    return usage.pair_summary(usage.pairs(originals.union(small)))


ARMS = (("baseline", 0), ("terse", 1), ("short", 2), ("shorter", 3))
_TOKENS = "CASE arm WHEN 'baseline' THEN w * 3 WHEN 'terse' THEN CASE WHEN item_id % 9 = 0 THEN 0 ELSE w * 2 END WHEN 'short' THEN w + item_id % 7 ELSE w // 2 END"
_ARMS_SQL = f"cells AS (SELECT item_id, arm, arm_pos, ({_TOKENS})::BIGINT AS tokens FROM (SELECT item_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM benchmark) CROSS JOIN (VALUES ('baseline', 0), ('terse', 1), ('short', 2), ('shorter', 3)) a(arm, arm_pos))"


def _arms(spark, d):
    prompts = A.table(spark, d, "benchmark").select("item_id", markdown.words(F.col("text")).alias("w"))
    cells = experiments.combine(prompts, spark.createDataFrame(ARMS, "arm string, arm_pos int"))
    return cells.select("item_id", "arm", "arm_pos", F.expr(_TOKENS.replace("w // 2", "w div 2")).cast("long").alias("tokens"))


_SAVED_SQL = "saved AS (SELECT s.arm, s.arm_pos, s.item_id, CASE WHEN c.tokens <> 0 THEN 1 - s.tokens / c.tokens ELSE 0 END AS saving FROM cells s JOIN cells c ON s.item_id = c.item_id AND c.arm = 'terse' WHERE s.arm IN ('short', 'shorter'))"


def _saved(spark, d):
    cells = _arms(spark, d)
    control = cells.where("arm = 'terse'").select("item_id", F.col("item_id").alias("pos"), F.col("tokens").alias("control"))
    both = experiments.positional(cells.where("arm in ('short', 'shorter')").withColumn("pos", F.col("item_id")), control, ["item_id"])
    return both.withColumn("saving", experiments.saving(F.col("tokens"), F.col("control")))


@query(f"WITH {_ARMS_SQL}, {_SAVED_SQL} SELECT arm, arm_pos, round(quantile_cont(saving, 0.5), 9) AS median, round(avg(saving), 9) AS mean, round(min(saving), 9) AS low, round(max(saving), 9) AS high, round(coalesce(stddev_samp(saving), 0), 9) AS stdev, count(*) AS n, row_number() OVER (ORDER BY quantile_cont(saving, 0.5) DESC, arm_pos)::INT AS place FROM saved GROUP BY arm, arm_pos")
def arm_savings(spark, d):
    from pyspark.sql import Window

    out = experiments.distribution(_saved(spark, d), ["arm", "arm_pos"], "saving")
    out = out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("median"), "arm_pos")))  # a row for each arm
    return out.select("arm", "arm_pos", *(F.round(c, 9).alias(c) for c in ("median", "mean", "low", "high", "stdev")), "n", "place")


@query(f"WITH {_ARMS_SQL}, t AS (SELECT arm, sum(tokens)::BIGINT AS total FROM cells GROUP BY arm) SELECT arm, total, round(1 - total / (SELECT total FROM t WHERE arm = 'baseline'), 9) AS saving FROM t")
def arm_totals(spark, d):
    return experiments.arm_totals(_arms(spark, d), "baseline").withColumn("saving", F.round("saving", 9))


_TRIALS = "trials AS (SELECT l_partkey AS id, l_returnflag AS arm, l_quantity AS tokens FROM lineitem)"
_MEDIANS = f"{_TRIALS}, m AS (SELECT id, quantile_cont(tokens, 0.5) FILTER (WHERE arm = 'N') AS n, quantile_cont(tokens, 0.5) FILTER (WHERE arm = 'R') AS s FROM trials GROUP BY id), medians AS (SELECT id, trunc(n)::BIGINT AS normal_median, trunc(s)::BIGINT AS short_median, CASE WHEN n > 0 THEN 1 - s / n ELSE 0 END AS saving FROM m WHERE n IS NOT NULL AND s IS NOT NULL)"


def _medians(spark, d):
    trials = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("arm"), F.col("l_quantity").alias("tokens"))
    return experiments.trial_medians(trials, ("N", "R"))


@query(f"WITH {_MEDIANS} SELECT id, normal_median, short_median, round(saving, 9) AS saving, round_even(saving * 100, 0)::BIGINT AS savings_pct FROM medians")
def trial_medians(spark, d):
    return _medians(spark, d).withColumn("saving", F.round("saving", 9))


@query(f"WITH {_MEDIANS} SELECT round_even(avg(saving) * 100, 0)::BIGINT AS avg_savings, round_even(min(saving) * 100, 0)::BIGINT AS min_savings, round_even(max(saving) * 100, 0)::BIGINT AS max_savings, round_even(avg(normal_median), 0)::BIGINT AS avg_normal, round_even(avg(short_median), 0)::BIGINT AS avg_short FROM medians")
def benchmark_summary(spark, d):
    return experiments.benchmark_summary(_medians(spark, d))


@query("SELECT lang, min(n_chars) AS low, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3, max(n_chars) AS high, round(avg(n_chars), 9) AS mean FROM documents GROUP BY lang")
def box_stats(spark, d):
    return experiments.box(A.table(spark, d, "documents"), ["lang"], "n_chars").withColumn("mean", F.round("mean", 9))


_PCT = "concat(CASE WHEN m < 0 THEN '−' ELSE '+' END, round_even(abs(m) * 100, 0)::BIGINT, '%')"


@query(f"WITH {_ARMS_SQL}, {_SAVED_SQL}, t AS (SELECT arm, arm_pos, avg(saving) AS m FROM saved GROUP BY arm, arm_pos) SELECT concat('| arm | mean |', chr(10), '|---|---|', chr(10), string_agg(concat('| ', CASE arm WHEN 'short' THEN 'Short answers' ELSE arm END, ' | ', {_PCT}, ' |'), chr(10) ORDER BY arm_pos)) AS report FROM t")
def markdown_table(spark, d):
    means = experiments.distribution(_saved(spark, d), ["arm", "arm_pos"], "saving")
    row = formatting.rows(formatting.label(F.col("arm"), {"short": "Short answers"}), formatting.signed_percent(F.col("mean")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("arm_pos", row.alias("row")))), lambda x: x["row"])
    return means.agg(formatting.table(lines, ["arm", "mean"]).alias("report"))


@query("SELECT doc_id, o AS before, c AS after, CASE WHEN o > 0 THEN round(100.0 * (o - c) / o, 9) ELSE 0 END AS pct FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::BIGINT AS o, length(text)::BIGINT // 12 AS c FROM documents)")
def file_pairs(spark, d):
    pairs = A.table(spark, d, "documents").select("doc_id", markdown.words(F.col("text")).alias("before"), F.expr("length(text) div 12").alias("after"))
    return experiments.file_pairs(pairs).withColumn("pct", F.round("pct", 9))


@query("SELECT count(*) * 2 * 3 AS calls FROM benchmark")
def call_count(spark, d):
    return experiments.calls(A.table(spark, d, "benchmark"), 2, 3)


@query("SELECT item_id, CASE WHEN length(text) > 80 THEN concat(left(text, 80), '...') ELSE text END AS preview, CASE WHEN length(text) >= 90 THEN text ELSE rpad(text, 90, ' ') END AS padded FROM benchmark")
def previews(spark, d):
    return A.table(spark, d, "benchmark").select("item_id", formatting.preview(F.col("text")).alias("preview"), formatting.pad_right(F.col("text"), 90).alias("padded"))


@query("SELECT l_orderkey, l_linenumber, floor(x + 0.5)::BIGINT AS half_up, round_even(x, 0)::BIGINT AS half_even, CASE WHEN l_quantity <> 0 THEN l_discount / l_quantity ELSE 0 END AS share, abs(l_quantity - l_tax * 100) / l_quantity > 0.15 AS drifts FROM (SELECT *, (l_quantity - 25) / 2 AS x FROM lineitem)")
def roundings(spark, d):
    x = (F.col("l_quantity") - 25) / 2
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rounding.half_up(x).alias("half_up"), rounding.half_even(x).cast("long").alias("half_even"), rounding.ratio(F.col("l_discount"), F.col("l_quantity")).alias("share"), (rounding.relative_change(F.col("l_quantity"), F.col("l_tax") * 100) > 0.15).alias("drifts"))


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY n_name, r_name")
def relational_semi(spark, d):
    t = lambda n: A.table(spark, d, n)
    buyers = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    joined = buyers.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
