"""Lookups: nearest ancestor, configuration layers, manifests, mirrors, orphans, detection rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import commands, lint
from ..functions.spaces import stripped

#: Levels that a search for a configuration walks up at most, and its file names in order.
DEPTH = 64
FILES = (".terse/config.json", ".terse.json")


def ancestors(path: Column) -> Column:
    """(dir, depth) of a path and its parents, nearest first."""
    parts = F.split(path, "/")
    n = F.least(F.size(parts), F.lit(DEPTH))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda d: F.struct(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - d), "/").alias("dir"), d.alias("depth")))


def nearest(paths: DataFrame, configs: DataFrame, path: str = "cwd") -> DataFrame:
    """For each path the value of the closest folder that has a file; in one folder the first file name wins.

    An equality join on the parents' names, then one aggregate with partial results.
    """
    rank = F.array_position(F.array(*(F.lit(f) for f in FILES)), F.col("file"))
    keys = paths.select(path).distinct().withColumn("a", F.explode(ancestors(F.col(path)))).select(path, F.col("a.dir").alias("dir"), F.col("a.depth").alias("depth"))
    found = keys.join(configs, "dir").groupBy(path).agg(F.min_by(F.struct("dir", "file", "value"), F.struct("depth", rank)).alias("hit"))
    return paths.join(found, path, "left").select(*paths.columns, "hit.dir", "hit.file", "hit.value")


def default_mode(env: Column, repo: Column, user: Column, fallback: str = "full") -> Column:
    """The first valid of the layers; an invalid nearest repository value does not send the search further up."""
    return F.coalesce(commands.valid(env), commands.valid(repo), commands.valid(user), F.lit(fallback))


def manifest(lines: DataFrame, column: str = "value", order: str = "line_no") -> DataFrame:
    """(name, sha256) from "hash  name" lines; of a repeated name the last counts."""
    pattern = "^([0-9a-fA-F]{64})\\s+\\*?(.+)$"
    part = lambda i: F.regexp_extract(column, pattern, i)
    rows = lines.where(F.col(column).rlike(pattern)).select(F.element_at(F.split(stripped(part(2)), "/"), -1).alias("name"), F.lower(part(1)).alias("sha256"), order)
    return rows.groupBy("name").agg(F.max_by("sha256", order).alias("sha256"))


def verify(files: DataFrame, expected: DataFrame) -> DataFrame:
    """ok, mismatch or missing for each file (name, content)."""
    got = files.select("name", F.sha2(F.col("content").cast("binary"), 256).alias("got"))
    status = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("got"), "ok").otherwise("mismatch")
    return got.join(expected, "name", "left").select("name", status.alias("status"))


def mirror_differences(source: DataFrame, copy: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs, or that only one side has."""
    a, b = source.select(key, F.col(value).alias("a")), copy.select(key, F.col(value).alias("b"))
    return a.join(b, key, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(key, F.when(F.col("a").isNull(), "only copy").when(F.col("b").isNull(), "only source").otherwise("differs").alias("status"))


def orphans(commands_: DataFrame, files: DataFrame, managed: tuple[str, ...]) -> DataFrame:
    """Commands that name a script of ours that is not among the files."""
    tokens = commands_.withColumn("script", F.explode(lint.shell_tokens(F.col("command"))))
    ours = tokens.where(F.element_at(F.split("script", "/"), -1).isin(*managed))
    return ours.join(files.select(F.col("path").alias("script")), "script", "left_anti")


def clauses(spec: Column) -> Column:
    """(kind, value) of the alternatives of a detection rule."""
    parts = F.filter(F.transform(F.split(spec, "\\|\\|"), lambda x: stripped(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "^([^:]*)", 1).alias("kind"), F.regexp_replace(F.regexp_extract(x, "^[^:]*:(.*)$", 1), "^~(?=/|$)", "\\$HOME").alias("value")))


def detected(providers: DataFrame, facts: DataFrame, chosen: tuple[str, ...] = ()) -> DataFrame:
    """Providers in table order of which a clause is a fact; those chosen by name need none, soft ones must be chosen."""
    rules = providers.select("id", F.explode(clauses(F.col("detect"))).alias("c")).select("id", "c.kind", "c.value")
    hits = rules.join(facts, ["kind", "value"], "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    named = F.col("id").isin(*chosen) if chosen else F.lit(False)
    wanted = named | (F.coalesce("hit", F.lit(False)) & ~F.coalesce("soft", F.lit(False)) & F.lit(not chosen))
    return providers.join(hits, "id", "left").where(wanted).drop("hit")


def missing_siblings(originals: DataFrame, copies: DataFrame, keys: list[str]) -> DataFrame:
    """Originals without a copy: each is a failure of its own."""
    return originals.join(copies.select(*keys), keys, "left_anti")


def findings(lines: DataFrame, column: str = "value") -> DataFrame:
    """Review lines parsed, sorted by file and then by line; others go."""
    rows = lines.select(lint.review_line(F.col(column)).alias("r")).select("r.*").where("severity <> ''")
    return rows.orderBy("path", "line")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The existing rows, and those new ones whose key is not there yet."""
    return existing.unionByName(new.dropDuplicates([key]).join(existing.select(key), key, "left_anti"))


def selected(rows: DataFrame, choice: str, order: str = "ord") -> DataFrame:
    """The rows that a choice like "1,3" names by their place in the list, counted from 1."""
    places = [int(x) for x in choice.replace(" ", "").split(",") if x.isdigit()]
    return rows.where((F.col(order) + 1).isin(places)) if places else rows.limit(0)


def with_description(skills: DataFrame, text: str = "text") -> DataFrame:
    """Adds the front matter's description and whether it is free of angle brackets."""
    from ..functions.markdown import described

    return skills.withColumn("description", described(F.col(text))).withColumn("plain", lint.plain_description(F.col("description")))
