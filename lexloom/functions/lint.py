"""Checks of terse outputs: commit subjects, review lines, locator lines; shell-like tokens and path helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commit types, limits, and verb forms that are not imperative.
TYPES = ("feat", "fix", "refactor", "perf", "docs", "test", "chore", "build", "ci", "style", "revert")
SUBJECT = "^(" + "|".join(TYPES) + ")(\\([^)]+\\))?!?: (.+)$"
REVIEW = "^([^:]+):(\\d+): (\\S+) ([a-z]+): ([^.]*)\\. (.*)\\.$"
LOCATOR = "^([^:]+):([0-9-]+) — `([^`]+)` — (.+)$"
TOKEN = "\"([^\"]*)\"|'([^']*)'|(\\S+)"


def commit_violations(subject: Column) -> Column:
    """What a commit subject breaks, as an array."""
    summary = F.regexp_extract(subject, SUBJECT, 3)
    rules = [
        (~subject.rlike(SUBJECT), "type"),
        (F.length(subject) > 72, "over 72"),
        ((F.length(subject) > 50) & (F.length(subject) <= 72), "over 50"),
        (subject.endswith("."), "period"),
        (summary.rlike("^[A-Za-z]+(ed|ing) "), "mood"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in rules)))


def review_line(line: Column) -> Column:
    part = lambda i: F.regexp_extract(line, REVIEW, i)
    return F.struct(part(1).alias("path"), part(2).try_cast("int").alias("line"), part(3).alias("mark"), part(4).alias("severity"), part(5).alias("problem"), part(6).alias("fix"))


def locator_line(line: Column) -> Column:
    part = lambda i: F.regexp_extract(line, LOCATOR, i)
    return F.struct(part(1).alias("path"), part(2).alias("lines"), part(3).alias("symbol"), part(4).alias("note"))


def shell_tokens(command: Column) -> Column:
    """Words, with quoted ones whole."""
    part = lambda i: F.regexp_extract_all(command, F.lit(TOKEN), i)
    return F.zip_with(F.zip_with(part(1), part(2), lambda a, b: F.concat(a, b)), part(3), lambda a, b: F.concat(a, b))


def absolute_node(command: Column, node: str, managed: tuple[str, ...]) -> Column:
    """A bare "node script" of ours gets the full path of the program."""
    script = F.regexp_extract(command, "^node\\s+(\\S+)\\s*$", 1)
    ours = F.element_at(F.split(script, "/"), -1).isin(*managed)
    return F.when((script != "") & ours, F.concat(F.lit(f'"{node}" "'), script, F.lit('"'))).otherwise(command)


def expanded(path: Column, home: str) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "\\$HOME", home), "^~(?=/|$)", home)


def plain_description(text: Column) -> Column:
    """Whether a description is free of angle brackets."""
    return ~text.rlike("[<>]")
