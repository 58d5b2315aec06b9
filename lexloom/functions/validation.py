"""Whether a compressed text kept what it had to keep: errors and warnings of a pair of texts.

The rules work on what ``facts`` extracts, each fact a column of its own, so that no text is searched twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import markdown
from .rounding import relative_change

# The drift that bullets may have, and the messages.
BULLET_DRIFT = 0.15
HEADING_COUNT, HEADING_CHANGED = "Heading count mismatch: ", "Heading text/order changed"
BLOCKS_CHANGED = "Code blocks not preserved exactly"
MISMATCH = " mismatch: lost="
BULLETS_CHANGED = "Bullet count changed too much: "
CODES_LOST, CODES_ADDED = "Inline code lost: ", "Inline code added: "

#: What is compared, and how it is found in a text.
FACTS = {"headings": markdown.headings, "blocks": markdown.code_blocks, "urls": markdown.urls, "paths": markdown.paths, "bullets": markdown.bullets, "codes": markdown.inline_codes}


def facts_of(rows: DataFrame, texts: dict[str, str], names: tuple[str, ...] = tuple(FACTS)) -> DataFrame:
    """Adds the facts of texts (line ends made one) as columns <side>_<fact>; ``texts`` has the column of each side."""
    lines = rows.withColumns({f"__{side}": markdown.unix_lines(F.col(c)) for side, c in texts.items()})
    return lines.withColumns({f"{side}_{n}": FACTS[n](F.col(f"__{side}")) for n in names for side in texts}).drop(*(f"__{side}" for side in texts))


def facts(pairs: DataFrame, original: str = "original", compressed: str = "compressed", names: tuple[str, ...] = tuple(FACTS)) -> DataFrame:
    """Adds the facts of both texts as columns a_<fact> and b_<fact>."""
    return facts_of(pairs, {"a": original, "b": compressed}, names)


def _listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.array_sort(items), ", "), F.lit("]"))


def difference(a: Column, b: Column) -> tuple[Column, Column]:
    """(lost, added) of two sets."""
    return F.array_except(a, b), F.array_except(b, a)


def heading_error(a: Column, b: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.concat(F.lit(HEADING_COUNT), F.size(a).cast("string"), F.lit(" vs "), F.size(b).cast("string")))


def heading_warning(a: Column, b: Column) -> Column:
    return F.when(a != b, HEADING_CHANGED)


def block_error(a: Column, b: Column) -> Column:
    return F.when(a != b, BLOCKS_CHANGED)


def _set_report(what: str, a: Column, b: Column) -> Column:
    lost, added = difference(a, b)
    return F.when((F.size(lost) > 0) | (F.size(added) > 0), F.concat(F.lit(what + MISMATCH), _listed(lost), F.lit(", added="), _listed(added)))


def url_error(a: Column, b: Column) -> Column:
    return _set_report("URL", a, b)


def path_warning(a: Column, b: Column) -> Column:
    return _set_report("Path", a, b)


def bullet_warning(a: Column, b: Column) -> Column:
    return F.when(relative_change(a, b) > BULLET_DRIFT, F.concat(F.lit(BULLETS_CHANGED), a.cast("string"), F.lit(" -> "), b.cast("string")))


def _count(codes: Column, code: Column) -> Column:
    return F.size(F.filter(codes, lambda x: x == code))


def inline_lost(a: Column, b: Column) -> Column:
    """Codes that are gone, and codes that occur less often, with how many times."""
    counts = F.transform(F.array_intersect(a, b), lambda c: F.struct(c.alias("code"), _count(a, c).alias("before"), _count(b, c).alias("after")))
    fewer = F.transform(
        F.filter(counts, lambda x: x["after"] < x["before"]),
        lambda x: F.concat(x["code"], F.lit(" (lost "), (x["before"] - x["after"]).cast("string"), F.lit(" of "), x["before"].cast("string"), F.lit(" occurrences)")),
    )
    return F.concat(F.array_except(a, b), fewer)


def inline_error(a: Column, b: Column) -> Column:
    lost = inline_lost(a, b)
    return F.when(F.size(lost) > 0, F.concat(F.lit(CODES_LOST), _listed(lost)))


def inline_warning(a: Column, b: Column) -> Column:
    added = F.array_except(b, a)
    return F.when(F.size(added) > 0, F.concat(F.lit(CODES_ADDED), _listed(added)))


#: The rules in their order: the fact they compare.
ERRORS = (("headings", heading_error), ("blocks", block_error), ("urls", url_error), ("codes", inline_error))
WARNINGS = (("headings", heading_warning), ("paths", path_warning), ("bullets", bullet_warning), ("codes", inline_warning))


def said(rules, a: str = "a", b: str = "b") -> Column:
    """What rules find between the facts of two sides."""
    return F.array_compact(F.array(*(rule(F.col(f"{a}_{n}"), F.col(f"{b}_{n}")) for n, rule in rules)))


def judged(pairs: DataFrame, original: str = "original", compressed: str = "compressed") -> DataFrame:
    """Adds is_valid, errors and warnings of pairs of texts."""
    found = facts(pairs, original, compressed)
    out = found.withColumns({"errors": said(ERRORS), "warnings": said(WARNINGS)})
    return out.select(*pairs.columns, (F.size("errors") == 0).alias("is_valid"), "errors", "warnings")
