"""Structure of markdown texts as Columns: headings, fences, inline code, links, paths, bullets, front matter, markers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .spaces import blank, stripped

# The grammars of the extracted things. Possessive quantifiers and left bounds keep them linear in long texts.
HEADING = "(?md)^(#{1,6})\\s+(.*)"
URL = "https?://[^\\s)]+"
PATH = "(?:\\./|\\.\\./|/|[A-Za-z]:\\\\)[\\w\\-/\\\\\\.]++|(?<![\\w\\-\\.])[\\w\\-\\.]++[/\\\\][\\w\\-/\\\\\\.]++"
BULLET = "(?md)^[^\\S\\n]*+[-*+]\\s++"
INLINE = "`([^`]++)`"
FENCED = ("(?md)^```[\\s\\S]*?^```", "(?md)^~~~[\\s\\S]*?^~~~")
FRONT = "(?s)\\A(---\\r?\\n.*?\\r?\\n---\\r?\\n)(.*)"
WRAPPED = "(?s)\\A\\s*+(`{3,}+|~{3,}+)[^\\n]*+\\n(.*)\\n(`{3,}+|~{3,}+)\\s*+\\z"
_FENCE = re.compile(r"[ \t\r\f\v]{0,3}(`{3,}|~{3,})(.*)")
_INDENT, _BLANK = "[ \\t\\r\\f\\x0B]{0,3}+", "[ \\t\\r\\f\\x0B\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]*+"
_CLOSED = "|".join(f"({c}{{3,}}+)[^\\n]*+[\\s\\S]*?\\n{_INDENT}\\{k}{c}*+{_BLANK}(?=\\n|\\z)" for k, c in ((2, "`"), (3, "~")))
#: A closed block as group 1; or a fence that never closes, and the rest, without that group.
BLOCK = f"(?md)^({_INDENT}(?:{_CLOSED}))|^{_INDENT}(?:```|~~~)[\\s\\S]*+"


def unix_lines(text: Column) -> Column:
    """All line ends as one newline."""
    return F.regexp_replace(text, "\\r\\n?", "\n")


def words(text: Column) -> Column:
    """How many stretches of solid characters."""
    return F.size(F.filter(F.split(text, "\\s+"), lambda x: x != "")).cast("long")


def headings(text: Column) -> Column:
    """(level, title) in order; also lines that look like headings inside fences."""
    levels, titles = F.regexp_extract_all(text, F.lit(HEADING), 1), F.regexp_extract_all(text, F.lit(HEADING), 2)
    return F.zip_with(levels, titles, lambda a, b: F.struct(a.alias("level"), stripped(b).alias("title")))


def urls(text: Column) -> Column:
    """Distinct addresses; closing punctuation belongs to them."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(URL), 0))


def paths(text: Column) -> Column:
    """Distinct path-like tokens; letters of all scripts count."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + PATH), 0))


def bullets(text: Column) -> Column:
    return F.regexp_count(text, F.lit(BULLET)).cast("long")


def inline_codes(text: Column) -> Column:
    """All stretches between single back quotes outside fences, in order, repeats kept."""
    for fence in FENCED:
        text = F.regexp_replace(text, fence, "")
    return F.regexp_extract_all(text, F.lit(INLINE), 1)


def fenced_blocks(text: str | None) -> list[str] | None:
    """The fenced blocks of a text. A fence closes at the same character, no fewer of them, and nothing behind; inner
    fences that are shorter or other stay inside; a fence that never closes drops the rest."""
    if text is None:
        return None
    out: list[str] = []
    block: list[str] = []
    mark = ""
    for line in text.split("\n"):
        found = _FENCE.fullmatch(line)
        if not mark:
            if found:
                mark, block = found[1], [line]
            continue
        block.append(line)
        if found and found[1][0] == mark[0] and len(found[1]) >= len(mark) and not found[2].strip():
            out.append("\n".join(block))
            mark = ""
    return out


def code_blocks(text: Column) -> Column:
    """``fenced_blocks`` as an expression, so that rows need not pass through Python."""
    return F.filter(F.regexp_extract_all(text, F.lit(BLOCK), 1), lambda block: block != "")


def front_matter(text: Column) -> Column:
    """(front, body): the block between --- lines at the start, or an empty one."""
    front = F.regexp_extract(text, FRONT, 1)
    return F.struct(front.alias("front"), F.when(front != "", F.regexp_extract(text, FRONT, 2)).otherwise(text).alias("body"))


# How other readers of front matter find its ends.
LOOSE = "(?s)\\A---\\r?\\n((?:.*?\\n)??)---\\s*(?:\\r?\\n|\\z)(.*)\\z"
PLAIN = "(?s)\\A---.*?---\\s*"
INNER = "(?s)\\A---\\n(.*?)(\\n---.*)\\z"


def front_matter_loose(text: Column) -> Column:
    """(front, body): the lines between the fences only; the closing one may have blanks and blank lines behind it."""
    found = text.rlike(LOOSE)
    return F.struct(F.when(found, F.regexp_extract(text, LOOSE, 1)).otherwise("").alias("front"), F.when(found, F.regexp_extract(text, LOOSE, 2)).otherwise(text).alias("body"))


def body_only(text: Column) -> Column:
    """Without front matter up to the first three hyphens, wherever these stand, and the white space behind."""
    return F.regexp_replace(text, PLAIN, "")


def without_key_inside(text: Column, key: str) -> Column:
    """A whole text whose front matter (up to the first line that begins with three hyphens) loses a key and its
    indented lines; without front matter the text as it is."""
    lines = F.regexp_replace(F.concat(F.lit("\n"), F.regexp_extract(text, INNER, 1)), f"\\n{key}[ \\t]*+:[^\\n]*+(?:\\n[ \\t][^\\n]*+)*+", "")
    return F.when(text.rlike(INNER), F.concat(F.lit("---\n"), F.substring(lines, F.lit(2), F.length(lines)), F.regexp_extract(text, INNER, 2))).otherwise(text)


def unwrapped(text: Column) -> Column:
    """Without a fence that wraps the whole text; the closing fence may be shorter than the opening one."""
    first, last = F.regexp_extract(text, WRAPPED, 1), F.regexp_extract(text, WRAPPED, 3)
    return F.when(text.rlike(WRAPPED) & first.startswith(last), F.regexp_extract(text, WRAPPED, 2)).otherwise(text)


def without_key(front: Column, key: str) -> Column:
    """Front matter without a key and its indented continuation lines."""
    return F.regexp_replace(front, f"(?m)^{key}[ \\t]*+:.*+(?:\\n[ \\t].*+)*+\\n?", "")


def with_keys(front_body: Column, keys: dict[str, str]) -> Column:
    """Front matter lines with the keys that are missing added in front."""
    added = [F.when(~front_body.rlike(f"(?m)^{k}\\s*:"), F.lit(f"{k}: {v}")) for k, v in keys.items()]
    return F.concat_ws("\n", *added, F.when(front_body != "", front_body))


def with_block(text: Column, begin: str, end: str, block: str) -> Column:
    """A marked block appended after one blank line, unless it is there."""
    text = F.coalesce(text, F.lit(""))
    gap = F.when((text == "") | text.endswith("\n\n"), "").when(text.endswith("\n"), "\n").otherwise("\n\n")
    return F.when(text.contains(begin) & text.contains(end), text).otherwise(F.concat(text, gap, F.lit(f"{begin}\n{block}\n{end}\n")))


def without_block(text: Column, begin: str, end: str) -> Column:
    """The marked block cut out, with the line ends around it made one; null if nothing else is left."""
    a, b = F.instr(text, begin), F.instr(text, end)
    before = F.regexp_replace(F.substring(text, F.lit(1), a - 1), "\\n+$", "")
    after = F.regexp_replace(F.substring(text, b + len(end), F.length(text)), "^\\n+", "")
    joined = F.when(before == "", after).when(after == "", F.concat(before, F.lit("\n"))).otherwise(F.concat(before, F.lit("\n\n"), after))
    cut = F.when((a > 0) & (b > a), joined).otherwise(text)
    return F.when(~blank(cut), cut)


def between(text: Column, begin: str, end: str, middle: Column) -> Column:
    """What stands between two markers replaced; null if a marker is missing."""
    a, b = F.instr(text, begin), F.instr(text, end)
    return F.when((a > 0) & (b > a), F.concat(F.substring(text, F.lit(1), a + len(begin) - 1), F.lit("\n"), middle, F.lit("\n"), F.substring(text, b, F.length(text))))


def for_level(body: Column, level: str) -> Column:
    """Table rows and examples of other levels dropped."""

    def keep(line: Column) -> Column:
        row, example = F.regexp_extract(line, "^\\|\\s*\\*\\*(\\S+?)\\*\\*\\s*\\|", 1), F.regexp_extract(line, "^- (\\S+?):\\s", 1)
        return ((row == "") | (row == level)) & ((example == "") | (example == level))

    return F.array_join(F.filter(F.split(body, "\n"), keep), "\n")


def rule_plan(exists: Column, has_mark: Column, appends: Column, force: Column) -> Column:
    return F.when(~exists, "added").when(has_mark, "skipped-already-installed").when(appends, "appended").when(force, "overwritten").otherwise("skipped-exists")


def description(text: str | None) -> str | None:
    """The description of a front matter: one line, or a folded or literal block that ends where the indent does."""
    lines = (text or "").split("\n")
    if not lines or lines[0].strip() != "---":
        return None
    for i, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            return None
        if not line.startswith("description:"):
            continue
        value = line[len("description:") :].strip()
        if value[:1] not in (">", "|"):
            return value.strip("\"'")
        block = []
        for follow in lines[i + 1 :]:
            if follow.strip() == "---" or (follow.strip() and not follow.startswith((" ", "\t"))):
                break
            block.append(follow.strip())
        return (" " if value[0] == ">" else "\n").join(block).strip()
    return None


@F.pandas_udf(StringType())
def described(texts: pd.Series) -> pd.Series:
    return texts.map(description)
