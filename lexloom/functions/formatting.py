"""Text for people: short numbers, money, percentages, labels, reports, tables.

Decimals are rounded half up on the shown digit, by integer arithmetic, so that every engine shows the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import half_up

RULE = "─" * 34


def fixed(x: Column, digits: int) -> Column:
    """A non-negative number with so many decimals."""
    unit = 10**digits
    scaled = half_up(x * F.lit(float(unit)))
    return F.concat(F.floor(scaled / unit).cast("string"), F.lit("."), F.lpad((scaled % unit).cast("string"), digits, "0"))


def humanize(n: Column) -> Column:
    """0, 999, 1.5k, 2.3M."""
    x = n.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x <= 0), "0").when(x >= 1e6, F.concat(fixed(x / 1e6, 1), F.lit("M"))).when(x >= 1e3, F.concat(fixed(x / 1e3, 1), F.lit("k"))).otherwise(half_up(x).cast("string"))


def usd(x: Column) -> Column:
    """Two decimals from a dollar on, three from a cent on, else four."""
    return F.concat(F.lit("$"), F.when(x >= 1, fixed(x, 2)).when(x >= 0.01, fixed(x, 3)).otherwise(fixed(x, 4)))


def thousands(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def signed_percent(x: Column) -> Column:
    """+12% or −12% (a true minus), whole percents, halves to even."""
    return F.concat(F.when(x < 0, "−").otherwise("+"), F.bround(F.abs(x) * 100).cast("long").cast("string"), F.lit("%"))


def label(key: Column, names: dict[str, str]) -> Column:
    """The name of a key, or the key itself."""
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), key)


def preview(text: Column, length: int = 80) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def tail_of_path(path: Column, length: int = 45) -> Column:
    return F.when(F.length(path) > length, F.concat(F.lit("..."), F.substring(path, -length, length))).otherwise(F.coalesce(path, F.lit("")))


def pad_right(text: Column, width: int) -> Column:
    """Padded, never cut."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def display_mode(mode: Column) -> Column:
    return F.when(mode == "wenyan", "wenyan-full").otherwise(mode)


def badge(mode: Column, word: str) -> Column:
    """[WORD] for the full mode or none, else [WORD:MODE]."""
    clean = F.regexp_replace(F.lower(F.substring(F.coalesce(mode, F.lit("")), 1, 64)), "[^a-z0-9-]", "")
    plain = f"[{word.upper()}]"
    return F.when((clean == "") | (clean == "full"), plain).otherwise(F.concat(F.lit(f"[{word.upper()}:"), F.upper(clean), F.lit("]")))


def without_controls(text: Column, limit: int = 64) -> Column:
    """Bytes 0x00 to 0x1F gone, then cut."""
    return F.substring(F.regexp_replace(text, "[\\x00-\\x1F]", ""), 1, limit)


def rows(*cells: Column) -> Column:
    """A row of a markdown table."""
    return F.concat(F.lit("| "), reduce(lambda a, b: F.concat(a, F.lit(" | "), b), cells), F.lit(" |"))


def table(lines: Column, header: list[str]) -> Column:
    """A markdown table from an ordered array of rows."""
    head = "| " + " | ".join(header) + " |\n|" + "---|" * len(header)
    return F.concat(F.lit(head + "\n"), F.array_join(lines, "\n"))


def lifetime_report(sessions: Column, tokens: Column, saved: Column, dollars: Column, window: Column) -> Column:
    title = F.concat(F.lit("\nStats — Lifetime"), F.when(F.coalesce(window, F.lit("")) != "", F.concat(F.lit(" (last "), window, F.lit(")"))).otherwise(""), F.lit(f"\n{RULE}\n"))
    money = F.when(dollars > 0, F.concat(F.lit("Est. saved (USD):      ~"), usd(dollars), F.lit("\n"))).otherwise("")
    body = F.concat(F.lit("Sessions:   "), thousands(sessions), F.lit(f"\n{RULE}\nOutput tokens:         "), thousands(tokens), F.lit("\nEst. tokens saved:     "), thousands(saved), F.lit("\n"), money, F.lit(f"{RULE}\n"))
    return F.concat(title, F.when(sessions == 0, F.lit(f"No sessions logged yet\n{RULE}\n")).otherwise(body))


def share_line(tokens: Column, turns: Column, saved: Column, dollars: Column, has_ratio: Column) -> Column:
    money = F.when(dollars.isNotNull(), F.concat(F.lit(" (~"), usd(dollars), F.lit(")"))).otherwise("")
    known = F.concat(F.lit("Saved "), thousands(saved), F.lit(" output tokens"), money, F.lit(" across "), turns.cast("string"), F.lit(" turns this session"))
    return F.when(turns == 0, "no turns yet").when(has_ratio, known).otherwise(F.concat(turns.cast("string"), F.lit(" turns, "), thousands(tokens), F.lit(" output tokens this session")))


def session_report(path: Column, turns: Column, tokens: Column, cached: Column, mode: Column, ratio: Column, saved: Column, dollars: Column) -> Column:
    """Path, turns and tokens, then one of three savings blocks: by ratio, mode without data, inactive."""
    money = F.when(dollars.isNotNull(), F.concat(F.lit("\nEst. saved (USD):      ~"), usd(dollars))).otherwise("")
    known = F.concat(F.lit("Est. without:          "), thousands(tokens + saved), F.lit("\nEst. tokens saved:     "), thousands(saved), F.lit(" (~"), half_up(ratio * 100).cast("string"), F.lit("%)"), money)
    none = F.concat(F.lit("No savings estimate for '"), mode, F.lit("' mode"))
    block = F.when(ratio.isNotNull(), known).when(F.coalesce(mode, F.lit("off")) != "off", none).otherwise("Not active this session.")
    where = F.when(tail_of_path(path) != "", F.concat(F.lit("Session:  "), tail_of_path(path), F.lit("\n"))).otherwise("")
    whole = F.concat(F.lit(f"\nStats\n{RULE}\n"), where, F.lit("Turns:    "), turns.cast("string"), F.lit(f"\n{RULE}\nOutput tokens:         "), thousands(tokens), F.lit("\nCache-read tokens:     "), thousands(cached), F.lit(f"\n{RULE}\n"), block, F.lit("\n"))
    return F.when(turns == 0, F.lit(f"\nStats\n{RULE}\nNo conversation yet\n{RULE}\n")).otherwise(whole)


def utc_iso(ms: Column) -> Column:
    """Epoch milliseconds as an ISO instant (the session's zone is UTC)."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utc_stamp(ms: Column) -> Column:
    """Epoch milliseconds as part of a file name."""
    return F.date_format(F.timestamp_millis(ms), "yyyyMMdd_HHmmss")


def windows_quoted(text: Column) -> Column:
    """An argument for a Windows command line: quoted if it is empty or has spaces or quotes, with backslashes before a
    quote doubled."""
    doubled = F.regexp_replace(text, "\\\\(?=\\\\*+\"|\\z)", "\\\\\\\\")
    return F.when((text == "") | text.rlike("[\\s\"]"), F.concat(F.lit('"'), F.replace(doubled, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(text)


def shell_quoted(text: Column) -> Column:
    """In single quotes for a POSIX shell."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))
