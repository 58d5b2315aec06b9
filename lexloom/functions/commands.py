"""Mode commands in prompts, in two dialects, and the statistics command.

``word`` is the command's name: ``/word``, ``/word lite``, "activate word", "stop word" ...
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spaces import stripped

# The modes, and those with a behaviour of their own.
MODES = ("off", "lite", "full", "ultra", "wenyan-lite", "wenyan", "wenyan-full", "wenyan-ultra", "commit", "review", "compress")
INDEPENDENT = ("commit", "review", "compress")
OFF_WORDS = ("off", "stop", "disable")
WORD = "terse"
STARTS, STARTED = "activate|enable|turn on|start|talk like", "mode|activate|enable|turn on|start"
STOPS, BACK = "stop|disable|deactivate|turn off", "normal mode"
BRIEF = "less tokens|fewer tokens|be brief|be terse|shorter answers"


def valid(mode: Column) -> Column:
    """A stored mode: trimmed, lower case, at most 64 bytes, one of the known; else null."""
    clean = F.lower(stripped(mode))
    return F.when((F.octet_length(mode) <= 64) & clean.isin(*MODES), clean)


def emits(mode: Column) -> Column:
    """Whether the mode speaks up in a turn."""
    return mode.isNotNull() & (mode != "off") & ~mode.isin(*INDEPENDENT)


def _bounded(pattern: str) -> str:
    return f"(?<!\\w)(?:{pattern})(?!\\w)"


def _then(prompt: Column, first: str, then: str) -> Column:
    """Whether a line has one and, behind it, the other. Only the first of a line is tried: another would see less."""
    return prompt.rlike(f"(?m)^(?>.*?{_bounded(first)}).*{_bounded(then)}")


def _activates(prompt: Column, word: str) -> Column:
    return _then(prompt, STARTS, word) | _then(prompt, word, STARTED)


def _deactivates(prompt: Column, word: str) -> Column:
    return _then(prompt, STOPS, word) | _then(prompt, word, STOPS) | prompt.rlike(_bounded(BACK))


def _level(arg: Column, default: str, unknown: Column) -> Column:
    """The mode that an argument names; without one the default."""
    known = arg.isin(*(m for m in MODES if m not in (*INDEPENDENT, "off")))
    return F.when(arg == "", F.lit(default)).when(arg.isin(*OFF_WORDS), "off").when(arg == "wenyan-full", "wenyan").when(known, arg).otherwise(unknown)


def _slash(prompt: Column, word: str, default: str, namespaced: bool) -> Column:
    parts = F.split(prompt, "\\s+")
    cmd, arg = F.get(parts, 0), F.coalesce(F.get(parts, 1), F.lit(""))
    also = lambda name: F.lit(namespaced) & (cmd == f"/{word}:{name}")
    return (
        F.when(cmd == f"/{word}-commit", "commit")
        .when(cmd == f"/{word}-review", "review")
        .when((cmd == f"/{word}-compress") | also(f"{word}-compress"), "compress")
        .when((cmd == f"/{word}") | also(word), _level(arg, default, F.lit(None).cast("string")))
    )


def hook_command(prompt: Column, default: str = "full", word: str = WORD) -> Column:
    """Activation by phrases (also requests to be brief), then slash commands, then deactivation, the last that matches
    winning. Null leaves the mode alone. A default of off never activates."""
    p = F.lower(stripped(F.coalesce(prompt, F.lit(""))))
    brief = p.rlike(_bounded(BRIEF))
    stops = p.rlike(_bounded(STOPS))
    phrase = F.when((_activates(p, word) | brief) & ~stops & F.lit(default != "off"), F.lit(default))
    stats = p.rlike(f"^/{word}(?::{word})?-stats(?:\\s+.*)?$")
    slash = F.when(p.startswith(f"/{word}") & ~stats, _slash(p, word, default, True))
    return F.when(stats, phrase).when(_deactivates(p, word), "off").otherwise(F.coalesce(slash, phrase))


def plugin_command(prompt: Column, default: str = "full", word: str = WORD) -> Column:
    """Outer quotes off; deactivation first; then the template "activate word mode: X", phrases, slash commands."""
    p = stripped(F.coalesce(prompt, F.lit("")))
    p = F.lower(F.when(p.rlike("(?s)^([\"'`])(.*)\\1$"), stripped(F.regexp_extract(p, "(?s)^([\"'`])(.*)\\1$", 2))).otherwise(p))
    template = f"^activate {word} mode:[ \\t]*(\\S*)"
    return (
        F.when(p == "", F.lit(None).cast("string"))
        .when(_deactivates(p, word), "off")
        .when(p.rlike(template), _level(F.regexp_extract(p, template, 1), default, F.lit(default)))
        .when(_activates(p, word), F.lit(None if default == "off" else default).cast("string"))
        .when(p.startswith(f"/{word}"), _slash(p, word, default, False))
    )


def stats_command(prompt: Column, word: str = WORD) -> Column:
    """(is_stats, share, all, since) of the statistics command; since is the argument that follows the flag."""
    p = F.lower(stripped(F.coalesce(prompt, F.lit(""))))
    found = f"^/{word}(?::{word})?-stats(?:\\s+(.*))?$"
    is_stats = p.rlike(found)
    args = F.filter(F.split(F.coalesce(F.regexp_extract(p, found, 1), F.lit("")), "\\s+"), lambda x: x != "")
    at = F.array_position(args, F.lit("--since")).cast("int")
    since = F.when(is_stats & (at > 0), F.get(args, at))
    return F.struct(is_stats.alias("is_stats"), (is_stats & F.array_contains(args, "--share")).alias("share"), (is_stats & F.array_contains(args, "--all")).alias("all"), since.alias("since"))


def duration_ms(spec: Column) -> Column:
    """7d or 12h in milliseconds, anything else null."""
    n, unit = F.regexp_extract(spec, "^(\\d+)([dh])$", 1), F.regexp_extract(spec, "^(\\d+)([dh])$", 2)
    return F.when(unit != "", n.try_cast("long") * F.when(unit == "d", 86_400_000).otherwise(3_600_000))
