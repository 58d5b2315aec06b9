"""Prose compression by rules: droppable words go, protected spans stay as they are, in one pass of one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and phrase rules.
ARTICLES = ("a", "an", "the")
FILLER = ("just", "really", "basically", "actually", "simply", "essentially", "generally")
PLEASANTRIES = ("sure", "certainly", "of course", "happy to", "i'd recommend", "please")
HEDGES = ("it might be worth", "you could consider", "it would be good to", "perhaps", "maybe")
LEADERS = ("i will", "i'll")
CONNECTIVES = ("in addition", "however", "furthermore", "additionally")
PHRASES = (("in order to", "to"), ("make sure to", "ensure"), ("the reason is because", "because"))
#: What stays as it is. ``{p}`` makes a quantifier possessive, ``{b}`` and ``{a}`` are bounds of words, ``{l}`` is the left
#: bound of a path: with them a match takes time in proportion to the text, whatever it holds.
PROTECTED = (
    "```[\\s\\S]*?```",
    "~~~[\\s\\S]*?~~~",
    "`[^`]+{p}`",
    "https?://[^\\s)]+{p}",
    "[A-Za-z]:\\\\[\\w\\-/\\\\.]+{p}",
    "{l}[\\w\\-.~]*{p}/[\\w\\-/.]+{p}",
    "{b}[A-Z][A-Z0-9]*{p}(?:_[A-Z0-9]+{p})+{p}{a}",
    "{b}\\w+{p}(?:\\.\\w+{p})+{p}\\(?\\)?",
)


def droppable() -> str:
    phrases = sorted((*HEDGES, *PLEASANTRIES, *LEADERS, *FILLER, *ARTICLES), key=lambda x: (-len(x), x))
    return "|".join(phrases)


def pattern(backtracks: bool) -> str:
    """Protected spans as group 1, or a droppable phrase with a comma and the blanks behind it.

    Two dialects of one expression: for engines that backtrack, with possessive quantifiers and look-arounds (word bounds
    are ASCII); for automata, which need neither, with plain bounds.
    """
    marks = {"p": "+", "b": "(?<!\\w)", "a": "(?!\\w)", "l": "(?<![\\w\\-.~])"} if backtracks else {"p": "", "b": "\\b", "a": "\\b", "l": ""}
    protected = "|".join(PROTECTED)
    for name, mark in marks.items():
        protected = protected.replace("{" + name + "}", mark)
    return f"({protected})|(?i:{marks['b']}(?:{droppable()}){marks['a']},?[ \\t]*)"


def compressed(text: Column) -> Column:
    return F.regexp_replace(text, pattern(True), "$1")


def report(text: Column) -> Column:
    """(compressed, before, after) with lengths in characters; null stays null, with lengths 0."""
    small = compressed(text)
    return F.struct(small.alias("compressed"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("before"), F.coalesce(F.length(small), F.lit(0)).cast("long").alias("after"))


def rephrased(text: Column) -> Column:
    """Wordy phrases replaced, connectives dropped."""
    for phrase, short in PHRASES:
        text = F.regexp_replace(text, f"(?i)(?<!\\w){phrase}(?!\\w)", short)
    return F.regexp_replace(text, f"(?i)(?<!\\w)(?:{'|'.join(CONNECTIVES)})(?!\\w),?[ \\t]*", "")
