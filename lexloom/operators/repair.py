"""Validate, repair once, validate again: two rounds in all, then the original stays."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical
from ..functions.validation import ERRORS, facts, facts_of, said


def rewriter(call: Callable[[str], str], retries: int = 3, delay: float = 5.0):
    """A rewriting function (a language model's client, say) as a Column function; retried with doubling delays."""

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        import time

        def one(text):
            for turn in range(retries + 1):
                try:
                    return None if text is None else call(text)
                except ConnectionError:
                    if turn == retries:
                        raise
                    time.sleep(delay * 2**turn)

        return texts.map(one)

    return rewrite


def repaired(pairs: DataFrame, fix: Callable[[Column], Column] = lexical.compressed) -> DataFrame:
    """(id, text, outcome): accepted at once, repaired (``fix`` of the original passes), or restored to the original.

    One pass: no text's facts are found twice. Rows that pass go to ``fix`` as null, and there is nothing to find in a null;
    a filter instead would be pushed below the facts, and find them anew for each of its conditions.
    """
    names = tuple(n for n, _ in ERRORS)
    first = facts(pairs.select("id", "original", "compressed"), names=names).withColumn("__good", F.size(said(ERRORS)) == 0)
    failed = lambda c: F.when(~F.col("__good"), c)
    fixed = first.withColumn("__fixed", failed(fix(failed(F.col("original")))))
    again = facts_of(fixed, {"c": "__fixed"}, names).withColumn("__fine", F.size(said(ERRORS, "a", "c")) == 0)
    way = lambda good, fine, left: F.when(F.col("__good"), good).when(F.col("__fine"), fine).otherwise(left)
    return again.select("id", way(F.col("compressed"), F.col("__fixed"), F.col("original")).alias("text"), way(F.lit("accepted"), F.lit("repaired"), F.lit("restored")).alias("outcome"))


def fix_prompt(original: Column, compressed: Column, errors: Column) -> Column:
    """What a rewriting model is told when its text failed."""
    bullets = F.array_join(F.transform(errors, lambda e: F.concat(F.lit("- "), e)), "\n")
    return F.concat(F.lit("Repair the compressed text so that these errors go, changing nothing else.\n\nErrors:\n"), bullets, F.lit("\n\nOriginal:\n"), original, F.lit("\n\nCompressed:\n"), compressed)


def arm_prompt(prefix: Column, skill: Column) -> Column:
    return F.concat_ws("\n\n", prefix, F.nullif(skill, F.lit("")))
