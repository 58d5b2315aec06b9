"""White space of all scripts: trimmed at both ends, and blank tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space.
SPACES = " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def blank(text: Column) -> Column:
    return stripped(text) == ""
