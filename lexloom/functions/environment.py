"""What comes from an environment: flags, field lists, folders by platform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def switched_on(value: Column, default: bool) -> Column:
    """A flag's text: one that is on by default is off at "0" alone, one that is off by default is on at "1" alone."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("1")) != "0" if default else F.coalesce(value, F.lit("")) == "1"


def config_dir(name: str, windows: Column, home: Column, xdg: Column, appdata: Column) -> Column:
    """The folder of a program's settings: below the set configuration folder, else by platform below the home folder."""
    given = lambda c: F.nullif(c, F.lit(""))
    roaming = F.coalesce(given(appdata), F.concat(home, F.lit("/AppData/Roaming")))
    base = F.coalesce(given(xdg), F.when(windows, roaming).otherwise(F.concat(home, F.lit("/.config"))))
    return F.concat(base, F.lit(f"/{name}"))
