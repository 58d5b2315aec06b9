"""DuckDB statements for the queries of this subpackage that SQL can express."""

from . import mixing

ORACLES: dict[str, str] = {"op4_mixing": mixing.oracle()}
