"""String helpers that reproduce Python string semantics with JVM-side Spark
expressions (no Python UDF).

Python's ``str.strip()`` removes every character for which ``isspace()`` is
true; Spark's ``trim`` removes only blanks, and ``\\s`` differs between Java
and RE2.  The explicit class below is written with ``\\x{..}`` escapes, a
syntax both Java regex and RE2 (DuckDB) accept, so the oracle can use the very
same pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts.
PY_SPACE_CLASS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
STRIP_PATTERN = r"\A" + PY_SPACE_CLASS + r"+|" + PY_SPACE_CLASS + r"+\z"
RSTRIP_PATTERN = PY_SPACE_CLASS + r"+\z"
TRAILING_SPACE_PATTERN = r"(" + PY_SPACE_CLASS + r"*)\z"


def py_strip(col: Column | str) -> Column:
    """``str.strip()`` of a string column; NULL stays NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, STRIP_PATTERN, "")


def py_rstrip(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, RSTRIP_PATTERN, "")


def trailing_space(col: Column | str) -> Column:
    """The run of trailing whitespace of a string ('' when none)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(c, TRAILING_SPACE_PATTERN, 1)


def md5_of_ids(col: Column | str) -> Column:
    """Stable scalar digest of an integer array, for oracle comparison."""
    c = F.col(col) if isinstance(col, str) else col
    return F.md5(F.array_join(c, ","))


def checksum32(col: Column) -> Column:
    """Order-insensitive partial checksum: first 32 bits of md5 as BIGINT.

    Summing these per group gives a digest that survives any partitioning.
    """
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("bigint")
