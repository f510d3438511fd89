"""Seeded randomness as a pure function of a row key.

No ``rand()`` anywhere: a retried task must draw the same numbers, and a SQL
engine must be able to draw them too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: int | str, *cols: Column) -> Column:
    """32 hex digits that put rows into a seeded random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def uniform_of(digest: Column) -> Column:
    """Map a hex digest to [0, 1) by its first 13 digits.

    13 digits are 52 bits: exact in a double, and fine enough to address any
    row of a table of trillions.
    """
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform(seed: int | str, *cols: Column) -> Column:
    """A seeded uniform number in [0, 1) for each row key."""
    return uniform_of(hash_order(seed, *cols))
