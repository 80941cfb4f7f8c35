"""Repeatable randomness from row keys.

Every random choice in the library is a function of (seed, keys): the hex MD5 of the
keys joined by ``|``. The first 13 hex digits read as an unsigned 52-bit integer and
divided by 2**52 give a uniform number in [0, 1): fine enough to reach every rank of a class
of 10**12 rows, and exact as a double. Results therefore do not depend on
partitioning, task order or retries, and any SQL engine with ``md5`` can recompute them
(see ``sql_uniform01``). Only integer and string keys should be hashed: the text form
of floating point numbers differs between engines.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values shared with the SQL oracle: key separator, hex digits of a uniform number, 16**digits.
KEY_SEPARATOR = "|"
UNIT_DIGITS = 13
UNIT_RANGE = 4503599627370496.0


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(seed: int | str, keys: Iterable[str | Column]) -> Column:
    """md5(seed|key1|key2|...) as 32 lowercase hex digits (nulls are skipped)."""
    parts = [F.lit(str(seed))] + [_as_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(KEY_SEPARATOR, *parts))


def unit_from_hex(h: Column) -> Column:
    """Uniform [0, 1) double from the first hex digits of a hash."""
    return F.conv(F.substring(h, 1, UNIT_DIGITS), 16, 10).cast("double") / F.lit(UNIT_RANGE)


def uniform01(seed: int | str, keys: Iterable[str | Column]) -> Column:
    return unit_from_hex(hash_hex(seed, keys))


def round_half_up(c: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same IEEE steps in every engine."""
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def sql_hash_hex(seed: int | str, keys: Iterable[str]) -> str:
    """The DuckDB / ANSI SQL text of ``hash_hex`` (for oracles and docs)."""
    parts = [f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys]
    return f"md5(concat_ws('{KEY_SEPARATOR}', {', '.join(parts)}))"


def sql_uniform01(seed: int | str, keys: Iterable[str]) -> str:
    h = sql_hash_hex(seed, keys)
    return f"(CAST(('0x' || substr({h}, 1, {UNIT_DIGITS})) AS UBIGINT)::DOUBLE / {UNIT_RANGE}::DOUBLE)"
