"""Seeded integer hashing by plain arithmetic.

Samples and bootstrap draws are ordered by this value, so they never depend on how rows
are partitioned, and any SQL engine can recompute them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MODULUS = 2147483647
MULTIPLIER = 48271


def mix(*columns, seed: int = 0) -> Column:
    """Fold integer columns into [0, 2**31 - 1)."""
    value = F.lit(int(seed) % MODULUS).cast("long")
    for column in columns:
        part = F.col(column) if isinstance(column, str) else column
        step = F.pmod(value + F.pmod(part.cast("long"), F.lit(MODULUS)) + F.lit(1), F.lit(MODULUS))
        value = F.pmod(step * F.lit(MULTIPLIER), F.lit(MODULUS))
    # A second round spreads neighbouring keys.
    return F.pmod((value + F.lit(11)) * F.lit(MULTIPLIER), F.lit(MODULUS))


def mix_sql(*columns: str, seed: int = 0) -> str:
    """The same value as ANSI SQL text."""
    value = str(int(seed) % MODULUS)
    for column in columns:
        value = (
            f"((({value} + ({column}) % {MODULUS} + 1) % {MODULUS}) * {MULTIPLIER} % {MODULUS})"
        )
    return f"(({value} + 11) * {MULTIPLIER} % {MODULUS})"
