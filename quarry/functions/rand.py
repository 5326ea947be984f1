"""Seeded, partition-independent randomness from content hashes.

``h(parts)`` is the first ``digits`` hex digits of md5 over the parts joined by
'|', read as a non-negative bigint. It depends only on the row's own values,
so results do not change with partitioning, retries or lost executors, and
the same value can be computed in any SQL engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(parts) -> list[Column]:
    cols = []
    for p in parts:
        c = p if isinstance(p, Column) else F.lit(p)
        cols.append(c.cast("string"))
    return cols


def hash_key(*parts) -> Column:
    """md5 hex string of the joined parts (a total order without ties in practice)."""
    return F.md5(F.concat_ws("|", *_parts(parts)))


def hash_int(*parts, digits: int = 8) -> Column:
    """Non-negative bigint from the first ``digits`` hex digits (<= 15)."""
    if not 1 <= digits <= 15:
        raise ValueError("digits must be in 1..15")
    return F.conv(F.substring(hash_key(*parts), 1, digits), 16, 10).cast("bigint")


def hash_uniform(*parts) -> Column:
    """Uniform double in [0, 1) from 8 hex digits."""
    return hash_int(*parts, digits=8).cast("double") / F.lit(float(2 ** 32))


def hash_order(*parts) -> Column:
    """Sort key for seeded shuffles (md5 string)."""
    return hash_key(*parts)


def sql_hash_int(parts: list[str], digits: int = 8) -> str:
    """The same hash as SQL text (for DuckDB oracles); parts are SQL expressions."""
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {joined})), 1, {digits}))::BIGINT"


def sql_hash_key(parts: list[str]) -> str:
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"md5(concat_ws('|', {joined}))"


def ring_offsets(n: Column, pool: Column, seed: int, key: Column, tag: str) -> Column:
    """``n`` distinct values of ``[0, pool)`` (array<bigint>, draw order).

    Draw j is uniform over the ``pool - j`` values not drawn yet: a hash mod
    ``pool - j`` shifted past the earlier draws in ascending order. Needs only
    ``n`` hashes, whatever the pool size."""
    def step(acc, j):
        r = F.pmod(hash_int(seed, tag, key, j, digits=15), pool - j)
        placed = F.aggregate(F.sort_array(acc), r,
                             lambda x, s: F.when(x >= s, x + F.lit(1)).otherwise(x))
        return F.concat(acc, F.array(placed))
    draws = F.filter(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - F.lit(1), F.lit(0)).cast("bigint")),
                     lambda j: j < n)
    return F.aggregate(draws, F.array().cast("array<bigint>"), step)
