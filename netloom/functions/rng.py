"""Counter-based random numbers, equal in Spark, SQL and Python.

``u(seed, stream, k1, k2, ...)`` is the first 13 hexadecimal digits of an MD5
over the joined keys, divided by 2**52. It depends on the keys only, so plans
are deterministic whatever the partitioning, and SQL can state their results.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 4503599627370496


def uniform(seed, stream: str, *keys) -> Column:
    """Column form; keys are column names, Columns or numbers."""
    cols = [k if isinstance(k, Column) else F.col(k) if isinstance(k, str) else F.lit(k) for k in (F.lit(seed) if not isinstance(seed, Column) else seed, F.lit(stream), *keys)]
    text = F.concat_ws(":", *(c.cast("string") for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(SCALE))


def uniform_sql(seed, stream: str, *keys: str) -> str:
    """DuckDB form; keys are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', '{stream}', {', '.join(keys)})), 1, 13))::BIGINT / {SCALE}.0)"


def uniform_py(seed, stream: str, *keys) -> float:
    return int(hashlib.md5(":".join(map(str, (seed, stream, *keys))).encode()).hexdigest()[:13], 16) / SCALE


class Rng:
    """A stream of the same generator for sequential kernels; (seed, stream, counter) is its whole state."""

    def __init__(self, seed, stream: str, counter: int = 0):
        self.seed, self.stream, self.counter = seed, stream, counter

    def random(self) -> float:
        self.counter += 1
        return uniform_py(self.seed, self.stream, self.counter)

    def below(self, n: int) -> int:
        return int(self.random() * n)

    def pair(self, n: int) -> tuple[int, int]:
        """Two different indices under ``n``."""
        a, b = self.below(n), self.below(n - 1)
        return a, b + (b >= a)

    def shuffle(self, xs: list) -> None:
        for i in range(len(xs) - 1, 0, -1):
            j = self.below(i + 1)
            xs[i], xs[j] = xs[j], xs[i]
