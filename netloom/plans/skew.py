"""Joins on keys of which a few hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many keys of most rows a join can deal to several tasks, and rows that a task can well take.
HOT_KEYS, FEW_ROWS = 1_000, 256


def hot_keys(counts: DataFrame, key: str) -> dict[int, list[int]]:
    """Hashes of the keys that hold more than a quarter of a task's even share of all rows, by the
    number of parts to deal them to (a power of two); counts: key, n.

    At most ``HOT_KEYS`` of them, those of most rows, so a key beyond the list
    holds less than one row in ``HOT_KEYS``.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(FEW_ROWS, total // (4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = counts.where(F.col("n") > share).select(F.xxhash64(key).alias("h"), "n").orderBy(F.desc("n"), "h").limit(HOT_KEYS).collect()
    out: dict[int, list[int]] = {}
    for r in rows:
        out.setdefault(1 << (-(-r["n"] // share) - 1).bit_length(), []).append(r["h"])
    return out


def _parts(key: str, hot: dict[int, list[int]]) -> Column:
    """To how many parts the rows of a key are dealt; both sides of a join ask the same hash, so they agree."""
    parts = F.lit(1).cast("long")
    for n, hashes in sorted(hot.items()):
        parts = F.when(F.xxhash64(key).isin(hashes), F.lit(n).cast("long")).otherwise(parts)
    return parts


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: dict[int, list[int]], salt_by: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (one row a key) on ``key``, also where a few keys hold most rows.

    Rows of the ``hot`` keys of ``hot_keys`` are dealt to several parts by a
    hash of ``salt_by``, and their rows of ``one`` are copied to each part.
    """
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(salt_by), _parts(key, hot)))
    copied = one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), _parts(key, hot) - 1)))
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
