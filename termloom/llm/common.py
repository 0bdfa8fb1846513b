"""Shared helpers: staging tables in the cluster's shared folder, hot-key joins, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_LIMIT, maybe_broadcast, shared_dir, stage, unstage

__all__ = ["BROADCAST_LIMIT", "fresh", "hot_keys", "maybe_broadcast", "salt_of", "salted_join", "shared_dir", "stage", "unstage"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names, made of ``names``, that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def salt_of(*cols: str, buckets: int) -> Column:
    """A salt that spreads the rows of one key over so many buckets, the same on every attempt."""
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def hot_keys(counts: DataFrame, key: str, rows: str, share: int = 256) -> list:
    """Keys of a (key, row count) table that hold over 1/share of all rows: fewer than ``share`` of them, whatever the size."""
    total = counts.agg(F.sum(rows).alias("t")).first()["t"] or 0
    return [r[0] for r in counts.where(F.col(rows) * share > F.lit(total)).where(F.col(key).isNotNull()).select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "left", buckets: int = 32, by: str | None = None) -> DataFrame:
    """Join right (few rows a key) to left; rows of the ``hot`` keys of left are dealt over ``buckets`` tasks by column ``by``.

    Keys that are not hot have salt 0, so right is copied for the hot keys only. Null keys stay unmatched; left's null
    keys are spread by the salt as well.
    """
    spread = salt_of(by or key, buckets=buckets)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    a = left.withColumn("_salt", F.when(is_hot | F.col(key).isNull(), spread).otherwise(F.lit(0)))
    b = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "_salt"], how).drop("_salt")
