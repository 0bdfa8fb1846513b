"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import salt_of, stage, unstage

#: A node's edges are dealt over so many tasks at most, by the other end, where there are so many edges that one may have too many for a task.
SALTS, MANY = 256, 1 << 20


def with_least(edges: DataFrame, many: bool) -> DataFrame:
    """``edges`` (a, b) with m, the least b of each a.

    Of many edges a hub may have more than a task can take: the minimum then goes back only to the (a, salt) that have
    edges, so that a hub's edges meet it in up to SALTS tasks.
    """
    if not many:
        return edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    dealt = edges.withColumn("s", salt_of("b", buckets=SALTS))
    parts = dealt.groupBy("a", "s").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("s").alias("s"))
    return dealt.join(least.select("a", F.explode("s").alias("s"), "m"), ["a", "s"]).select("a", "b", "m")


def shape(edges: DataFrame) -> tuple[int, bool]:
    """(how many edges, whether every a has one b, which is no a)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    odd = (F.col("out") > 1) | ((F.col("out") > 0) & (F.col("least") == 0))
    r = nodes.agg(F.sum("out").alias("edges"), F.max(odd).alias("odd")).first()
    return r["edges"] or 0, not r["odd"]


def stars(edges: DataFrame, most_rounds: int = 40, many: int = MANY) -> DataFrame:
    """(node, component), staged: for every node of ``edges`` (a, b) but the smallest of its component, the smallest that it reaches.

    Edges with a null end don't count. Each round's edges are written, so a lost executor costs no earlier round; the
    rounds end when every node hangs on a root.
    """
    now = stage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        n, done = shape(now)
        if done:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        large = with_least(both, n > many).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        small = with_least(large, n > many)
        step = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        after = stage(step.where(F.col("a") != F.col("b")).distinct(), "edges")
        unstage(now)
        now = after
    raise RuntimeError("the components didn't settle")


def components(edges: DataFrame, most_rounds: int = 40, many: int = MANY) -> DataFrame:
    """(node, component): for every node of ``edges`` (a, b) that has an edge to another the smallest node that it reaches."""
    found = stars(edges, most_rounds, many)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
