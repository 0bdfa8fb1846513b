"""Texts of articles whose segments overlap, by a sweep over the segments' borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import with_slice
from .text import joined, laid_out, overlapping


def rebuild_texts(articles: DataFrame, by_offset: bool = False) -> DataFrame:
    """(pmc_id, text) of (pmc_id, full_text): the segments (offset, text) laid down in list order, or ``by_offset`` (ties in list order).

    A later segment overwrites; gaps are spaces. Missing offsets are 0, missing texts empty; without segments the text is
    empty. Articles without overlap are joined as they are; the others' texts are put together from what is visible of
    each segment. Ids are distinct.
    """
    laid = articles.select("pmc_id", laid_out(F.col("full_text"), by_offset).alias("_s"))
    plain = laid.where(~overlapping(F.col("_s"))).select("pmc_id", joined(F.col("_s")).alias("text"))
    return plain.unionByName(_swept(laid.where(overlapping(F.col("_s")))))


def _tree_levels(n: Column) -> Column:
    """0, 1, ... up to the level at which one node spans the first n intervals."""
    return F.sequence(F.lit(0), F.length(F.bin(n)).cast("int"))


def _swept(laid: DataFrame) -> DataFrame:
    """(pmc_id, text) of (pmc_id, _s), each stretch between neighbouring borders painted by the last segment that covers it.

    Stretches are the leaves of a binary tree. A segment covers whole subtrees, two a level at most, and is noted at their
    roots; a stretch finds the last segment noted at the nodes above it. So n segments make some n log n rows, dealt by
    node, however they overlap.
    """
    parts = laid.select("pmc_id", F.posexplode("_s").alias("rank", "s")).select("pmc_id", "rank", F.col("s.offset").alias("a"),
        (F.col("s.offset") + F.length("s.text")).alias("z"), F.col("s.text").alias("text"))
    place = Window.partitionBy("pmc_id").orderBy("x")
    borders = parts.select("pmc_id", F.explode(F.array(F.lit(0), "a", "z")).alias("x")).distinct().select("pmc_id", "x", (F.row_number().over(place) - 1).alias("i"),
        F.lead("x").over(place).alias("next"), F.count("*").over(Window.partitionBy("pmc_id")).alias("n"))
    stretches = borders.where(F.col("next").isNotNull())
    at = lambda c: borders.select("pmc_id", F.col("x").alias(c), F.col("i").alias(f"_{c}"))
    spans = parts.where(F.col("z") > F.col("a")).select("pmc_id", "rank", "a", "z").join(at("a"), ["pmc_id", "a"]).join(at("z"), ["pmc_id", "z"])
    shift = lambda c, k: F.call_function("shiftright", c, k)
    size = lambda k: F.call_function("shiftleft", F.lit(1), k)
    # of the nodes of a level that lie inside the segment, the first if its number is odd and the last if it is even have no parent inside
    first, last = lambda k: shift(F.col("_a") + size(k) - 1, k), lambda k: shift(F.col("_z"), k) - 1
    roots = F.flatten(F.transform(_tree_levels(F.col("_z")), lambda k: F.filter(F.array(
        F.struct(k.alias("level"), F.when((first(k) <= last(k)) & (first(k) % 2 == 1), first(k)).alias("node")),
        F.struct(k.alias("level"), F.when((first(k) <= last(k)) & (last(k) % 2 == 0), last(k)).alias("node"))), lambda x: x["node"].isNotNull())))
    noted = spans.select("pmc_id", "rank", F.inline(roots)).groupBy("pmc_id", "level", "node").agg(F.max("rank").alias("rank"))
    above = stretches.select("pmc_id", "i", F.inline(F.transform(_tree_levels(F.col("n")), lambda k: F.struct(k.alias("level"), shift(F.col("i"), k).alias("node")))))
    painted = above.join(noted, ["pmc_id", "level", "node"]).groupBy("pmc_id", "i").agg(F.max("rank").alias("rank"))
    # neighbouring stretches of one segment are one piece
    own = stretches.join(painted, ["pmc_id", "i"], "left").withColumn("_run", F.col("i") - F.row_number().over(Window.partitionBy("pmc_id", "rank").orderBy("i")))
    pieces = own.groupBy("pmc_id", "rank", "_run").agg(F.min("x").alias("x"), F.max("next").alias("end"))
    key = F.concat_ws("/", F.col("rank").cast("string"), "pmc_id")
    texts = parts.select(key.alias("pmc_id"), "text")
    seen = pieces.where(F.col("rank").isNotNull()).join(parts.select("pmc_id", "rank", "a"), ["pmc_id", "rank"]).select(
        F.col("pmc_id").alias("_article"), key.alias("pmc_id"), "x", (F.col("x") - F.col("a")).alias("_from"), (F.col("end") - F.col("a")).alias("_to"))
    shown = with_slice(seen, texts, F.col("_from"), F.col("_to"), "piece").select(F.col("_article").alias("pmc_id"), "x", "piece")
    gaps = pieces.where(F.col("rank").isNull()).select("pmc_id", "x", F.repeat(F.lit(" "), F.col("end") - F.col("x")).alias("piece"))
    ordered = F.sort_array(F.collect_list(F.struct("x", "piece")))
    return shown.unionByName(gaps).groupBy("pmc_id").agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("text"))
