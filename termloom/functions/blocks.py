"""Slices of long texts, read from addressed blocks instead of from the text's start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import collapse

#: Characters of a block, and how many of the next one it repeats: a slice no longer than that lies in the block it begins in.
SIZE, OVERLAP = 4096, 1024


def text_blocks(texts: DataFrame) -> DataFrame:
    """(pmc_id, block, piece): the texts of (pmc_id, text) cut every SIZE characters, each piece with up to OVERLAP of the next one's.

    A text is cut in one pass; an empty or null one has no blocks.
    """
    pieces = texts.select("pmc_id", F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{SIZE}}})"), F.lit(1)).alias("_pieces"))
    longer = F.transform("_pieces", lambda x, i: F.concat(x, F.coalesce(F.substring(F.get("_pieces", i + 1), 1, OVERLAP), F.lit(""))))
    return pieces.select("pmc_id", F.posexplode(longer).alias("block", "piece"))


def with_slice(spans: DataFrame, texts: DataFrame, begin: Column, end: Column, name: str) -> DataFrame:
    """``spans`` (pmc_id, ...) with the text of (pmc_id, text) from ``begin`` to before ``end``, in characters from 0, as column ``name``.

    What lies outside the text is left out; a slice that begins before 0, is empty or has a null border is empty, as is one
    of an article without text. Spans meet blocks by article and block, so that a slice costs its own length and that of a
    block, wherever it begins, and a long article's spans are dealt over many tasks. Slices over OVERLAP characters are
    put together from blocks, each distinct one once.
    """
    blocks = text_blocks(texts).select("pmc_id", F.col("block").alias("_block"), F.col("piece").alias("_piece"))
    asked = spans.withColumns({"_begin": F.coalesce(begin.cast("int"), F.lit(-1)), "_end": F.coalesce(end.cast("int"), F.lit(-1))})
    size, block = F.col("_end") - F.col("_begin"), F.floor(F.col("_begin") / SIZE).cast("int")
    place = F.col("_begin") - F.col("_block") * SIZE
    long = (F.col("_begin") >= 0) & (size > OVERLAP)
    met = asked.where(~long).withColumn("_block", F.when((F.col("_begin") >= 0) & (size > 0), block).otherwise(-1)).join(blocks, ["pmc_id", "_block"], "left")
    short = met.withColumn(name, F.coalesce(F.substring("_piece", place + 1, size), F.lit("")))
    wide = asked.where(long)
    last = F.floor((F.col("_end") - 1) / SIZE).cast("int")
    parts = wide.select("pmc_id", "_begin", "_end").distinct().withColumn("_block", F.explode(F.sequence(block, last))).join(blocks, ["pmc_id", "_block"])
    first = F.greatest(place, F.lit(0))
    own = F.substring("_piece", first + 1, F.least(F.col("_end") - F.col("_block") * SIZE, F.lit(SIZE)) - first)
    ordered = F.sort_array(F.collect_list(F.struct("_block", own.alias("_own"))))
    whole = parts.groupBy("pmc_id", "_begin", "_end").agg(F.array_join(F.transform(ordered, lambda x: x["_own"]), "").alias(name))
    pieced = wide.join(whole, ["pmc_id", "_begin", "_end"], "left").withColumn(name, F.coalesce(F.col(name), F.lit("")))
    columns = [*(c for c in spans.columns if c != name), name]
    return short.select(columns).unionByName(pieced.select(columns))


def with_context(spans: DataFrame, texts: DataFrame, width: int, name: str) -> DataFrame:
    """``spans`` (pmc_id, offset, length, ...) with their text and ``width`` characters on both sides, white space collapsed."""
    found = with_slice(spans, texts, F.greatest(F.lit(0), F.col("offset") - width), F.col("offset") + F.col("length") + width, name)
    return found.withColumn(name, collapse(F.col(name)))
