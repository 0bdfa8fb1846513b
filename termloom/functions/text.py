"""Column functions: identifiers, offsets, rebuilt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUNS = r"([A-Za-z0-9]+|[^A-Za-z0-9]+)"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_ids(c: Column) -> Column:
    """The parts of an identifier at ``;``, stripped, without empty ones; -1 is kept. Null has none."""
    clean = F.regexp_replace(F.regexp_replace(c, r"(?U)\s*;[\s;]*", ";"), r"(?U)^[\s;]+|[\s;]+$", "")
    none = F.array().cast("array<string>")
    parts = F.when(clean == "", none).otherwise(F.coalesce(F.split(clean, ";"), none))
    return F.when(c.rlike(r"\A[!-:<-~]+\z"), F.array(c)).otherwise(parts)  # most are one part as they are


def split_ids_real(c: Column) -> Column:
    """split_ids without -1."""
    return F.filter(split_ids(c), lambda x: x != "-1")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise_phrase(c: Column) -> Column:
    """Lower case, then the ASCII alphanumeric tokens joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"([A-Za-z0-9]+)"), F.lit(1)), " ")


def laid_out(segments: Column, by_offset: bool = False) -> Column:
    """The segments (offset, text) in the order in which they are laid down: the list's, or ``by_offset`` with ties in list order.

    Missing offsets are 0, missing texts empty; no segments are an empty list.
    """
    offset, text = (lambda s: F.coalesce(s["offset"], F.lit(0)).alias("offset")), (lambda s: F.coalesce(s["text"], F.lit("")).alias("text"))
    clean = F.transform(segments, lambda s: F.struct(offset(s), text(s)))
    if by_offset:
        keyed = F.array_sort(F.transform(segments, lambda s, i: F.struct(offset(s), i.alias("i"), text(s))))
        clean = F.transform(keyed, lambda s: F.struct(s["offset"].alias("offset"), s["text"].alias("text")))
    return F.coalesce(clean, F.array().cast("array<struct<offset:int,text:string>>"))


def _gaps(segments: Column) -> Column:
    """Between each segment's end and the next one's start."""
    ends, starts = F.transform(segments, lambda s: s["offset"] + F.length(s["text"])), F.transform(segments, lambda s: s["offset"])
    rest = F.greatest(F.size(segments) - 1, F.lit(0))
    return F.zip_with(F.slice(starts, 2, rest), F.slice(ends, 1, rest), lambda a, b: a - b)


def overlapping(segments: Column) -> Column:
    """Whether a segment begins before the end of the one before it, in what laid_out gives."""
    return F.exists(_gaps(segments), lambda g: g < 0)


def joined(segments: Column) -> Column:
    """The text of segments that don't overlap, in what laid_out gives; gaps become spaces."""
    pads = F.concat(F.array(F.try_element_at(F.transform(segments, lambda s: s["offset"]), F.lit(1))), _gaps(segments))
    return F.when(F.size(segments) == 0, F.lit("")).otherwise(F.array_join(F.zip_with(pads, segments, lambda g, s: F.concat(F.repeat(F.lit(" "), g), s["text"])), ""))
