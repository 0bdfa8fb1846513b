"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of every text; a chunk ends where the hash's high bits are zero, so an insertion moves
the borders near it only. A chunk whose digest occurred before (in a smaller doc_id, or earlier in the same text) is
removed where it lies in a run of such chunks of ``min_run`` bytes or more; the first occurrence always stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .textual import BYTE_VALUE, OTHER_VALUE, segment_hash, slices, utf8

#: Shortest chunk, longest chunk, and the number of high bits that are zero at a border (so 2 ** BITS bytes between borders).
LEAST, MOST, BITS = 16, 256, 5
GEAR = (BYTE_VALUE >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gear hash (h << 1) + GEAR[byte], which spans 32 bytes, at every byte, begun anew with every text."""
    place = np.arange(len(data), dtype=np.int32)
    place -= np.repeat(offsets[:-1], np.diff(offsets)).astype(np.int32)
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        more = h[:-step] << np.uint32(step)
        more[place[step:] < step] = 0
        h = h.copy()
        h[step:] += more
    return h


def chunk_borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, texts): the end of every chunk and the text that it belongs to; chunks of a text are adjacent."""
    marks = np.flatnonzero(gear(data, offsets) >> np.uint32(32 - BITS) == 0) + 1
    bounds = np.searchsorted(marks, offsets, "right")
    ends, texts, marks = [], [], marks.tolist()
    for t in range(len(offsets) - 1):
        last, end, before = int(offsets[t]), int(offsets[t + 1]), len(ends)
        for c in marks[bounds[t] : bounds[t + 1]]:
            if c - last < LEAST:
                continue
            while c - last > MOST:
                last += MOST
                ends.append(last)
            if c > last:
                ends.append(c)
                last = c
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end > last:
            ends.append(end)
        texts.append(len(ends) - before)
    return np.array(ends, np.int64), np.repeat(np.arange(len(texts)), texts)


def chunks(docs: DataFrame) -> DataFrame:
    """(digest, check, doc_id, start, end) of every chunk, in bytes of UTF-8; rows without an id or a text have none.

    digest (64 bits) and check (32 bits of another hash) together name a chunk's bytes: of 10 ** 13 chunks a pair is taken
    for equal wrongly with a probability of under one in a thousand.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for i, j, d, o in slices(*utf8(b.column("text")), texts=20000):
                ends, text = chunk_borders(d, o)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                digest, check = segment_hash(d, starts, ends).view(np.int64), (segment_hash(d, starts, ends,
                    OTHER_VALUE) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                places = [(x - o[text]).astype(np.int32) for x in (starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digest, check, ids[i:j][text], *places)], ["digest", "check", "doc_id", "start", "end"])

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(cut, "digest long, check int, doc_id long, start int, end int")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """The chunks of which an equal one came before. The first of each digest is found by a map-side combined minimum."""
    all_chunks, name = chunks(docs), ["digest", "check"]
    first, last = F.min(F.struct("doc_id", "start")).alias("first"), F.max(F.struct("doc_id", "start")).alias("last")
    twice = all_chunks.groupBy(*name).agg(first, last).where(F.col("first") != F.col("last")).select(*name, F.col("first.doc_id").alias("first_doc"),
        F.col("first.start").alias("first_start"))
    met = all_chunks.join(twice, name)
    return met.where((F.col("doc_id") != F.col("first_doc")) | (F.col("start") != F.col("first_start"))).select("doc_id", "start", "end")


def merge_spans(starts: np.ndarray, ends: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of touching or overlapping spans, of ``least`` bytes or more."""
    out: list[list[int]] = []
    for a, z in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out if z - a >= least]


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to borders of characters."""
    out = []
    for a, z in spans:
        while a < z and raw[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        if z > a:
            out.append((a, z))
    return out


def dedup(docs: DataFrame, min_run: int = 100) -> DataFrame:
    """``docs`` with its text less the repeated runs, and columns n_removed (bytes) and spans (array of start, end in bytes).

    A null or empty text stays; so does a row without doc_id, whose text is no source of repeats either. Rows that share
    doc_id and text are one document and come out alike; rows that share the id only are one document as well: what
    repeats in one of them counts at its place in all. Columns called n_removed or spans are replaced; others are kept.
    """
    plain = docs.drop("n_removed", "spans")
    doc, own = fresh(plain, "doc", "own")
    spans = repeated_chunks(docs).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set(F.struct("start", "end")).alias(own))
    joined = plain.join(spans, plain["doc_id"] == spans[doc], "left").drop(doc)
    names = plain.columns
    text_at = names.index("text")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lists, new, removed, cuts = b.column("text"), b.column(own), [], [], []
            for text, found in zip(texts, lists, strict=True):
                keep, out = [], []
                if found.is_valid and text.is_valid:
                    cells = found.values.flatten()
                    raw = text.as_buffer().to_pybytes()
                    ends = np.minimum(cells[1].to_numpy(), len(raw))
                    out, at = whole_characters(raw, merge_spans(cells[0].to_numpy(), ends, min_run)), 0
                    for a, z in out:
                        keep.append(raw[at:a])
                        at = z
                    if out:
                        keep.append(raw[at:])
                new.append(b"".join(keep).decode() if out else None)
                removed.append(sum(z - a for a, z in out))
                cuts.append([{"start": a, "end": z} for a, z in out])
            changed = pa.array([x is not None for x in new])
            columns = [*b.columns[:-1], pa.array(removed, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            columns[text_at] = pc.if_else(changed, pa.array(new, pa.string()), texts)
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_removed", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return joined.mapInArrow(remove, f"{schema}, n_removed long, spans array<struct<start:int,end:int>>")
