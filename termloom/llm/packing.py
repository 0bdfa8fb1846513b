"""Best-fit packing of tokenised documents by large-item matching.

Where a piece goes depends on its length alone, so the plan is made from the histogram of lengths (``capacity`` numbers,
whatever the size of the corpus). Pieces over a third of the capacity fit at most twice in a sequence: from the longest
down, each is matched with the longest partner that fits. Shorter ones, from the longest down, go where the least room
stays. The plan is a list of runs: the pieces of one length with global ranks in a range go to consecutive sequences at
one offset. Ranks are counted within each written part and shifted by the parts before it, so no task sees all pieces.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .common import maybe_broadcast, stage


@lru_cache(maxsize=2)
def _whole(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def added_tokens(path: str) -> list[str]:
    """The texts of the added tokens of a tokenizer's file; the tokenizer itself is many times as large in memory."""
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens", [])]


def tokenize(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, place): the pieces of every document, its ids followed by ``end_id``.

    Documents longer than ``capacity`` are cut from the back, so the first piece may be shorter. ``ids`` is binary,
    little-endian unsigned 32-bit. ``ranks`` holds the vocabulary of ``tokenizer`` as ranks and gives the same ids; a
    text that holds one of the tokenizer's added tokens goes through ``tokenizer`` itself, which a worker loads at its first
    such text. ``part`` and ``place`` number
    the pieces of each length within a task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast, added = encoder(ranks, pattern), added_tokens(tokenizer)
        end, seen, part = np.array([end_id], "<u4").tobytes(), [0] * (capacity + 1), TaskContext.get().partitionId()
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for i in range(0, len(b), 512):
                out = [[] for _ in range(7)]
                for doc, text in zip(ids[i : i + 512], texts.slice(i, 512).to_pylist(), strict=True):
                    text = text or ""
                    packed = (np.asarray(_whole(tokenizer).encode(text, add_special_tokens=False).ids, "<u4").tobytes() if any(t in text for t in added)
                        else fast.encode(text)) + end
                    n, at, piece = len(packed) // 4, 0, 0
                    while at < n:
                        length = (n - at) % capacity or capacity
                        for column, x in zip(out, (doc, piece, at, length, packed[4 * at : 4 * (at + length)], part, seen[length]), strict=True):
                            column.append(x)
                        seen[length] += 1
                        at, piece = at + length, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c,
                    t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)],
                    ["doc_id", "piece", "start", "length", "ids", "part", "place"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut,
        "doc_id long, piece int, start long, length long, ids binary, part long, place long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, offset, pieces a sequence) that place all pieces of all lengths.

    Sequences are numbered from 0. The list's length depends on the capacity, not on the counts.
    """
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    rank, runs, room, bins = [0] * (capacity + 1), [], defaultdict(list), 0

    def put(length: int, n: int, first: int, offset: int, each: int = 1) -> None:
        runs.append((length, rank[length], rank[length] + n, first, offset, each))
        rank[length] += n
        left[length] -= n

    small = capacity // 3
    for length in range(capacity, small, -1):
        partner = min(length, capacity - length)
        while left[length]:
            while partner > small and left[partner] < 1 + (partner == length):
                partner -= 1
            n = left[length] if partner <= small else left[length] // 2 if partner == length else min(left[length], left[partner])
            put(length, n, bins, 0)
            if partner > small:
                put(partner, n, bins, length)
                room[capacity - length - partner].append((bins, n))
            else:
                room[capacity - length].append((bins, n))
            bins += n
    for length in range(small, 0, -1):
        while left[length]:
            gap = next((g for g in range(length, capacity + 1) if room.get(g)), None)
            if gap is None:
                n = -(-left[length] // (capacity // length))
                room[capacity].append((bins, n))
                bins, gap = bins + n, capacity
            each = gap // length
            first, n = room[gap].pop()
            full = min(n, left[length] // each)
            if full:
                put(length, full * each, first, capacity - gap, each)
                room[gap - each * length].append((first, full))
            if full < n:
                some = left[length]
                rest = full + (some > 0)
                if some:
                    put(length, some, first + full, capacity - gap, some)
                    room[gap - some * length].append((first + full, 1))
                if rest < n:
                    room[gap].append((first + rest, n - rest))
    return runs


def pack(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece of every document (doc_id, text).

    A null text is empty: one piece of one id. Repeated rows are packed each; other columns are ignored; no rows give
    none. The pieces are written once in the shared folder, as their lengths are read before they are placed.
    """
    if capacity < 3:
        raise ValueError("the capacity must be 3 at least")
    pieces = stage(tokenize(docs, tokenizer, ranks, pattern, end_id, capacity), "pieces")
    spark = pieces.sparkSession
    sizes = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stage(sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    columns = np.array(plan(counts, capacity), np.int64).reshape(-1, 6).T
    # as an Arrow table: rows in a list would go through Python workers of their own kind, which stay beside those that made the pieces
    runs = spark.createDataFrame(pa.table([pa.array(c) for c in columns], names=["length", "first", "end", "sequence", "at", "each"]))
    ranked = pieces.join(maybe_broadcast(sizes.drop("n"), sizes.count(), 40), ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    # the runs' number depends on the capacity alone
    placed = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    step = F.col("rank") - F.col("first")
    return placed.select("doc_id", "piece", "start", pieces["length"], "ids",
        (F.col("sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(step, F.col("each")) * pieces["length"]).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids): the packed sequences, their pieces' ids concatenated by offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids", "length")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return grouped.select("sequence_id", "n_tokens", joined.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
