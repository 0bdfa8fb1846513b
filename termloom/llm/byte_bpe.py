"""Byte-level BPE encoding and decoding by public rank files.

Most texts are encoded whole in Arrow batches. Texts over ``chunk`` characters are cut into overlapping chunks, which
are spread over the cluster, pre-tokenised and encoded apart, and stitched at the first place in each overlap where both
neighbours begin a pre-token: from there on the pre-tokeniser, which looks only ahead, can't differ. Where an overlap
holds no such place (a run longer than it), the text is encoded whole. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A space between two spaces, or after one at the end: the only spaces at which a text can't be cut.
UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: Units kept with their ids in a worker, and the longest of them in characters.
CACHE_UNITS, CACHE_CHARS = 150_000, 40


class Encoder(dict):
    """Encodes texts to packed little-endian unsigned 32-bit ids.

    The pattern starts a new match at every space between other than white space, so the text is cut there and the ids
    of each unit (space and what follows) are looked up; the dict holds the units met so far, up to a bound.
    """

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def raw(self, text: str) -> bytes:
        return np.asarray(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, unit: str) -> bytes:
        ids = self.raw(" " + unit)
        if len(self) < CACHE_UNITS and len(unit) <= CACHE_CHARS:
            self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if UNSAFE.search(text):
            return self.raw(text)
        first, *rest = text.split(" ")
        return self.raw(first) + b"".join([self[u] for u in rest])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def id_lists(packed: list[bytes]) -> pa.Array:
    """A list<int32> array of the packed ids."""
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = 32768, overlap: int = 2048) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs`` (doc_id, text; other columns are ignored).

    A null text is empty and has no ids. Repeated rows give repeated results; no rows give none.
    """
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than the chunk")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            texts = b.column("text")
            for i in range(0, max(len(b), 1), 512):
                part = [e.encode(t) for t in texts.slice(i, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 512), id_lists(part)], ["doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(len(b)):
                text = b.column("text")[row].as_py()
                starts = range(0, len(text), chunk)
                columns = [pa.array([b.column(c)[row].as_py()] * len(starts), pa.int64()) for c in ("doc_id", "key", "size")]
                columns += [pa.array(starts, pa.int64()), pa.array([s + chunk >= len(text) for s in starts])]
                columns.append(pa.array([text[s : s + chunk + overlap] for s in starts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "size", "start", "last", "text"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        e, find = encoder(path, pattern), regex.compile(pattern)
        own = ["doc_id", "key", "size", "copies", "start", "last"]
        for b in batches:
            for row in range(len(b)):
                start, last, text = (b.column(c)[row].as_py() for c in ("start", "last", "text"))
                bounds = [m.start() for m in find.finditer(text)] + [len(text)]
                head = [x for x in bounds if x <= overlap and x < len(text)] if start else [0]
                tail = [x for x in bounds if chunk <= x < len(text)] if not last else []
                marks = sorted({*head, *tail, len(text)})
                packed, at, tokens = [], [0], 0
                if marks[0]:
                    raise ValueError("the pattern must match every character")
                for a, z in zip(marks, marks[1:], strict=False):
                    packed.append(e.encode(text[a:z]) if z - a > 256 else e.raw(text[a:z]))
                    tokens += len(packed[-1]) // 4
                    at.append(tokens)
                place = dict(zip(marks, at, strict=True))
                lists = ([start + x for x in head], [place[x] for x in head], [start + x for x in tail], [place[x] for x in tail])
                columns = [*(b.column(c).slice(row, 1) for c in own), pa.array([text[:chunk]]), pa.array([b"".join(packed)], pa.binary())]
                columns += [pa.array([x], pa.list_(pa.int64())) for x in lists]
                yield pa.RecordBatch.from_arrays(columns, [*own, "text", "ids", "head", "head_at", "tail", "tail_at"])

    def stitch(table: pa.Table) -> pa.Table:
        rows = table.sort_by("start").to_pylist()  # of one text
        out, begin = [], 0
        for r, after in zip(rows, [*rows[1:], None], strict=True):
            if after is None:
                out.append(r["ids"][4 * begin :])
                break
            meets = dict(zip(after["head"], after["head_at"], strict=True))
            found = next(((x, at) for x, at in zip(r["tail"], r["tail_at"], strict=True) if x in meets), None)
            if found is None:
                out = [encoder(path, pattern).encode("".join(r["text"] for r in rows))]
                break
            out.append(r["ids"][4 * begin : 4 * found[1]])
            begin = meets[found[0]]
        return pa.table([pa.array([rows[0]["doc_id"]], pa.int64()), id_lists([b"".join(out)]), pa.array([rows[0]["copies"]], pa.int64())], names=["doc_id", "ids", "copies"])

    short = rows.where(F.length("text") <= chunk).mapInArrow(whole, "doc_id long, ids array<int>")
    named = rows.where(F.length("text") > chunk).withColumns({"key": F.xxhash64("text"), "size": F.octet_length("text").cast("long")})
    place = "doc_id long, key long, size long, start long, last boolean, text string"
    marks = "ids binary, head array<long>, head_at array<long>, tail array<long>, tail_at array<long>"
    # copies of a row are one from here on, with their number
    once = named.mapInArrow(cut, place).groupBy("doc_id", "key", "size", "start").agg(F.count("*").alias("copies"), F.first("last").alias("last"), F.first("text").alias("text"))
    encoded = once.select("doc_id", "key", "size", "copies", "start", "last", "text").mapInArrow(pieces, f"{place.replace('size long,', 'size long, copies long,')}, {marks}")
    stitched = encoded.groupBy("doc_id", "key", "size").applyInArrow(stitch, "doc_id long, ids array<int>, copies long")
    return short.unionByName(stitched.select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded binary) of every row of ``encoded`` (doc_id, ids array<int>); null ids decode to no bytes."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            for i in range(0, max(len(b), 1), 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([*part.columns,
                    pa.array([e.decode(x.values.to_numpy()) if x.is_valid and len(x) else b"" for x in part.column("ids")], pa.binary())],
                    ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(back, "doc_id long, ids array<int>, decoded binary")
