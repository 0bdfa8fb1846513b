"""Exact removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

A bucket is a set of places where the same bytes follow, and its identifier is a name of these bytes, so that equal
buckets have equal identifiers in every task. Identifiers begin as the q-grams of eight bytes themselves; each refinement
names a place by its own identifier and that of the place as many bytes later, and the next one reuses these names, so
that after r rounds they stand for 8 * 2 ** r bytes (``refined``). What is sorted into buckets over the whole corpus are not
all places but samples that are alike in equal strings:

1. Every string of ``length`` bytes is represented by its anchor, the ``gram``-byte suffix in it with the least identifier.
   Anchors alone in their bucket are settled, as is every string that has one.
2. Neighbouring strings with one anchor form an interval of about 55. Its bucket, within that of the anchor, is refined by
   the identifiers of its first and last string. A bucket of two or more is settled: all of its strings repeat. One alone
   is settled where its anchor's bucket holds no other.
3. What is left open, one interval for each bucket, is refined down to the single strings. Buckets that fit a task are
   finished there. Larger ones are split in two by the strings' places before the anchor, each half refined by the
   bytes that all of its strings have in common; the halves that are alone are settled, the others go through step 3 again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unstage
from .textual import BYTE_VALUE, M1, M2, M3, STEP, U, mix, powers, slices, utf8

#: Bytes of a first q-gram, and the longest run of strings' starts worked on at once, so that a text of any length fits.
Q, SEGMENT = 8, 1 << 20
#: Bits of a sliding minimum that hold the place in the segment; the others hold the identifier.
PLACE_BITS = 22
PLACE = U((1 << PLACE_BITS) - 1)
#: The inverse of STEP modulo 2 ** 64.
BACK = U(pow(int(STEP), -1, 1 << 64))
#: Most members of a bucket that one task finishes (about 300 bytes each), and bytes of whole buckets that it takes at once.
MEMBERS, TOGETHER = 1 << 13, 1 << 19


def refined(data: np.ndarray, size: int) -> np.ndarray:
    """Identifiers of the ``size`` bytes at every place, ``size`` being Q times a power of two."""
    ids = np.ndarray(max(len(data) - Q + 1, 0), "<u8", np.ascontiguousarray(data), strides=(1,)).copy() if len(data) >= Q else np.zeros(0, U)
    span = Q
    while span < size:
        ids = mix(ids[:-span] * M1 + ids[span:]) if len(ids) > span else ids[:0]
        span *= 2
    return ids


class Names:
    """Identifiers of strings of ``length`` bytes and of runs of them, over those of ``half`` bytes at every place.

    A string's identifier is that at its start refined by the one at its last ``half`` bytes. To it comes a rolling hash
    of the bytes themselves with other random values, so that names which collide at one level are told apart.
    """

    def __init__(self, data: np.ndarray, ids: np.ndarray, half: int, length: int):
        self.ids, self.half, self.length = ids, half, length
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(BYTE_VALUE[data] * powers(len(data))[: len(data)], out=self.sums[1:])
        self.back = powers(len(data) + 1, BACK)

    def strings(self, starts: np.ndarray) -> np.ndarray:
        return self.ids[starts] * M1 + self.ids[starts + (self.length - self.half)]

    def bytes_of(self, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * self.back[starts]

    def runs(self, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Names of ``count`` strings (``length`` at most) from each start on: of the first and the last, which cover all bytes."""
        return mix(mix(self.strings(starts)) * M3 + mix(self.strings(starts + count - 1)) + self.bytes_of(starts, count + (self.length - 1)))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every i for which it is whole."""
    span = 1
    while span * 2 <= width:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def halves(length: int) -> int:
    """The longest refinement that two identifiers can make a string of ``length`` bytes of."""
    size = Q
    while size * 2 <= length:
        size *= 2
    return size


def anchor_intervals(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The intervals of strings with one anchor: text, start (of the first string), count, lead (start to anchor), anchor, bucket."""
    none = {k: np.zeros(0, np.int64) for k in ("text", "start", "count", "lead", "anchor", "bucket")}
    size = np.diff(offsets)
    long = np.flatnonzero(size >= length)
    if not len(long):
        return none
    ids = refined(data, gram)
    least = sliding_minimum((ids & ~PLACE) | np.arange(len(ids), dtype=U), length - gram + 1)
    at = (least & PLACE).astype(np.int64)
    whole = np.zeros(len(least) + 1, np.int8)
    np.add.at(whole, offsets[long], 1)
    np.add.at(whole, offsets[long] + size[long] - length + 1, -1)
    good = np.flatnonzero(np.cumsum(whole[:-1]))
    new = np.ones(len(good), bool)
    new[1:] = (at[good[1:]] != at[good[:-1]]) | (good[1:] != good[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(good)))
    start = good[first]
    lead = at[start] - start
    half, span = halves(length), gram
    wide = ids
    while span < half:
        wide, span = mix(wide[:-span] * M1 + wide[span:]), span * 2
    bucket = mix(Names(data, wide, half, length).runs(start, count) + lead.astype(U) * M1 + count.astype(U) * M2)
    text = np.searchsorted(offsets, start, "right") - 1
    return {"text": text, "start": start - offsets[text], "count": count, "lead": lead, "anchor": ids[at[start]], "bucket": bucket}


def segments(column: pa.Array, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, place in the text, bytes, offsets): runs of short texts, and long ones in parts that share length - 1 bytes."""
    for i, j, d, o in slices(*utf8(column)):
        if len(d) - length < SEGMENT:
            yield i, j, 0, d, o
            continue
        for s in range(0, len(d) - length + 1, SEGMENT):
            part = d[s : s + SEGMENT + length - 1]
            yield i, j, s, part, np.array([0, len(part)])


INTERVAL = {"anchor": "long", "bucket": "long", "doc_id": "long", "at": "long"}
#: A start with its interval's count and lead, each under 256, in one number.
COUNT, LEAD = 256, 65536


def intervals(docs: DataFrame, length: int, gram: int, columns: list[str]) -> DataFrame:
    """Those of the columns anchor, bucket, doc_id and at (start, count and lead) that are asked for, of every interval."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for i, j, place, d, o in segments(b.column("text"), length):
                x = anchor_intervals(d, o, length, gram)
                x |= {"doc_id": ids[i:j][x["text"]], "at": (x["start"] + place) * LEAD + x["count"] * COUNT + x["lead"]}
                yield pa.RecordBatch.from_arrays([pa.array(x[c].view(np.int64)) for c in columns], columns)

    return docs.mapInArrow(found, ", ".join(f"{c} {INTERVAL[c]}" for c in columns))


def candidates(docs: DataFrame, length: int) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).select(F.col("doc_id").cast("long"), "text")


#: An open interval: its bucket's cell, the first and last place before the anchor that count, and whether its strings are to be marked.
OPEN = {"cell": pa.int64(), "low": pa.int32(), "high": pa.int32(), "single": pa.bool_(), "doc_id": pa.int64(), "start": pa.int64(),
    "lead": pa.int32(), "span": pa.binary()}
OPEN_SCHEMA = "cell long, low int, high int, single boolean, doc_id long, start long, lead int, span binary"
RUNS_SCHEMA = "doc_id long, start long, end long"


def spans_of(met: DataFrame, length: int, gram: int) -> DataFrame:
    """Open intervals with their bytes; met: doc_id, text, open (array of cell, at, single)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(len(b)):
                raw, cells = b.column("text")[row].as_buffer(), b.column("open")[row].values
                cell, at, single = (cells.field(k).to_numpy(zero_copy_only=False) for k in ("cell", "at", "single"))
                start, count, lead = at // LEAD, at // COUNT % 256, at % 256
                good = np.flatnonzero(start + count - 1 + length <= raw.size)
                span = [raw[s : s + n - 1 + length].to_pybytes() for s, n in zip(start[good].tolist(), count[good].tolist(), strict=True)]
                n = len(good)
                columns = [cell[good], np.zeros(n, np.int32), np.full(n, length - gram, np.int32), single[good],
                    np.full(n, b.column("doc_id")[row].as_py()), start[good], lead[good].astype(np.int32), span]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, OPEN.values(), strict=True)], [*OPEN])

    return met.select("doc_id", "text", "open").mapInArrow(cut, OPEN_SCHEMA)


def repeated_runs(cells: pa.Table, length: int) -> pa.RecordBatch:
    """The maximal runs (doc_id, start, end) of strings of marked intervals that another member of their cell has; whole cells."""
    cell, lead, start = (cells[c].to_numpy().astype(np.int64) for c in ("cell", "lead", "start"))
    single, doc = cells["single"].to_numpy(), cells["doc_id"].to_numpy()
    data, offsets = utf8(cells["span"])
    count = np.diff(offsets) - (length - 1)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    half = halves(length)
    names = Names(data, refined(data, half), half, length)
    at = offsets[:-1][row] + place
    before = lead[row] - place
    name = mix(mix(names.strings(at)) + names.bytes_of(at, length) + before.astype(U) * M2)
    order = np.lexsort((name, cell[row]))
    same = (name[order[1:]] == name[order[:-1]]) & (cell[row[order[1:]]] == cell[row[order[:-1]]])
    twice = np.zeros(len(row), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    twice &= single[row]
    first = twice.copy()
    first[1:] &= ~(twice[:-1] & (row[1:] == row[:-1]))
    last = twice.copy()
    last[:-1] &= ~(twice[1:] & (row[1:] == row[:-1]))
    a, z = np.flatnonzero(first), np.flatnonzero(last)
    return pa.RecordBatch.from_arrays([pa.array(doc[row[a]]), pa.array(start[row[a]] + place[a]), pa.array(start[row[a]] + place[z] + length)],
        ["doc_id", "start", "end"])


def finished(rows: DataFrame, length: int) -> DataFrame:
    """``repeated_runs`` of cells that have MEMBERS members at most: they meet in a task, which takes some whole cells at once."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) < TOGETHER:
                continue
            table = pa.Table.from_batches(held)
            cell = table["cell"].to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))
            for at in whole_cells(table, cell, cut):
                yield repeated_runs(at, length)
            held = table.slice(cut).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            for at in whole_cells(table, table["cell"].to_numpy(), len(table)):
                yield repeated_runs(at, length)

    def whole_cells(table: pa.Table, cell: np.ndarray, end: int) -> Iterator[pa.Table]:
        begins = np.append(np.flatnonzero(np.append(True, cell[1:end] != cell[: end - 1])), end) if end else np.zeros(1, np.int64)
        rows_at_once = max(1, TOGETHER // (2 * length))
        i = 0
        while i < len(begins) - 1:
            j = max(i + 1, int(np.searchsorted(begins, begins[i] + rows_at_once, "right")) - 1)
            yield table.slice(begins[i], begins[j] - begins[i])
            i = j

    return rows.select(*OPEN).repartition("cell").sortWithinPartitions("cell").mapInArrow(settle, RUNS_SCHEMA)


def split(rows: DataFrame, length: int) -> DataFrame:
    """Each interval's part in the nearer and in the farther half of its cell's places; a half's cell is named by what all of its strings share."""

    def two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {c: [] for c in OPEN}
            for r in b.to_pylist():
                middle = (r["low"] + r["high"]) // 2
                most = r["lead"] - (len(r["span"]) - length)  # the last string's place before the anchor
                for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                    begin, end = min(high, r["lead"]), max(low, most)
                    if low > high or begin < end:
                        continue
                    skip = r["lead"] - begin
                    span = r["span"][skip : skip + begin - end + length]
                    core = np.frombuffer(span, np.uint8)[begin - low : begin - high + length]
                    cell = mix(np.array([r["cell"]], np.int64).view(U) * M1 + (core_name(core) + U(low)) * M2 + U(high))
                    for c, v in zip(OPEN, (int(cell.view(np.int64)[0]), low, high, r["single"], r["doc_id"], r["start"] + skip, begin, span), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in OPEN.items()], [*OPEN])

    return rows.select(*OPEN).mapInArrow(two, OPEN_SCHEMA)


def core_name(core: np.ndarray) -> np.uint64:
    return mix((BYTE_VALUE[core] * powers(len(core))[: len(core)]).sum(dtype=U).reshape(1) + U(len(core)))[0]


def open_runs(rows: DataFrame, length: int, members: int) -> list[DataFrame]:
    """The repeated runs of open intervals with a column ``size``, their cell's members; each round's table of them is staged."""
    out = []
    while True:
        out.append(stage(finished(rows.where((F.col("size") > 1) & (F.col("size") <= members)), length), "runs"))
        large = rows.where(F.col("size") > members)
        if large.isEmpty():
            unstage(rows)
            return out
        # a cell of one place holds equal strings
        out.append(stage(large.where((F.col("low") == F.col("high")) & F.col("single")).select("doc_id", "start",
            (F.col("start") + length).alias("end")), "runs"))
        halved = stage(split(large.where(F.col("low") < F.col("high")), length), "halves")
        sizes = stage(halved.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > 1), "sizes")
        again = stage(halved.join(sizes, "cell"), "open")
        unstage(rows, halved, sizes)
        rows = again


def dedup(docs: DataFrame, length: int = 200, gram: int = 64, members: int = MEMBERS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept binary): every row of ``docs`` (doc_id, text; other columns are ignored).

    A byte goes if it lies in a string of ``length`` bytes that starts anywhere else as well; spans are the maximal
    removed runs (start, end in bytes). A null text is empty. Rows without an id stay whole and are no source of repeats;
    rows that repeat an id and a text repeat each other; rows that share the id only are cut where any of them is.
    ``gram`` is a power of two from 8 on.
    """
    if gram & (gram - 1) or not Q <= gram <= halves(length) or not length - gram < 255 or length < 2 * Q:
        raise ValueError("gram must be a power of two from 8 to length, and at most 254 under length")
    texts = candidates(docs, length)
    twice = stage(intervals(texts, length, gram, ["anchor"]).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("anchor"), "twice")
    met = stage(intervals(texts, length, gram, ["anchor", "bucket", "doc_id", "at"]).join(twice, "anchor"), "met")
    buckets = stage(met.groupBy("anchor", "bucket").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("one")), "buckets")
    single = F.col("n") == 1
    groups = stage(buckets.groupBy("anchor").agg(F.count("*").alias("size"),
        F.min("n").alias("least")).where((F.col("size") > 1) & (F.col("least") == 1)).select("anchor", "size"), "groups")
    chosen = stage(buckets.join(groups, "anchor").select(F.col("one.doc_id").alias("doc_id"),
        F.struct(F.col("anchor").alias("cell"), F.col("one.at").alias("at"), single.alias("single"), "size").alias("o")), "chosen")
    by_doc = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("o.cell", "o.at", "o.single")).alias("open"))
    # what is open and what is cut grow with the corpus: texts meet them in merge joins at every size
    spans = spans_of(texts.join(by_doc.hint("merge"), "doc_id"), length, gram)
    most = groups.agg(F.max("size")).first()[0] or 0
    if most <= members:
        runs = [stage(finished(spans, length), "runs")]
    else:
        runs = open_runs(stage(spans.join(groups.withColumnRenamed("anchor", "cell"), "cell"), "open"), length, members)
    start, count = F.floor(F.col("at") / LEAD).cast("long"), F.floor(F.col("at") / COUNT).cast("long") % 256
    plain = lambda df, kind: df.select("doc_id", F.lit(kind).cast("byte").alias("kind"), start.alias("start"),
        (start + count + (length - 1)).alias("end"))
    marks = plain(met, 1).unionByName(plain(buckets.where(single).select("one.doc_id", "one.at"), 0))
    for r in runs:
        marks = marks.unionByName(r.select("doc_id", F.lit(2).cast("byte").alias("kind"), "start", "end"))
    runs_of_texts = joined_runs(joined_runs(standing(marks).withColumn("part", F.floor(F.col("start") / PART)), "doc_id", "part"), "doc_id")
    spans = stage(runs_of_texts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "spans")
    unstage(twice, met, buckets, groups, chosen, *runs)
    everything = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return everything.join(spans.hint("merge"), "doc_id", "left").mapInArrow(cut_out,
        "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


#: Bytes of a text whose marks are merged in one task.
PART = 1 << 20
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def standing(marks: DataFrame) -> DataFrame:
    """The distinct (doc_id, start, end) of marks that stay: those of kind 2, and of kind 1 if there are more of it than of kind 0.

    Equal marks, of the copies of a row say, are counted before they are shuffled.
    """
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    counted = marks.groupBy("doc_id", "start", "end").agg(n(0).alias("zeros"), n(1).alias("ones"), n(2).alias("twos"))
    return counted.where((F.col("twos") > 0) | (F.col("ones") > F.col("zeros"))).select("doc_id", "start", "end")


def joined_runs(rows: DataFrame, *by: str) -> DataFrame:
    """(by, start, end): the maximal runs of what overlaps or touches among rows of equal ``by``.

    Done by parts of PART bytes first, so that a text of millions of marks is dealt over tasks, and what all of it needs
    in one task is a few runs of each part.
    """
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    numbered = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    for b in batches:
        n_bytes, removed, spans, kept = [], [], [], []
        for text, cuts in zip(b.column("text"), b.column("spans"), strict=True):
            raw, at, parts = text.as_buffer().to_pybytes(), 0, []
            cuts = [(c["start"], min(c["end"], len(raw))) for c in cuts.as_py() or [] if c["start"] < len(raw)]
            for a, z in cuts:
                parts.append(raw[at:a])
                at = z
            parts.append(raw[at:])
            n_bytes.append(len(raw))
            removed.append(sum(z - a for a, z in cuts))
            spans.append([{"start": a, "end": z} for a, z in cuts])
            kept.append(b"".join(parts))
        columns = [b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names)
