"""Near-duplicate documents by SetSketch registers, banded, estimated and verified.

A document is its set of word shingles. Each of REGISTERS registers keeps the least of the exponentially distributed
hashes of the set's elements, truncated to a power of BASE: registers of unions are maxima, and equal registers are
likelier the more alike two sets are. Documents that agree in a whole band of registers meet; the Jaccard similarity of
two that meet is estimated from all registers by maximum likelihood, and what may be near enough is verified on the full
sets. Only components are asked for, so links within one are not looked for again:

1. documents of one set are one class; everything below is between classes;
2. in every bucket (band, value) each class is compared with the smallest class; a class takes the label of the smallest
   class that two such links lead to;
3. buckets that still hold several labels are compared block by block, all pairs of different labels, and each pair of
   blocks gives back only the links that join labels;
4. the links of 2 and 3 make the components, in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stage, unstage
from .components import stars
from .textual import LOWER, M1, U, distinct_by_text, mix, segment_hash, shingles, slices, utf8, words

#: Bands of ROWS registers each. A pair of similarity 0.8 misses all bands with probability under (1 - 0.8 ** 4) ** 28 = 4e-7.
BANDS, ROWS = 28, 4
REGISTERS = BANDS * ROWS
#: Registers hold floor(1 - log_BASE of the least exponential hash of rate RATE), from 0 to LIMIT.
BASE, RATE, LIMIT = 1.001, 20, 60000
SEEDS = mix((np.arange(REGISTERS, dtype=U) + U(7)) * M1)
#: Classes in a block of step 3, and about the bytes of their sets.
BLOCK, BLOCK_BYTES = 256, 8 << 20
#: How far under the asked similarity an estimate may lie for the pair to be verified: over four and a half of its deviations.
SLACK = 0.18


def registers(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint16 registers [texts, REGISTERS] of sets given as 64-bit hashes in a row; an empty set has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    low = (sets >> U(32)).astype(np.uint32)
    starts = offsets[:-1][full]
    factors, shifts = (SEEDS >> U(32)).astype(np.uint32) | np.uint32(1), SEEDS.astype(np.uint32)
    for k in range(REGISTERS):
        h = low ^ shifts[k]
        h *= factors[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        uniform = (np.minimum.reduceat(h, starts).astype(np.float64) + 0.5) / 2**32
        exponential = -np.log1p(-uniform) / RATE
        out[full, k] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT)
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """int64 keys [texts, BANDS] of the registers' bands."""
    value = np.zeros((len(sketch), BANDS), U)
    for k in range(ROWS):
        value = mix(value * M1 + sketch[:, k::ROWS][:, :BANDS].astype(U) + U(1))
    return mix(value + np.arange(BANDS, dtype=U) * M1).view(np.int64)


def likely(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, steps: int = 12) -> np.ndarray:
    """The maximum-likelihood Jaccard similarity of pairs of sketches, from how many registers are greater, less and equal.

    With u and v the shares of each set in the union, a register is greater in the first with probability
    p(u - v j'), where p(x) = -log_BASE(1 - x (BASE - 1) / BASE), and likewise less in the second; the log-likelihood is
    maximised over j by golden sections.
    """
    more, less = (a > b).sum(-1), (a < b).sum(-1)
    same = REGISTERS - more - less
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def loss(j: np.ndarray) -> np.ndarray:
        x, y = p(u - v * j), p(v - u * j)
        return -(more * np.log(x + 1e-12) + less * np.log(y + 1e-12) + same * np.log(np.maximum(1 - x - y, 1e-12)))

    lo, hi, gold = np.zeros_like(top), top.copy(), (5**0.5 - 1) / 2
    for _ in range(steps):
        c, d = hi - gold * (hi - lo), lo + gold * (hi - lo)
        left = loss(c) < loss(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(data, offsets)
    values, owner = shingles(segment_hash(LOWER[data], starts, ends), first, size)
    return distinct_by_text(values, owner, len(offsets) - 1)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch) of every row; digest names the set."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, d, o in slices(*utf8(b.column("text")), texts=4096):
                sets, at = shingle_sets(d, o, size)
                total = np.concatenate([np.zeros(1, U), np.cumsum(mix(sets * M1), dtype=U)])
                other = np.concatenate([np.zeros(1, U), np.cumsum(mix(sets + M1), dtype=U)])
                digests = np.column_stack([total[at[1:]] - total[at[:-1]], other[at[1:]] - other[at[:-1]]])
                regs = registers(sets, at)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(np.diff(at)),
                    pa.array([x.tobytes() for x in digests], pa.binary()), pa.array([x.tobytes() for x in regs], pa.binary())],
                    ["doc_id", "n_shingles", "digest", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "doc_id long, n_shingles long, digest binary, sketch binary")


def banded(classes: DataFrame) -> DataFrame:
    """(key, doc, n): a row for every class and band."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = band_keys(np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS))
            columns = [k.ravel(), np.repeat(b.column("doc").to_numpy(), BANDS), np.repeat(b.column("n").to_numpy(), BANDS)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "doc", "n"])

    return classes.select("doc", "n", "sketch").mapInArrow(keys, "key long, doc long, n long")


def promising(pairs: DataFrame, classes: DataFrame, percent: int, slack: float = SLACK) -> DataFrame:
    """The pairs (a, b) whose estimate is at most ``slack`` under the asked similarity."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch", "sketch_b"))
                m, n = (b.column(c).to_numpy().astype(float) for c in ("n", "n_b"))
                ok = likely(x, y, m, n) >= percent / 100 - slack
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    side = classes.select("doc", "n", "sketch")
    met = pairs.join(side.withColumnRenamed("doc", "a"),
        "a").join(side.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b")
    return met.select("a", "b", "n", "n_b", "sketch", "sketch_b").mapInArrow(estimate, "a long, b long")


def sizes_allow(m: str, n: str, percent: int) -> Column:
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def full_sets(docs: DataFrame, wanted: DataFrame, most: int, size: int) -> DataFrame:
    """(doc, shingles binary) of the documents of ``wanted`` (doc; at most so many rows), from their texts."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, d, o in slices(*utf8(b.column("text")), texts=4096):
                sets, at = shingle_sets(d, o, size)
                yield pa.RecordBatch.from_arrays([b.column("doc").slice(i, j - i),
                    pa.array([sets[at[k] : at[k + 1]].tobytes() for k in range(j - i)], pa.binary())], ["doc", "shingles"])

    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), "text")
    return texts.join(maybe_broadcast(wanted, most, 16), "doc").mapInArrow(made, "doc long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(bool(linked(common, len(p), len(q), percent)))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    met = pairs.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y")),
        "b").join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a")
    return met.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def block_links(pairs: DataFrame, percent: int) -> DataFrame:
    """Links that join labels, between the classes of two blocks (left, right: doc, part, shingles)."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x, y in zip(frame["left"], frame["right"], strict=True):
                a, b = ([np.frombuffer(m["shingles"], U) for m in side] for side in (x, y))
                out, parent = [], {}

                def find(p: int) -> int:
                    while parent.get(p, p) != p:
                        p = parent[p]
                    return p

                common = common_values(a, b)
                size_a, size_b = np.array([len(v) for v in a]), np.array([len(v) for v in b])
                for p, q in np.argwhere(linked(common, size_a[:, None], size_b[None, :], percent)):
                    m, n = find(x[p]["part"]), find(y[q]["part"])
                    if m != n:
                        parent[m] = n
                        out.append((x[p]["doc"], y[q]["doc"]))
                yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return pairs.select("left", "right").mapInPandas(compare, "a long, b long")


def common_values(a: list[np.ndarray], b: list[np.ndarray], width: int = 1 << 13) -> np.ndarray:
    """How many values each set of ``a`` has in common with each of ``b``; a matrix product over ``width`` values at once."""
    values = np.unique(np.concatenate(a + b), return_inverse=True)[1]
    rows = np.repeat(np.arange(len(a) + len(b)), [len(v) for v in a + b])
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    out = np.zeros((len(a), len(b)))
    for start in range(0, int(values[-1]) + 1, width):
        lo, hi = np.searchsorted(values, [start, start + width])
        part = np.zeros((len(a) + len(b), min(width, int(values[-1]) + 1 - start)), np.float32)
        part[rows[lo:hi], values[lo:hi] - start] = 1
        out += part[: len(a)] @ part[len(a) :].T
    return np.rint(out).astype(np.int64)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Words are lower-cased (A-Z) and split at the six ASCII separators; a text of fewer than ``size`` words, but some, has
    its whole sequence as only shingle; one without words has none and is alone in its component. Two documents are
    linked where ``percent`` % of the union of their sets is common. component_id is the smallest doc_id reachable.
    Rows that repeat an id and a text are one document; rows that share an id only are linked by it; rows without an id
    are alone, with component null.
    """
    sketches = stage(sketch(docs, size), "sketches")
    named = sketches.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    one = F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("m")
    classes = stage(named.groupBy("digest").agg(one).select("digest", F.col("m.doc_id").alias("doc"), F.col("m.n_shingles").alias("n"),
        F.col("m.sketch").alias("sketch")), "classes")
    plain = classes.drop("digest")
    keys = banded(plain)
    least = F.min(F.struct("doc", "n")).alias("least")
    buckets = stage(keys.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("values"), least).where(F.col("members") > 1), "buckets")
    met = stage(keys.join(buckets, "key"), "met")

    first = met.where((F.col("doc") != F.col("least.doc")) & sizes_allow("n", "least.n", percent)).select(F.col("least.doc").alias("a"),
        F.col("doc").alias("b")).distinct()
    tried = stage(promising(first, plain, percent), "pairs")
    sets = stage(full_sets(docs, tried.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), 2 * tried.count(), size), "sets")
    links = stage(verified(tried, sets, percent), "links")
    unstage(tried, sets, buckets)

    parent = links.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("up"))
    top = parent.select(F.col("doc").alias("up"), F.col("up").alias("top"))
    label = stage(parent.join(top, "up", "left").select("doc", F.coalesce("top", "up").alias("part")), "label")
    parts = stage(met.where(F.col("members") > 2).select("key", "doc", "members", "values").join(label, "doc", "left").withColumn("part",
        F.coalesce("part", "doc")), "parts")
    more = remaining(docs, parts, plain, size, percent)

    member = stage(named.select("doc_id", "digest").join(classes.select("digest", F.col("doc").alias("node")), "digest").select("doc_id", "node"), "member")
    several = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where(F.col("a") != F.col("b")).select("doc_id", "a")
    shared = member.join(several, "doc_id").select("a", F.col("node").alias("b"))
    # links within a label say nothing more
    ends = links.unionByName(more).unionByName(shared)
    for end in ("a", "b"):
        ends = ends.join(label.select(F.col("doc").alias(end), F.col("part").alias("part")), end, "left").withColumn(end, F.coalesce("part", end)).drop("part")
    found = stars(ends)
    placed = member.join(label.withColumnRenamed("doc", "node"), "node", "left").select("doc_id", F.coalesce("part", "node").alias("node"))
    least = placed.join(found, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    unstage(met, parts, links, classes)
    return sketches.select("doc_id", "n_shingles").join(least, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def remaining(docs: DataFrame, parts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between different labels of a bucket that no star has shown; parts: key, doc, members, values, part.

    A bucket is dealt over blocks of about BLOCK classes and BLOCK_BYTES bytes of sets; every two blocks meet in a task
    of their own. Classes whose sketches are far from all classes of other labels don't get any further.
    """
    still = stage(parts.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where(F.col("low") != F.col("high")).select("key"), "still")
    number = F.ceil(F.greatest(F.col("members") / BLOCK, 8 * F.col("values") / BLOCK_BYTES)).cast("int")
    block = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("i")
    rows = parts.join(still, "key").join(classes, "doc").withColumn("blocks", number).select("key", "blocks", block,
        F.struct("doc", "part", "n", "sketch").alias("m"))
    blocks = stage(rows.groupBy("key", "blocks", "i").agg(F.collect_list("m").alias("left")), "blocks")
    alone = blocks.where(F.col("blocks") == 1).select("key", "i", F.col("i").alias("j"), "left", F.col("left").alias("right"))
    many = blocks.where(F.col("blocks") > 1)
    left = many.select("key", "i", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"), "left")
    right = many.select("key", F.explode(F.sequence(F.lit(0), "i")).alias("i"), F.col("i").alias("j"), F.col("left").alias("right"))
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism  # dealt by number: the rows are small, the work on them is not
    pairs = alone.unionByName(left.join(right, ["key", "i", "j"])).repartition(tasks, "key", "i", "j")

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                x, y = r["left"], r["right"]
                sx, sy = (np.frombuffer(b"".join(m["sketch"] for m in s), np.uint16).reshape(-1, REGISTERS) for s in (x, y))
                nx, ny = (np.array([m["n"] for m in s], float) for s in (x, y))
                px, py = (np.array([m["part"] for m in s]) for s in (x, y))
                p, q = np.nonzero((px[:, None] != py[None, :]) & (100 * np.minimum(nx[:, None], ny) >= percent * np.maximum(nx[:, None], ny)))
                if r["i"] == r["j"]:
                    p, q = p[p < q], q[p < q]
                kx, ky, keep = band_keys(sx), band_keys(sy), np.zeros(len(p), bool)
                for s in range(0, len(p), 1 << 14):
                    t = np.arange(s, min(s + (1 << 14), len(p)))
                    # a pair counts in the first band that it shares; the other buckets leave it out
                    t = t[kx[p[t], (kx[p[t]] == ky[q[t]]).argmax(1)] == r["key"]]
                    keep[t] = likely(sx[p[t]], sy[q[t]], nx[p[t]], ny[q[t]]) >= percent / 100 - SLACK
                p, q = p[keep], q[keep]
                out = {(r["key"], r["i"], r["j"], side, s[k]["doc"], s[k]["part"]) for side, s, ks in ((0, x, p), (1, y, q)) for k in ks.tolist()}
                yield pd.DataFrame(sorted(out), columns=["key", "i", "j", "side", "doc", "part"]).astype("int64")

    members = stage(pairs.mapInPandas(near, "key long, i long, j long, side long, doc long, part long"), "members")
    # Pairs of blocks with the same members on both sides are compared once.
    sides = members.groupBy("key", "i", "j").agg(F.min("doc").alias("low"), F.count("*").alias("rows"),
        F.sum(F.xxhash64("side", "doc").cast("decimal(38,0)")).alias("name"))
    once = sides.groupBy("low", "rows", "name").agg(F.min(F.struct("key", "i", "j")).alias("k")).select("k.key", "k.i", "k.j")
    chosen = stage(members.join(once, ["key", "i", "j"]), "members")
    unstage(members, blocks, still)
    sets = stage(full_sets(docs, chosen.select("doc").distinct(), chosen.count(), size), "sets")
    place = F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j"))
    held = chosen.select("key", place.alias("i"), "doc", "part").distinct().join(sets, "doc")
    held = stage(held.groupBy("key", "i").agg(F.collect_list(F.struct("doc", "part", "shingles")).alias("left")), "held")
    wanted = chosen.select("key", "i", "j").distinct()
    filled = wanted.join(held, ["key", "i"]).join(held.select("key", F.col("i").alias("j"), F.col("left").alias("right")), ["key", "j"])
    out = stage(block_links(filled, percent), "links")
    unstage(chosen, sets, held)
    return out
