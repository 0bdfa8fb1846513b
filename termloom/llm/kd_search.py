"""Exact top-k by inner product over KD-trees, one per shard of the vectors.

Each task turns its rows into trees of at most ``shard_rows`` vectors: median splits of the widest dimension, with tight
bounding boxes. A block of queries is searched best first: a node's bound is the largest inner product that any point of
its box can have with the query, and nodes under the kth score found so far are left out. Every block first meets the tree
of its home; then, in rounds, three, twelve, ... more, and the kth scores of all trees so far go with it to each round. A
tree is read once in a task, and the blocks that meet it there stream past.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unstage

LEAF = 256
#: Up to this size of a component, sums of products of doubles are exact for up to 128 dimensions.
EXACT = 1 << 23


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<i8").tobytes()


def narrow(x: np.ndarray) -> tuple[bytes, str]:
    kind = "<i2" if not x.size or np.abs(x).max() < 1 << 15 else "<i8"
    return np.ascontiguousarray(x, kind).tobytes(), kind


class Tree:
    """ids and vectors in leaf order; nodes as (start, end, left, right) with boxes lo and hi. left is -1 at leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order, self.lo, self.hi, self.nodes = np.arange(len(ids)), [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            own = vectors[order[start:end]]
            lo, hi = own.min(0), own.max(0)
            me = len(self.nodes)
            self.nodes.append([start, end, -1, -1])
            self.lo.append(lo)
            self.hi.append(hi)
            if parent >= 0:
                self.nodes[parent][2 + side] = me
            axis = int((hi - lo).argmax())
            if end - start > LEAF and hi[axis] > lo[axis]:
                middle = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(own[:, axis], middle)]
                todo += [(start, start + middle, me, 0), (start + middle, end, me, 1)]
        self.ids, self.vectors = ids[order], vectors[order]

    def row(self) -> dict:
        vectors, kind = narrow(self.vectors)
        return {"ids": packed(self.ids), "vectors": vectors, "vector_kind": kind, "nodes": packed(np.array(self.nodes)),
            "lo": packed(np.array(self.lo)), "hi": packed(np.array(self.hi)), "width": self.vectors.shape[1]}


def pad(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


class Decoded:
    """A tree's row, read once and searched by any number of blocks."""

    def __init__(self, row: dict):
        self.width = row["width"]
        read = lambda name, kind="<i8": np.frombuffer(row[name], kind).reshape(-1, row["width"]).astype(np.int64)
        self.ids, self.nodes = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nodes"], "<i8").reshape(-1, 4)
        self.vectors, self.lo, self.hi = read("vectors", row["vector_kind"]), read("lo"), read("hi")
        self.exact = max(np.abs(x).max(initial=0) for x in (self.lo, self.hi)) <= EXACT
        self.doubles = tuple(x.astype(np.float64) for x in (self.vectors, self.lo, self.hi)) if self.exact else None

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query the (score, -id) of its k best of the tree that reach ``least``, in no order."""
        width = max(self.width, queries.shape[1])
        ids, nodes, queries = self.ids, self.nodes, pad(queries.astype(np.int64), width)
        vectors, lo, hi = self.vectors, self.lo, self.hi
        if self.exact and width <= 128 and np.abs(queries).max(initial=0) <= EXACT:
            (vectors, lo, hi), queries = self.doubles, queries.astype(np.float64)
        if width > self.width:
            vectors, lo, hi = (pad(x, width) for x in (vectors, lo, hi))
        bounds = np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T
        out = []
        for q in range(len(queries)):
            best: list[tuple[int, int]] = []
            floor, heap, bound, vector = int(least[q]), [(-bounds[q, 0], 0)], bounds[q], queries[q]
            while heap:
                top, node = heapq.heappop(heap)
                if -top < floor:
                    break
                start, end, left, right = nodes[node]
                if left >= 0:
                    for child in (left, right):
                        if bound[child] >= floor:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                score, own = (vectors[start:end] @ vector).astype(np.int64), ids[start:end]
                ok = (score >= floor) & (own != query_ids[q])
                score, own = score[ok], own[ok]
                if len(score) > k:
                    pick = np.lexsort((own, -score))[:k]
                    score, own = score[pick], own[pick]
                for pair in zip(score.tolist(), (-own).tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, pair)
                    elif pair > best[0]:
                        heapq.heapreplace(best, pair)
                if len(best) == k:
                    floor = max(floor, best[0][0])
            out.append(best)
        return out


def components(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, floor(256 x) padded with zeros to one width) of the vectors without null or non-finite components."""
    rows = [(i, v) for i, v in enumerate(column.to_numpy(zero_copy_only=False)) if v is not None]
    good = [(i, f) for i, v in rows if np.isfinite(f := np.asarray(v, np.float64)).all()]
    width = max((len(f) for _, f in good), default=0)
    out = np.zeros((len(good), max(width, 1)))
    for r, (_, f) in enumerate(good):
        out[r, : len(f)] = f
    scaled = np.floor(out * 256)
    if scaled.size and np.abs(scaled).max() >= 2.0**31 / np.sqrt(scaled.shape[1]):
        raise ValueError("components are so large that an inner product may not fit into a long")
    return np.array([i for i, _ in good], np.int64), scaled.astype(np.int64)


TREE = "shard long, ids binary, vectors binary, vector_kind string, nodes binary, lo binary, hi binary, width int"


def build(vectors: DataFrame, shard_rows: int) -> DataFrame:
    """One row per tree. Rows of the same id and vector count once in a tree."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, ids, held = TaskContext.get().partitionId(), 0, [], []

        def tree() -> pa.RecordBatch:
            width = max(h.shape[1] for h in held)
            i, v = np.concatenate(ids), np.concatenate([pad(h, width) for h in held])
            if len(np.unique(i)) < len(i):
                both = np.unique(np.column_stack([i, v]), axis=0)
                i, v = both[:, 0], both[:, 1:]
            row = {"shard": (part << 32) + made} | Tree(i, v).row()
            return pa.RecordBatch.from_pylist([row],
                pa.schema([("shard", pa.int64()), *((n, pa.binary()) for n in ("ids", "vectors")), ("vector_kind", pa.string()),
                *((n, pa.binary()) for n in ("nodes", "lo", "hi")), ("width", pa.int32())]))

        for b in batches:
            for s in range(0, len(b), shard_rows):
                part_batch = b.slice(s, shard_rows)
                rows, x = components(part_batch.column("embedding"))
                if len(rows):
                    ids.append(part_batch.column("vec_id").to_numpy(zero_copy_only=False)[rows].astype(np.int64))
                    held.append(x)
                if sum(map(len, ids)) >= shard_rows:
                    yield tree()
                    made, ids, held = made + 1, [], []
        if ids:
            yield tree()

    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), "embedding").mapInArrow(trees, TREE)


BLOCK = "block long, query_ids binary, queries binary, query_kind string"
HITS = "block long, pos int, query_id long, vec_id long, score long"


def blocks_of(queries: DataFrame, block_rows: int) -> DataFrame:
    """One row per block of queries."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            rows, x = components(b.column("embedding"))
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            for s in range(0, len(rows), block_rows):
                own = slice(s, s + block_rows)
                vectors, kind = narrow(x[own])
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n]), pa.array([packed(ids[own])], pa.binary()),
                    pa.array([vectors], pa.binary()), pa.array([kind])], [c.split()[0] for c in BLOCK.split(", ")])
                n += 1

    known = queries.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), "embedding")
    return known.mapInArrow(made, BLOCK)


def dense(df: DataFrame, name: str, to: str) -> DataFrame:
    """``df`` with its numbers ``name``, (task << 32) + place, as numbers without gaps in column ``to``."""
    task = F.shiftright(name, 32)
    sizes = df.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))  # a row for each task that made any
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return df.withColumn("_task", task).join(F.broadcast(base), "_task").withColumn(to,
        F.col("_base") + F.col(name).bitwiseAND(F.lit((1 << 32) - 1))).drop("_task", "_base")


def found(met: DataFrame, k: int) -> DataFrame:
    """The hits of every block in its cell's tree; met: partitions in which each (cell, salt) is its tree's row, then the blocks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, cell = None, None
        for b in batches:
            for row in range(len(b)):
                r = {c: b.column(c)[row].as_py() for c in b.schema.names}
                if r["kind"] == 0:
                    tree, cell = Decoded(r), r["cell"]
                    continue
                if r["cell"] != cell:
                    raise ValueError("a block came before its tree")
                ids = np.frombuffer(r["query_ids"], "<i8")
                least = np.full(len(ids), np.iinfo(np.int64).min)
                for x in r["kth"] or []:
                    least[x["pos"]] = x["score"]
                best = tree.search(ids, np.frombuffer(r["queries"], r["query_kind"]).reshape(len(ids), -1), least, k)
                flat = np.array([(q, -i, s) for q, hits in enumerate(best) for s, i in hits], np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(flat), r["block"])), pa.array(flat[:, 0].astype(np.int32)), pa.array(ids[flat[:, 0]]), pa.array(flat[:, 1]),
                        pa.array(flat[:, 2])],
                    [c.split()[0] for c in HITS.split(", ")])

    return met.mapInArrow(run, HITS)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 1 << 15, block_rows: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query's floor(256 x) with all others'.

    Both tables have vec_id and embedding; other columns are ignored. Ties go to the smaller vec_id, a query's own id is
    left out, and fewer candidates give fewer rows. Rows with a null id, a null vector or a null or non-finite component
    take no part; a shorter vector counts as padded with zeros; a repeated row counts once; no rows give none. Finite
    components so large that an inner product may not fit into a long (2^28 for 64 of them, times 256) are an error.
    """
    made = stage(build(vectors, shard_rows), "trees")
    asked = stage(blocks_of(queries, block_rows), "blocks")
    cells, blocks = made.count(), asked.count()
    if not cells or not blocks:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    trees = dense(made, "shard", "cell").drop("shard")
    home = F.pmod(F.xxhash64("block"), F.lit(cells))
    # where trees are fewer than tasks, several tasks take one, each with a share of the blocks
    salts = max(1, min(blocks, -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // cells)))
    own, other = [c.split()[0] for c in TREE.split(", ")[1:]], [c.split()[0] for c in BLOCK.split(", ")]
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in [*TREE.split(", ")[1:], *BLOCK.split(", ")]}
    none["kth"] = F.lit(None).cast("array<struct<pos:int,score:long>>")
    side = trees.select("cell", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), *own,
        *(none[c].alias(c) for c in [*other, "kth"]))
    best, first, width = None, 0, 1
    while first < cells:
        steps = F.sequence(F.lit(first), F.lit(min(first + width, cells) - 1))
        ready = asked if best is None else asked.join(best.where(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("pos",
            "score")).alias("kth")), "block", "left")
        if best is None:
            ready = ready.withColumn("kth", none["kth"])
        copies = ready.withColumn("step", F.explode(steps)).withColumn("cell", F.pmod(home + F.col("step"), F.lit(cells)))
        copies = copies.select("cell", F.pmod(F.xxhash64("block", "cell"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"),
            *(none[c].alias(c) for c in own), *other, "kth")
        hits = found(side.unionByName(copies).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind"), k)
        known = hits if best is None else hits.unionByName(best.drop("rank"))
        best_now = stage(ranked(known.distinct(), k, "block", "pos"), "best")
        if best is not None:
            unstage(best)
        best, first, width = best_now, first + width, 4 * width if first else 3
    unstage(made, asked)
    return ranked(best.select("query_id", "vec_id", "score").distinct(), k, "query_id").select("query_id", "rank", "vec_id", "score")


def ranked(hits: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
