"""Source divergence audit: how far each source's use of words is from that of the other sources of its language.

Term counts come from single-pass in-memory indexing. A task builds a block of postings in memory; when the block is full
it leaves the task as a run, sorted by term and cut by hash shard. In a shard the runs' pieces come in order of their first
terms and are merged, band of terms by band, so that a term's counts of all runs come together. Differences between sources are summed
from constants for terms that neither has, corrected by what the terms of one and the terms of both change; the latter
stream by in blocks of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, stage, unstage
from .textual import LOWER, mix, runs, segment_hash, slices, utf8

#: Letters A-Z and a-z, and the bytes of all characters that are not ASCII.
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True
#: Bytes and texts of a block in memory; terms of a piece of a run, and of what is merged at a time; pairs that are made at a time; tokens encoded at a time.
BLOCK, TEXTS, PIECE, BAND, PAIRS, PART = 1 << 23, 1 << 17, 1 << 11, 1 << 18, 1 << 19, 1 << 17
UNIT = 1_000_000_000
RUN = "shard int, lang string, first string, names array<string>, terms array<string>, counts array<int>, docs array<int>, postings array<binary>"


def encoded(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each text's number and the distinct texts; parts are encoded first, as their tables stay in the cache."""
    parts = [texts.slice(i, PART).dictionary_encode() for i in range(0, max(len(texts), 1), PART)]
    whole = pa.concat_arrays([p.dictionary for p in parts]).dictionary_encode()
    number, before = whole.indices.to_numpy(), np.cumsum([0, *(len(p.dictionary) for p in parts)])
    return np.concatenate([number[n:][p.indices.to_numpy()] for p, n in zip(parts, before[:-1], strict=True)]), whole.dictionary


def run_pieces(lang: pa.Array, source: pa.Array, data: np.ndarray, offsets: np.ndarray, shards: int) -> pa.RecordBatch:
    """The run of some texts: by language and shard the terms in order, in pieces.

    A term has its count, how many documents have it, and its postings: pairs of a source, by its number among the piece's
    names, and its count. One sort of the terms by shard and one of the tokens by language, term and document put all in order.
    """
    inside = TERM[data]
    starts, ends = runs(inside, offsets)
    ends_at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    code, terms = encoded(pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends_at), pa.py_buffer(LOWER[data[inside]])))
    shard = (mix(segment_hash(*_segments(terms))) % np.uint64(shards)).astype(np.min_scalar_type(shards))
    order = pc.array_sort_indices(terms).to_numpy()
    order = order[np.argsort(shard[order], kind="stable")]
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    kinds = [c.dictionary_encode() for c in (lang, source)]
    codes = [k.indices.to_numpy().astype(np.int64) for k in kinds]
    docs = np.lexsort(codes[::-1])  # of one language and source in a row
    place = np.empty(len(docs), np.int64)
    place[docs] = np.arange(len(docs))
    bits, low = len(order).bit_length(), len(docs).bit_length()
    token = np.repeat(codes[0] << (bits + low) | place, np.diff(np.searchsorted(starts, offsets)))
    token |= number[code] << low
    token.sort()
    cell = _changes(token)  # of a term and a document
    found = token[cell]
    doc, found = docs[found & ((1 << low) - 1)], found >> low
    posting, own = _changes(found, codes[1][doc]), _changes(found)  # of a term and a source; of a term
    term, kind = order[found[own] & ((1 << bits) - 1)], doc[own]
    at = shard[term]
    border = np.append(_changes(codes[0][kind], at), len(own))
    cuts = np.concatenate([*(np.arange(a, b, PIECE) for a, b in zip(border[:-1], border[1:], strict=True)), [len(own)]]).astype(np.int32)
    begin, tokens_at = cuts[:-1], np.append(cell, len(token))
    firsts = np.searchsorted(posting, np.append(own, len(cell)))  # a term's postings
    n = len(kinds[1].dictionary)
    name, number = np.unique(np.repeat(np.arange(len(begin)), np.diff(firsts[cuts])) * n + codes[1][doc[posting]], return_inverse=True)
    names_at = np.searchsorted(name, np.arange(len(begin) + 1) * n)
    pairs = np.empty((len(posting), 2), np.int32)
    pairs[:, 0] = number - np.repeat(names_at[:-1], np.diff(firsts[cuts]))
    pairs[:, 1] = np.diff(tokens_at[np.append(posting, len(cell))])
    columns = [terms.take(pa.array(term)), _int(np.diff(tokens_at[np.append(own, len(cell))])), _int(np.diff(np.append(own, len(cell)))), _binary(pairs, firsts)]
    return pa.RecordBatch.from_arrays([_int(at[begin]), lang.take(pa.array(kind[begin])), columns[0].take(pa.array(begin)),
        pa.ListArray.from_arrays(_int(names_at), kinds[1].dictionary.take(pa.array(name % max(n, 1)))), *(pa.ListArray.from_arrays(pa.array(cuts), c) for c in columns)],
        ["shard", "lang", "first", "names", "terms", "counts", "docs", "postings"])


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _binary(pairs: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """The pairs from each of ``firsts`` to the next as one value."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(firsts) - 1, [None, pa.py_buffer((firsts * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(pairs))])


def _pairs(postings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of what ``_binary`` gives, and where each value's begin."""
    _, offsets, data = postings.buffers()
    firsts = np.frombuffer(offsets, np.int32)[postings.offset : postings.offset + len(postings) + 1] // 8
    return np.frombuffer(data, np.int32).reshape(-1, 2)[firsts[0] : firsts[-1]], firsts - firsts[0]


def _segments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = utf8(texts)
    return data, offsets[:-1], offsets[1:]


def _changes(*keys: np.ndarray) -> np.ndarray:
    """The places at which a stretch of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def index(batches: Iterator[pa.RecordBatch], shards: int, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The runs of a task's documents (lang, source, text): one for every block of texts, and a larger text is a block of its own."""
    held: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []

    def run() -> pa.RecordBatch:
        langs, sources, data, offsets = zip(*held, strict=True)
        before = np.cumsum([0, *map(len, data)])
        return run_pieces(pa.concat_arrays(langs), pa.concat_arrays(sources), np.concatenate(data),
            np.concatenate([[0], *(o[1:] + n for o, n in zip(offsets, before[:-1], strict=True))]), shards)

    for b in batches:
        for i, j, d, o in slices(*utf8(b.column("text")), limit=max(block // 8, 1), texts=TEXTS):
            if held and (sum(len(x[2]) for x in held) + len(d) > block or sum(len(x[0]) for x in held) + j - i > TEXTS):
                yield run()
                held = []
            held.append((b.column("lang").slice(i, j - i), b.column("source").slice(i, j - i), d, o))
    if held:
        yield run()


def bands(pieces: Iterator[tuple[str, str, pa.Table]], size: int = BAND) -> Iterator[pa.Table]:
    """The rows of pieces, which come by (language, first term), in tables that hold all rows of the terms they hold.

    The next piece's first term is a bound: what is under it, or of another language, is whole and leaves. That is looked
    at when ``size`` rows have come, and no fewer than were left the time before, so that a row is looked at
    about twice, however many pieces are open at once. A language's rows stay together.
    """
    held: list[tuple[str, pa.Table]] = []
    new = left = 0
    for lang, first, table in pieces:
        if held and held[-1][0] != lang:
            left = 0
        if new >= max(size, left):
            done, own = [t for k, t in held if k != lang], [t for k, t in held if k == lang]
            held = []
            if own:
                whole = pa.concat_tables(own)
                under = pc.less(whole["term"], first)
                done.append(whole.filter(under))
                held = [(lang, whole.filter(pc.invert(under)))]
            if any(map(len, done)):
                yield pa.concat_tables(done)
            new, left = 0, sum(len(t) for _, t in held)
        held.append((lang, table))
        new += len(table)
    if held:
        yield pa.concat_tables([t for _, t in held])


def merge(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, count, total, head) of the terms that enough documents have; total is the language's count, head marks one row of each term."""
    langs: list[str] = []
    sources: dict[str, int] = {}  # of one shard, numbered as they come

    def pieces() -> Iterator[tuple[str, str, pa.Table]]:
        for b in batches:
            names, lists = b.column("names").flatten().dictionary_encode(), b.column("names")
            known = np.array([sources.setdefault(x, len(sources)) for x in names.dictionary.to_pylist()], np.int32)[names.indices.to_numpy()]
            ends, names_at = (np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy())]) for x in (b.column("terms"), lists))
            *columns, postings = (b.column(c).flatten() for c in ("terms", "counts", "docs", "postings"))
            pairs, firsts = _pairs(postings)
            pairs = pairs.copy()
            pairs[:, 0] = known[pairs[:, 0] + np.repeat(names_at[:-1], np.diff(firsts[ends]))]
            columns.append(_binary(pairs, firsts))
            begins = _changes(b.column("lang").dictionary_encode().indices.to_numpy())
            for i, j in zip(begins, np.append(begins[1:], len(b)), strict=True):  # a language's pieces go on together
                lang, first, n = b.column("lang")[i].as_py(), b.column("first")[i].as_py(), ends[j] - ends[i]
                if lang not in langs[-1:]:
                    langs.append(lang)
                yield lang, first, pa.table([pa.repeat(len(langs) - 1, n), *(c.slice(ends[i], n) for c in columns)], ["lang", "term", "count", "docs", "postings"])

    for band in bands(pieces()):
        number = band["lang"].to_numpy()
        begins = _changes(number)
        for i, j in zip(begins, np.append(begins[1:], len(band)), strict=True):
            own = band.slice(i, j - i).combine_chunks()
            code, terms = encoded(own["term"].combine_chunks())
            docs, total = (np.bincount(code, own[c].to_numpy(), len(terms)) for c in ("docs", "count"))  # sums under 2^53 are exact
            there = (docs >= least_docs)[code]
            if not there.any():
                continue
            pairs, firsts = _pairs(own["postings"].combine_chunks().filter(pa.array(there)))
            n = len(sources)
            key, at = np.unique(np.repeat(code[there].astype(np.int64), np.diff(firsts)) * n + pairs[:, 0], return_inverse=True)
            term, head = key // n, np.zeros(len(key), bool)
            head[_changes(term)] = True
            yield pa.RecordBatch.from_arrays([pa.repeat(langs[number[i]], len(key)), terms.take(pa.array(term)), pa.array(list(sources), pa.string()).take(pa.array(key % n)),
                pa.array(np.bincount(at, pairs[:, 1]).astype(np.int64)), pa.array(total.astype(np.int64)[term]), pa.array(head)], ["lang", "term", "source", "count", "total", "head"])


def both_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, delta), a < b: what terms that two sources share change, summed over some terms.

    Rows (lang, term, gid, p, p0) come in order of language, term and gid, so a term's rows are together.
    """
    kept: pa.Table | None = None
    for b in batches:
        kept = pa.concat_tables([kept, pa.Table.from_batches([b])]) if kept else pa.Table.from_batches([b])
        begins = _begins(kept)
        if len(begins) > 1:  # the last term may go on
            yield from _pair_sums(kept.slice(0, begins[-1]), begins[:-1])
            kept = kept.slice(begins[-1])
    if kept is not None and len(kept):
        yield from _pair_sums(kept, _begins(kept))


def _begins(rows: pa.Table) -> np.ndarray:
    codes = [rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term")]
    new = (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _pair_sums(rows: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
    g, p, p0 = (rows.column(c).to_numpy() for c in ("gid", "p", "p0"))
    ends = np.repeat(np.append(begins[1:], len(g)), np.diff(np.append(begins, len(g))))
    partners = ends - np.arange(len(g)) - 1
    before = np.concatenate([[0], np.cumsum(partners)])
    i = 0
    while i < len(g):
        j = max(int(np.searchsorted(before, before[i] + PAIRS, "right")) - 1, i + 1)
        x = np.repeat(np.arange(i, j), partners[i:j])
        y = x + 1 + np.arange(len(x)) - (before[x] - before[i])
        delta = np.abs(p[x] - p[y]) - np.abs(p[x] - p0[y]) - np.abs(p0[x] - p[y]) + np.abs(p0[x] - p0[y])
        names, code = np.unique(g, return_inverse=True)
        key, at = np.unique(code[x] * len(names) + code[y], return_inverse=True)
        sums = np.zeros(len(key), np.int64)
        np.add.at(sums, at, delta)
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(names[key // len(names)]), pa.array(names[key % len(names)]), pa.array(sums)], ["a", "b", "delta"])
        i = j


def share(count: Column | int, n: str, v: str) -> Column:
    """1 + floor(UNIT * (count + 5) / (n + 5 v)) in whole numbers; null where v is 0."""
    count = F.lit(count).cast("long") if isinstance(count, int) else count
    wide, size = count.cast("decimal(28,0)") + 5, (F.col(n).cast("decimal(28,0)") + 5 * F.col(v)).cast("decimal(28,0)")
    far = F.call_function("div", (wide * UNIT).cast("decimal(38,0)"), size)
    near = F.call_function("div", (count + 5) * F.lit(UNIT), F.col(n) + 5 * F.col(v))  # fits into a long
    return F.when(F.col(v) > 0, 1 + F.when(count < 1 << 32, near).otherwise(far))


def audit(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, shards: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language in ``docs`` (lang, source, text; null is '').

    Terms are runs of letters A-Z, which are lower-cased, and of characters that are not ASCII. A language keeps the terms
    that at least ``least_docs`` of its rows have, V of them. A source gives each a share p = 1 + floor(10^9 * (count + 5) / (N +
    5 V)), N being its count of all kept terms; so does the language. Part ``pair``: each other source of the language with
    the summed difference of shares over all kept terms, all ranks; 0 where V is 0. Part ``term``: the terms the source
    has whose share is over the language's by the most, up to rank ``most_terms``. Ties: item ascending by UTF-8.
    Repeated rows are documents of their own; no rows give none. Other columns are ignored.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    body = docs.select(*named, F.coalesce("text", F.lit("")).alias("text"))
    cut = body.mapInArrow(lambda batches: index(batches, shards), RUN)
    dealt = cut.repartition(shards, "shard").sortWithinPartitions("lang", "first").drop("shard")
    freq = stage(dealt.mapInArrow(lambda batches: merge(batches, least_docs), "lang string, term string, source string, count long, total long, head boolean"), "freq")
    sizes = freq.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    langs = freq.where("head").groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("v"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "lang_n", "v")]
    known = docs.select(*named).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *zero)
    groups = stage(known.withColumn("p0", F.coalesce(share(0, "n", "v"), F.lit(0))).withColumn("gid", F.monotonically_increasing_id()), "groups")
    small = maybe_broadcast(groups, groups.count(), 128)

    shares = freq.join(small, ["lang", "source"]).withColumn("p", share(F.col("count"), "n", "v"))
    over = shares.withColumn("value", F.col("p") - share(F.col("total"), "lang_n", "v")).where(F.col("value") > 0)
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    terms = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_terms)

    other = small.select("lang", F.col("gid").alias("b"), F.col("p0").alias("p0_b"))
    apart = F.abs(F.col("p0") - F.col("p0_b"))
    constant = groups.join(other, "lang").where(F.col("gid") != F.col("b")).select(F.col("gid").alias("a"), "b", (F.col("v") * apart).alias("delta"))
    # of terms that one source has, only how many have which share counts
    levels = shares.groupBy("lang", F.col("gid").alias("a"), "p0", "p").agg(F.count("*").alias("n_terms"))
    one = levels.join(other, "lang").where(F.col("a") != F.col("b")).select("a", "b", (F.col("n_terms") * (F.abs(F.col("p") - F.col("p0_b")) - apart)).alias("delta"))
    one = one.groupBy("a", "b").agg(F.sum("delta").alias("delta"))
    ordered = shares.select("lang", "term", "gid", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "gid")
    two = ordered.mapInArrow(both_sides, "a long, b long, delta long").groupBy("a", "b").agg(F.sum("delta").alias("delta"))
    turned = lambda df: df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"), "delta"))
    values = constant.unionByName(turned(one)).unionByName(turned(two)).groupBy("a", "b").agg(F.sum("delta").alias("value"))
    pairs = values.join(small.select(F.col("gid").alias("a"), "lang", "source"), "a").join(small.select(F.col("gid").alias("b"), F.col("source").alias("item")), "b")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))

    columns = lambda df, part, item: df.select("lang", "source", F.lit(part).alias("part"), F.col(item).alias("item"), "value", "rank")
    result = stage(columns(pairs, "pair", "item").unionByName(columns(terms, "term", "term")), "divergence")
    unstage(freq, groups)
    return result
