"""Recognition: tokens, dictionary mentions, free n-grams, retrieved mentions."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import with_slice
from ..session import BROADCAST_LIMIT, maybe_broadcast, stage, unstage

#: Fixed value: the longest n-gram that the dictionary is probed with.
MAX_NGRAM = 8
#: Rows of a block of the matrix product, and rows of the concept matrix in one shard (25 MB at 768 dimensions).
QUERY_ROWS, CONCEPT_ROWS = 1024, 1 << 12
#: Rows of a batch that tasks give back, and bytes of text that are taken apart at once.
ROWS, CHUNK = 1 << 16, 1 << 22
#: Whether a byte is ASCII alphanumeric.
WORD = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
#: Most pivots that concepts are packed around.
MOST_PIVOTS = 256
#: Rounds of the selection in which all local maxima are taken at once; states of a span after them.
ROUNDS = 12
OPEN, TAKEN, DROPPED = range(3)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about CHUNK bytes of ``text``, no row cut."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy().astype(np.int64)
        part = (np.cumsum(size) - size) // CHUNK
        borders = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(b)]
        yield from (b.slice(i, z - i) for i, z in zip(borders[:-1], borders[1:], strict=True) if z > i)


def _places(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch with ``text``: the runs, each one's row and start, the places of the tokens among them, and each token's number in its row.

    Runs are tokens and what stands between them in turn, as RUNS has them: stretches of bytes that are ASCII alphanumeric
    or not, so a code point is never cut.
    """
    text = pc.fill_null(b.column("text"), "")
    _, borders, data = text.buffers()
    ends = np.frombuffer(borders, np.int32, len(b) + 1, 4 * text.offset)
    data = data if data is not None else pa.py_buffer(b"")
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    word, heads = WORD[raw], ends - ends[0]
    new = np.concatenate([[False], word[1:] != word[:-1]])[: len(raw)]
    new[heads[:-1][heads[:-1] < heads[1:]]] = True
    begin = np.flatnonzero(new)
    row = np.searchsorted(heads, begin, "right") - 1
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)])
    start = points[begin] - points[heads[row]]
    run = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(raw)).astype(np.int32) + ends[0]), data)
    at = np.flatnonzero(word[begin])
    n_tokens = np.bincount(row[at], minlength=len(b))
    number = np.arange(len(at)) - (np.cumsum(n_tokens) - n_tokens)[row[at]]
    return run, row, start, at, number


def _rows(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """The columns in batches of bounded size."""
    whole = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    for i in range(0, len(whole), ROWS):
        yield whole.slice(i, ROWS)


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def tokenize(texts: DataFrame) -> DataFrame:
    """(pmc_id, tok_idx, token, start, end, run, gap): the ASCII alphanumeric runs of (pmc_id, text), with code-point offsets.

    ``token`` is the run in lower case, ``gap`` what stands between it and the next one. Tokens are numbered and placed
    where their text is read: nothing is shuffled or sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            runs, row, start, at, number = _places(b)
            own, follows = runs.take(pa.array(at)), (at + 1 < len(row)) & (row[np.minimum(at + 1, len(row) - 1)] == row[at])
            gap = pc.fill_null(runs.take(pa.array(at + 1, mask=~follows)), "")
            end = start[at] + pc.utf8_length(own).to_numpy()
            yield from _rows({"pmc_id": b.column("pmc_id").take(pa.array(row[at])), "tok_idx": _int(number), "token": pc.ascii_lower(own),
                "start": _int(start[at]), "end": _int(end), "run": own, "gap": gap})

    return texts.select("pmc_id", "text").mapInArrow(run, "pmc_id string, tok_idx int, token string, start int, end int, run string, gap string")


def split_lines(texts: DataFrame) -> DataFrame:
    """(pmc_id, seg_idx, offset, text): the \\n-split lines of (pmc_id, text) with their code-point offsets, placed where the text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("lines")
            line, count = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            row, first = np.repeat(np.arange(len(b)), count), np.cumsum(count) - count
            before = np.concatenate([[0], np.cumsum(pc.utf8_length(line).to_numpy().astype(np.int64) + 1)])
            yield from _rows({"pmc_id": b.column("pmc_id").take(pa.array(row)), "seg_idx": _int(np.arange(len(row)) - first[row]),
                "offset": _int(before[:-1] - before[first][row]), "text": line})

    return texts.select("pmc_id", F.split("text", "\n").alias("lines")).mapInArrow(run, "pmc_id string, seg_idx int, offset int, text string")


def _known(phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(phrase, n_tokens, hpo_id) of the phrases that are probed, and (token, _sizes): first tokens with the lengths of what they begin."""
    short = phrases.where(F.col("n_tokens") <= MAX_NGRAM)
    begins = short.groupBy(F.col("first_token").alias("token")).agg(F.sort_array(F.collect_set("n_tokens")).alias("_sizes"))
    return short.select("phrase", "n_tokens", "hpo_id"), begins


def text_candidates(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(pmc_id, tok_idx, n_tokens, hpo_id, start, end, text): dictionary_candidates of (pmc_id, text), with their texts.

    Found where the text is read, if a count shows that the phrases are few: words become numbers, n-grams sums of them,
    and what has a phrase's sum meets the phrases by its whole text. Else tokens are dealt by article as in dictionary_candidates.
    """
    known, _ = _known(phrases)
    count = known.count()
    if count * 100 > BROADCAST_LIMIT:
        return with_slice(dictionary_candidates(tokenize(texts), phrases), texts, F.col("start"), F.col("end"), "text")
    listed = [r["phrase"].split(" ") for r in known.select("phrase").distinct().collect()]
    words = {w: i + 1 for i, w in enumerate(sorted({w for p in listed for w in p}))}
    vocabulary, factors = pa.array(words, pa.string()), np.random.default_rng(0).integers(1, 1 << 63, MAX_NGRAM, np.uint64)
    sums = {}
    for p in listed:
        sums.setdefault(len(p), []).append((np.array([words[w] for w in p], np.uint64) * factors[: len(p)]).sum())
    sums = {n: np.unique(np.array(x, np.uint64)) for n, x in sorted(sums.items())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            runs, row, start, at, number = _places(b)
            code = pc.fill_null(pc.index_in(pc.ascii_lower(runs.take(pa.array(at))), value_set=vocabulary), -1).to_numpy().astype(np.int64) + 1
            whose, left, total = row[at], np.arange(len(at)), np.zeros(len(at), np.uint64)
            for k in range(max(sums, default=0)):
                inside = left + k < len(at)  # n-grams of k + 1 tokens, of one text and known words alone
                left, total = left[inside], total[inside]
                inside = (whose[left + k] == whose[left]) & (code[left + k] > 0)
                left, total = left[inside], total[inside] + code[(left + k)[inside]].astype(np.uint64) * factors[k]
                if k + 1 not in sums or not len(left):
                    continue
                found = sums[k + 1][np.minimum(np.searchsorted(sums[k + 1], total), len(sums[k + 1]) - 1)] == total
                for i in range(0, int(found.sum()), ROWS):
                    own = left[found][i : i + ROWS]
                    pieces = [runs.take(pa.array(at[own] + j)) for j in range(2 * k + 1)]
                    lower = pc.ascii_lower(pc.binary_join_element_wise(*pieces[::2], " "))
                    yield from _rows({"pmc_id": b.column("pmc_id").take(pa.array(whose[own])), "tok_idx": _int(number[own]), "n_tokens": _int(np.full(len(own), k + 1)),
                        "start": _int(start[at[own]]), "phrase": lower, "text": pc.binary_join_element_wise(*pieces, "")})

    probes = texts.select("pmc_id", "text").mapInArrow(run, "pmc_id string, tok_idx int, n_tokens int, start int, phrase string, text string")
    found = probes.join(F.broadcast(known), ["phrase", "n_tokens"])
    return found.select("pmc_id", "tok_idx", "n_tokens", "hpo_id", "start", (F.col("start") + F.length("text")).cast("int").alias("end"), "text")


def dictionary_candidates(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """(pmc_id, tok_idx, n_tokens, hpo_id, start, end) of every n-gram of 1 to 8 tokens that is a phrase.

    The first level of the phrases' trie is a table of first tokens with the lengths of what they begin. Tokens not in it
    are dropped before anything is shuffled; the others are put together in these lengths alone, and probe the phrases
    by their whole text, so that a word that begins many phrases meets one at most.
    """
    order, places = Window.partitionBy("pmc_id").orderBy("tok_idx"), range(1, MAX_NGRAM)
    known, begins = _known(phrases)
    following = [F.lead(c, k).over(order).alias(f"_{c}{k}") for c in ("token", "end") for k in places]
    met = tokens.select("pmc_id", "tok_idx", "token", "start", "end", *following).join(maybe_broadcast(begins, begins.count(), 100), "token")
    words, ends = F.array("token", *(f"_token{k}" for k in places)), F.array("end", *(f"_end{k}" for k in places))
    sized = met.select("pmc_id", "tok_idx", "start", words.alias("_words"), ends.alias("_ends"), F.explode("_sizes").alias("n_tokens"))
    probes = sized.where(F.element_at("_ends", F.col("n_tokens")).isNotNull()).select("pmc_id", "tok_idx", "n_tokens", "start",
        F.element_at("_ends", F.col("n_tokens")).alias("end"), F.array_join(F.slice("_words", F.lit(1), F.col("n_tokens")), " ").alias("phrase"))
    found = probes.join(maybe_broadcast(known, phrases.count(), 100), ["phrase", "n_tokens"])
    return found.select("pmc_id", "tok_idx", "n_tokens", "hpo_id", "start", "end")


def after(earlier: Column, later: Column) -> Column:
    """Two steps as one. A step maps 0 to 7 to 0 to 7, in four bits for each number it maps."""
    through = lambda s: F.call_function("shiftright", later, F.call_function("shiftright", earlier, F.lit(4 * s)).bitwiseAND(F.lit(15)).cast("int") * 4)
    return sum((F.shiftleft(through(s).bitwiseAND(F.lit(15)), 4 * s) for s in range(MAX_NGRAM)), F.lit(0).cast("long"))


def leftmost_longest(candidates: DataFrame) -> DataFrame:
    """The longest candidate at each token, then from left to right those that begin at or after the last one's end.

    How many tokens the last one taken still covers where a candidate begins, 0 to 7, decides about it; from one candidate
    to the next that number goes through a map. Maps of neighbours are put together over distances of 1, 2, 4, ... until
    each reaches back to where no candidate spans: there the number is 0 whatever came before. So the work is linear in
    candidates times the doublings, an article is never one value, and only the longest unbroken run's length is
    fetched first.
    """
    more = [c for c in candidates.columns if c not in ("pmc_id", "tok_idx", "n_tokens", "hpo_id", "start", "end")]
    longest = candidates.repartition("pmc_id").groupBy("pmc_id", "tok_idx").agg(F.max(F.struct("n_tokens", "hpo_id", "start", "end", *more)).alias("m")).select("pmc_id",
        "tok_idx", "m.*")
    order = Window.partitionBy("pmc_id").orderBy("tok_idx")
    reach = F.max(F.col("tok_idx") + F.col("n_tokens")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap, size = F.col("tok_idx") - F.lag("tok_idx").over(order), F.lag("n_tokens").over(order)
    step = sum((F.shiftleft(F.greatest(F.lit(0), (size if s == 0 else F.lit(s)) - gap).cast("long"), 4 * s) for s in range(MAX_NGRAM)), F.lit(0).cast("long"))
    marked = longest.withColumns({"_new": F.coalesce(reach <= F.col("tok_idx"), F.lit(True)), "_n": F.row_number().over(order), "_step": step})
    begun = F.max(F.when(F.col("_new"), F.col("_n"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = F.when(F.col("_new"), F.lit(0).cast("long")).otherwise(F.col("_step"))
    placed = stage(marked.withColumns({"_place": F.col("_n") - begun, "_step": held}).drop("_n", "_new"), "longest")
    out = placed
    for t in range(int(placed.agg(F.max("_place")).first()[0] or 0).bit_length()):
        out = out.withColumn("_step", after(F.coalesce(F.lag("_step", 1 << t).over(order), F.lit(0).cast("long")), F.col("_step")))
    taken = stage(out.where(F.col("_step").bitwiseAND(F.lit(15)) == 0).drop("_step", "_place"), "spans")
    unstage(placed)
    return taken


def dictionary_match(texts: DataFrame, tokens: DataFrame | None, phrases: DataFrame) -> DataFrame:
    """(pmc_id, tok_idx, n_tokens, identifier, offset, length, text, note): the dictionary's mentions, note null.

    Without ``tokens`` candidates are found in the texts themselves, so that no token is shuffled.
    """
    if tokens is None:
        spans = leftmost_longest(text_candidates(texts, phrases))
    else:
        spans = with_slice(leftmost_longest(dictionary_candidates(tokens, phrases)), texts, F.col("start"), F.col("end"), "text")
    return spans.select("pmc_id", "tok_idx", "n_tokens", F.col("hpo_id").alias("identifier"), F.col("start").alias("offset"),
        (F.col("end") - F.col("start")).alias("length"), "text", F.lit(None).cast("string").alias("note"))


def free_token_ngrams(tokens: DataFrame, matches: DataFrame, most: int = 4) -> DataFrame:
    """(pmc_id, run_id, start, length, text): the n-grams of 1 to ``most`` consecutive tokens outside all matches, each once.

    Matches are whole tokens. Runs are the islands of tokens between them; a token's place less its rank among the free
    ones is the same within an island. An n-gram's text is put together from its tokens and the gaps between them, so an
    article's length doesn't count.
    """
    taken = matches.select("pmc_id", F.explode(F.sequence(F.col("tok_idx"), F.col("tok_idx") + F.col("n_tokens") - 1)).alias("tok_idx"))
    free = tokens.join(taken, ["pmc_id", "tok_idx"], "left_anti")
    order = Window.partitionBy("pmc_id").orderBy("tok_idx")
    islands = free.withColumn("run_id", F.col("tok_idx") - F.row_number().over(order) + 1)
    inside = Window.partitionBy("pmc_id", "run_id").orderBy("tok_idx").rowsBetween(0, most - 1)
    parts = islands.withColumn("part", F.concat("run", "gap"))
    ahead = parts.select("pmc_id", "run_id", "start", F.collect_list("part").over(inside).alias("parts"),
        F.collect_list(F.struct("run", "end")).over(inside).alias("ahead"))
    each = ahead.select("pmc_id", "run_id", "start", "parts", F.posexplode("ahead").alias("before", "last"))
    text = F.concat(F.array_join(F.slice("parts", F.lit(1), F.col("before")), ""), F.col("last.run"))
    return each.select("pmc_id", "run_id", "start", (F.col("last.end") - F.col("start")).alias("length"), text.alias("text"))


def _islands(b: pa.RecordBatch, row: np.ndarray, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's tokens, as _places gives them, those outside the matches in ``taken``, each one's run_id, and how many its run has from there on."""
    match, lists = b.column("taken").flatten(), b.column("taken")
    whose = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    begin = np.searchsorted(row[at], whose) + match.field("tok_idx").to_numpy()
    step = np.bincount(begin, minlength=len(at) + 1) - np.bincount(begin + match.field("n_tokens").to_numpy(), minlength=len(at) + 1)
    free = np.flatnonzero(np.cumsum(step)[: len(at)] == 0)
    article = row[at[free]]
    run_id = number[free] - (np.arange(len(free)) - np.searchsorted(article, article))
    key = np.concatenate([[False], (article[1:] != article[:-1]) | (run_id[1:] != run_id[:-1])]).cumsum() if len(free) else run_id
    return free, run_id, np.searchsorted(key, key, "right") - np.arange(len(key))


def _met(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """(pmc_id, text, taken): each text with its matches."""
    taken = matches.groupBy("pmc_id").agg(F.collect_list(F.struct("tok_idx", "n_tokens")).alias("taken"))  # of one text, as its row is
    return texts.join(taken, "pmc_id", "left").select("pmc_id", "text", "taken")


def text_ngrams(texts: DataFrame, matches: DataFrame, most: int = 4) -> DataFrame:
    """free_token_ngrams of (pmc_id, text), made where the text is read: texts meet their matches once, tokens and n-grams no exchange.

    ``matches`` (pmc_id, tok_idx, n_tokens) are those of the texts, article ids distinct. Within a partition rows come article by
    article, in order of run_id, start and length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            runs, row, start, at, number = _places(b)
            free, run_id, left = _islands(b, row, at, number)
            place, article = at[free], row[at[free]]
            for i in range(0, len(free), ROWS // most):
                size = np.minimum(left[i : i + ROWS // most], most)
                token = np.repeat(np.arange(i, i + len(size)), size)
                more = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                pieces = [runs.take(pa.array(place[token] + k, mask=k > 2 * more)) for k in range(2 * most - 1)]
                text = pc.binary_join_element_wise(*pieces, "", null_handling="skip")
                yield from _rows({"pmc_id": b.column("pmc_id").take(pa.array(article[token])), "run_id": _int(run_id[token]), "start": _int(start[place[token]]),
                    "length": _int(pc.utf8_length(text).to_numpy()), "text": text})

    return _met(texts, matches).mapInArrow(run, "pmc_id string, run_id int, start int, length int, text string")


def is_candidate(text: Column) -> Column:
    """Over two characters, first one a letter (so not all digits)."""
    return (F.length(text) > 2) & text.rlike("^[A-Za-z]")


def distinct_candidate_texts(ngrams: DataFrame) -> DataFrame:
    return ngrams.where(is_candidate(F.col("text"))).select("text").distinct()


def normalised(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def _vectors(rows: DataFrame, key: str, size: int | None) -> DataFrame:
    """(key, x) of the vectors without null or non-finite components, all of one size."""
    whole = F.forall("embedding", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    return rows.where(F.col(key).isNotNull() & whole & (F.size("embedding") == F.lit(size or 0))).select(F.col(key).cast("long").alias("key"),
        F.col("embedding").cast("array<double>").alias("x"))


def _angles(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of vectors with pivots, and which vectors are of length one: bounds hold for these alone."""
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    return np.arccos(np.clip(x / np.maximum(length, 1e-30)[:, None] @ pivots.T, -1, 1)), np.abs(length - 1) < 1e-6


def _packed(rows: DataFrame, pivots: np.ndarray, most: int, name: str) -> DataFrame:
    """(id, cell, radius, keys, x): up to ``most`` rows of (key, x) that have one nearest pivot, and their largest angle with it.

    Rows are dealt by ranges of pivot and hash, so a pivot that is nearest to most of them has many packs in many tasks.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            angle, unit = _angles(x, pivots)
            cell = angle.argmin(1)
            at = np.where(unit, angle[np.arange(len(x)), cell], np.inf)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("x"), pa.array(cell.astype(np.int32)), pa.array(at)], ["key", "x", "cell", "angle"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        for b in batches:
            cell = b.column("cell").to_numpy()
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            borders = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
            for i, end in zip(borders[:-1], borders[1:], strict=True):
                for s in range(i, end, most):
                    z = min(s + most, end)
                    yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([int(cell[s])], pa.int32()), pa.array([b.column("angle").to_numpy()[s:z].max()]),
                        pa.array([b.column("key").to_numpy()[s:z].tobytes()], pa.binary()), pa.array([x[s:z].tobytes()], pa.binary())],
                        ["id", "cell", "radius", "keys", "x"])
                    made += 1

    placed = rows.mapInArrow(near, "key long, x array<double>, cell int, angle double")
    dealt = placed.repartitionByRange("cell", F.xxhash64("key")).sortWithinPartitions("cell")
    return stage(dealt.mapInArrow(pack, "id long, cell int, radius double, keys binary, x binary"), name)


def _best_of_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key, row_idx, score): the best of a pack of concepts for each query that came to it; of equal ones the lowest row_idx."""
    for b in batches:
        for r in range(len(b)):
            cell = lambda c, kind, r=r, b=b: np.frombuffer(b.column(c)[r].as_py(), kind)
            keys, rows = cell("q_keys", "<i8"), cell("keys", "<i8")
            score = cell("q_x", "<f8").reshape(len(keys), -1) @ cell("x", "<f8").reshape(len(rows), -1).T
            order = np.argsort(rows, kind="stable")
            at = order[score[:, order].argmax(1)]
            yield pa.RecordBatch.from_arrays([pa.array([b.column("block")[r].as_py()] * len(keys)), pa.array(keys), pa.array(rows[at]),
                pa.array(score[np.arange(len(keys)), at])], ["block", "key", "row_idx", "score"])


def retrieve_top1(queries: DataFrame, concepts: DataFrame, report: bool = False) -> DataFrame:
    """(key, row_idx, hpo_id, name, score): the concept of the highest cosine for each query; ties go to the lowest row_idx.

    ``queries`` (key, embedding) and ``concepts`` (row_idx, hpo_id, name, embedding) hold vectors of length one; keys and
    row_idx are distinct. A vector that is null, has a null or non-finite component or another size than the concept of
    the lowest row_idx takes no part, and a query like that has no row. With ``report`` there are also packs_met and
    packs, how many packs of concepts the query met and of how many.

    Concepts are packed around pivots, a bounded number of concepts drawn by hash, with the pack's angle around its pivot.
    By the triangle inequality no concept of a pack is nearer to a query than the angle between query and pivot less
    that angle. Queries meet the pack of the best bound first; then, with the score they have, only packs whose bound
    reaches it. Vectors of other lengths have no bound and meet all. The driver keeps the pivots and three numbers a pack.
    """
    spark = concepts.sparkSession
    there = concepts.where(F.col("embedding").isNotNull() & F.col("row_idx").isNotNull())
    counted = there.agg(F.min_by(F.size("embedding"), "row_idx").alias("size"), F.count("*").alias("n")).first()
    known = _vectors(concepts, "row_idx", counted["size"])
    wanted = max(1, min(MOST_PIVOTS, 4 * (counted["n"] // CONCEPT_ROWS)))
    drawn = [r["x"] for r in known.orderBy(F.xxhash64("key"), "key").limit(wanted).collect()]
    out = "key long, row_idx long, hpo_id string, name string, score double" + (", packs_met long, packs long" if report else "")
    if not drawn:
        return spark.createDataFrame([], out)
    pivots = np.array(drawn, np.float64)
    pivots /= np.maximum(np.sqrt(np.einsum("ij,ij->i", pivots, pivots)), 1e-30)[:, None]
    packs, blocks = _packed(known, pivots, CONCEPT_ROWS, "concept_packs"), _packed(_vectors(queries, "key", counted["size"]), pivots, QUERY_ROWS, "query_blocks")
    meta = packs.select("id", "cell", "radius").toArrow().sort_by("id")
    ids, cells, radii = (meta[c].to_numpy() for c in ("id", "cell", "radius"))

    def bounds(x: np.ndarray) -> np.ndarray:
        """The highest cosine that each query can have in each pack."""
        angle, unit = _angles(x, pivots)
        out = np.cos(np.maximum(angle[:, cells] - np.where(np.isfinite(radii), radii, np.pi)[None, :] - 1e-6, 0))
        out[~unit] = np.inf
        out[:, ~np.isfinite(radii)] = np.inf
        return out

    def sent(second: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(len(b)):
                    keys = np.frombuffer(b.column("keys")[r].as_py(), "<i8")
                    x = np.frombuffer(b.column("x")[r].as_py(), "<f8").reshape(len(keys), -1)
                    bound = bounds(x)
                    home = np.where(np.isfinite(bound), bound, -2).argmax(1)  # what has no bound says nothing about the best
                    if second:
                        had = {h["key"]: h["score"] for h in b.column("had")[r].as_py()}
                        meets = bound >= np.array([had[k] for k in keys.tolist()])[:, None] - 1e-9
                        meets[np.arange(len(keys)), home] = False
                    else:
                        meets = np.zeros(bound.shape, bool)
                        meets[np.arange(len(keys)), home] = True
                    for p in np.flatnonzero(meets.any(0)):
                        own = meets[:, p]
                        yield pa.RecordBatch.from_arrays([pa.array([ids[p]]), b.column("id").slice(r, 1), pa.array([keys[own].tobytes()], pa.binary()),
                            pa.array([x[own].tobytes()], pa.binary())], ["id", "block", "q_keys", "q_x"])

        return run

    def scores(from_blocks: DataFrame, second: bool) -> DataFrame:
        copies = from_blocks.mapInArrow(sent(second), "id long, block long, q_keys binary, q_x binary")
        return packs.join(copies, "id").select("block", "q_keys", "q_x", "keys", "x").mapInArrow(_best_of_pack, "block long, key long, row_idx long, score double")

    first = stage(scores(blocks, False), "first_scores")
    had = first.groupBy(F.col("block").alias("id")).agg(F.collect_list(F.struct("key", "score")).alias("had"))  # a block's queries, QUERY_ROWS at most
    rest = scores(blocks.join(had, "id"), True)
    best = first.unionByName(rest).groupBy("key").agg(F.max(F.struct("score", (-F.col("row_idx")).alias("neg"))).alias("w"), F.count("*").alias("packs_met"))
    won = stage(best.select("key", (-F.col("w.neg")).alias("row_idx"), F.col("w.score").alias("score"), "packs_met"), "nearest_concepts")
    unstage(packs, blocks, first)
    named = won.join(concepts.select(F.col("row_idx").cast("long").alias("row_idx"), "hpo_id", "name"), "row_idx")
    return named.select("key", "row_idx", "hpo_id", "name", "score", *(["packs_met", F.lit(len(ids)).cast("long").alias("packs")] if report else []))


def similarity_profile(scores: DataFrame) -> DataFrame:
    """max, p10, p25, median and min of a column ``score``, by descending rank int(n * p).

    Ranks come from the counts of distinct scores, so the scores themselves are not sorted in one task.
    """
    counted = scores.groupBy("score").agg(F.count("*").alias("n"))
    n = counted.agg(F.sum("n")).first()[0] or 0
    sliced = stage(counted.repartitionByRange(F.col("score").desc()).withColumn("part", F.spark_partition_id()), "scores")  # the parts are drawn once
    ahead = sliced.groupBy("part").agg(F.sum("n").alias("size")).withColumn("before",
        F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = sliced.join(F.broadcast(ahead), "part").withColumn("first", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    at = lambda rank: F.max(F.when((F.col("first") <= rank) & (F.col("first") + F.col("n") > rank), F.col("score")))
    return first.agg(F.max("score").alias("max"), at(int(n * 0.10)).alias("p10"), at(int(n * 0.25)).alias("p25"), at(int(n * 0.5)).alias("median"),
        F.min("score").alias("min"))


def settle(group: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which spans are taken and which stay open, of spans in order of group and start; a lower rank comes first.

    In rounds, spans that come before all open ones that they overlap are taken, if they are ``sure`` (nothing that comes
    later overlaps them), and what overlaps them is dropped. What is left then waits for a span that isn't sure. Long
    chains, of which a round settles one end alone, are settled in order of rank after ROUNDS rounds.
    """
    taken, left = np.zeros(len(group), bool), np.arange(len(group))
    for n_round in itertools.count():
        if not len(left):
            break
        g, s, e, r = group[left], start[left], end[left], rank[left]
        pairs = []
        for k in range(1, len(left)):  # those that one overlaps follow it without a gap
            over = np.flatnonzero((g[k:] == g[:-k]) & (s[k:] < e[:-k]))
            if not len(over):
                break
            pairs.append((over, over + k))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (left[:0], left[:0])
        if n_round == ROUNDS:
            state = in_rank_order(r, np.where(r[a] < r[b], a, b), np.where(r[a] < r[b], b, a), sure[left])
            taken[left[state == TAKEN]] = True
            left = left[state == OPEN]
            break
        beaten = np.zeros(len(left), bool)
        beaten[np.where(r[a] < r[b], b, a)] = True
        won = ~beaten & sure[left]
        if not won.any():
            break
        gone = won.copy()
        gone[b[won[a]]] = True
        gone[a[won[b]]] = True
        taken[left[won]] = True
        left = left[~gone]
    open_ = np.zeros(len(group), bool)
    open_[left] = True
    return taken, open_


def in_rank_order(rank: np.ndarray, better: np.ndarray, worse: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """The state of each span, settled one after the other by rank: it depends on the better ones that it overlaps alone."""
    order = np.argsort(worse, kind="stable")
    first = np.searchsorted(worse[order], np.arange(len(rank) + 1)).tolist()
    better, certain, state = better[order].tolist(), sure.tolist(), [OPEN] * len(rank)
    for i in np.argsort(rank).tolist():
        above = {state[j] for j in better[first[i] : first[i + 1]]}
        state[i] = DROPPED if TAKEN in above else TAKEN if certain[i] and OPEN not in above else OPEN
    return np.array(state)


def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans taken, of rows (pmc_id, run_id, start, length, score, ...) in order of the first four.

    Only spans whose fate hangs on what hasn't come yet are kept from batch to batch: chains of overlapping spans, each
    scored higher than the one before, so fewer than there are distinct scores in a row.
    """
    kept: pa.Table | None = None

    def chosen(rows: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
        code = rows["pmc_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        run, start, length, score = (rows[c].to_numpy() for c in ("run_id", "start", "length", "score"))
        group = np.cumsum(np.concatenate([[False], (code[1:] != code[:-1]) | (run[1:] != run[:-1])]))
        begins = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] != start[:-1])])
        bounds = np.append(np.flatnonzero(begins), len(rows))
        at = np.cumsum(begins) - 1
        longest_first = bounds[at] + bounds[at + 1] - 1 - np.arange(len(rows))  # of one start
        rank = np.empty(len(rows), np.int64)  # counts where spans overlap, so within a run
        rank[longest_first[np.argsort(-score[longest_first], kind="stable")]] = np.arange(len(rows))
        end = start.astype(np.int64) + length
        sure = np.ones(len(rows), bool) if last else (group < group[-1]) | (end <= start[-1])
        taken, left = settle(group, start, end, rank, sure)
        return rows.filter(pa.array(taken)), rows.filter(pa.array(left))

    waiting: list[pa.RecordBatch] = []
    for b in batches:
        waiting.append(b)
        new = pa.Table.from_batches(waiting)
        if len(new) >= max(1, len(kept) if kept is not None else 0):  # so that a long chain isn't gone through with every batch
            out, kept = chosen(pa.concat_tables([kept, new]) if kept is not None else new, False)
            waiting = []
            yield from out.to_batches()
    rest = [t for t in (kept, pa.Table.from_batches(waiting) if waiting else None) if t is not None and len(t)]
    if rest:
        yield from chosen(pa.concat_tables(rest), True)[0].to_batches()


def _reached(thresholds: list[float]) -> Column:
    """The thresholds that ``score`` reaches."""
    n = sum((F.lit(float(t)) <= F.col("score")).cast("int") for t in thresholds)
    return F.slice(F.array(*(F.lit(float(t)) for t in sorted(thresholds))), F.lit(1), n)


def select_retrieved(ngrams: DataFrame, hits: DataFrame, thresholds: list[float], on: str = "text", ordered: bool = False) -> DataFrame:
    """(threshold, pmc_id, run_id, start, length, text, hpo_id, name, score): the n-grams taken at each threshold.

    ``ngrams`` (pmc_id, run_id, start, length, text) are distinct, ``hits`` (text, hpo_id, name, score) one for a text, or
    for a value of another column ``on`` of the n-grams.
    Within a run, which no other run overlaps, n-grams are taken by score, then start, then length from the longest,
    where they overlap none taken before. As the order is by score, what is taken at a threshold is what the lowest one
    takes with a score that reaches it: the selection runs once. Runs stream by in order of place; see greedy.

    Where n-grams come ``ordered``, as text_ngrams gives them, and hits are few, scores go to the n-grams, which then
    meet no exchange; concepts are named after the selection.
    """
    close = hits.where(F.col("score") >= min(thresholds)).select(on, "hpo_id", "name", "score")
    n = close.count() if ordered else 0
    place = ["pmc_id", "run_id", "start", "length"]
    if ordered and n * 32 <= BROADCAST_LIMIT:
        met = ngrams.join(F.broadcast(close.select(on, "score")), on).select(*place, "score", *dict.fromkeys(["text", on]))  # keeps the n-grams' order
        chosen = met.mapInArrow(greedy, met.schema).join(maybe_broadcast(close.drop("score"), n, 100), on)
    else:
        met = ngrams.join(close, on).select(*place, "score", "text", "hpo_id", "name")
        chosen = met.repartition("pmc_id", "run_id").sortWithinPartitions(*place).mapInArrow(greedy, met.schema)
    reached = _reached(thresholds)
    return chosen.select(F.explode(reached).alias("threshold"), *place, "text", "hpo_id", "name", "score")


def _cut(data: pa.Buffer, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts at data[begin:end], which do not overlap: with what stands between them they are all of the bytes."""
    order = np.argsort(begin)
    cuts = np.column_stack([begin[order], end[order]]).reshape(-1)
    whole = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, cuts[-1:]).astype(np.int32)), data)
    return whole.take(pa.array(2 * np.argsort(order)))


def select_in_texts(texts: DataFrame, matches: DataFrame, hits: DataFrame, thresholds: list[float], place_of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    most: int = 4, with_text: bool = True) -> DataFrame:
    """What select_retrieved takes of the candidates (is_candidate) among text_ngrams, found where the text is read: no n-gram leaves its task.

    Without ``with_text`` their text is null.

    ``hits`` (place, hpo_id, name, score) have a place from 0 each and are few, as their scores go to every task;
    ``place_of`` gives the places of texts from (bytes, starts, ends).
    """
    close = hits.where(F.col("score") >= min(thresholds)).select("place", "hpo_id", "name", "score")
    listed = close.select("place", "score").toArrow()
    scores = np.full((pc.max(listed["place"]).as_py() if len(listed) else 0) + 2, np.nan)  # the last one is that of all places beyond
    scores[listed["place"].to_numpy()] = listed["score"].to_numpy()

    def ngrams(b: pa.RecordBatch, places: tuple) -> Iterator[pa.RecordBatch]:
        """(pmc_id, run_id, start, length, score, place, begin, end) of the n-grams with a hit; pmc_id is the row's number, begin and end are bytes."""
        runs, row, start, at, number = places
        free, run_id, left = _islands(b, row, at, number)
        _, borders, data = runs.buffers()
        borders, raw = np.frombuffer(borders, np.int32), np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        token_at = at[free]
        for i in range(0, len(free), ROWS // most):
            size = np.minimum(left[i : i + ROWS // most], most)
            token = np.repeat(np.arange(i, i + len(size)), size)
            first = token_at[token]
            last = first + 2 * (np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size))
            begin, end = borders[first], borders[last + 1]
            length = start[last] + end - borders[last] - start[first]  # tokens are ASCII
            own = np.flatnonzero((length > 2) & ((raw[begin] | 32) - np.uint8(97) < 26))
            place = place_of(raw, begin[own], end[own])
            score = scores[np.minimum(place, len(scores) - 1)]
            near = score == score
            own, first = own[near], first[own[near]]
            yield pa.RecordBatch.from_arrays([_int(row[first]), _int(run_id[token[own]]), _int(start[first]), _int(length[own]), pa.array(score[near]), pa.array(place[near]),
                _int(begin[own]), _int(end[own])], ["pmc_id", "run_id", "start", "length", "score", "place", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            places = _places(b)
            for t in greedy(x for x in ngrams(b, places) if len(x)):
                text = _cut(places[0].buffers()[2], t.column("begin").to_numpy(), t.column("end").to_numpy()) if with_text else pa.nulls(len(t), pa.string())
                yield pa.RecordBatch.from_arrays([b.column("pmc_id").take(t.column("pmc_id")), *(t.column(c) for c in ("run_id", "start", "length")), text,
                    t.column("place"), t.column("score")], ["pmc_id", "run_id", "start", "length", "text", "place", "score"])

    chosen = _met(texts, matches).mapInArrow(run, "pmc_id string, run_id int, start int, length int, text string, place long, score double")
    chosen = chosen.join(maybe_broadcast(close.drop("score"), len(listed), 100), "place")
    reached = _reached(thresholds)
    return chosen.select(F.explode(reached).alias("threshold"), "pmc_id", "run_id", "start", "length", "text", "hpo_id", "name", "score")


def merge_mentions(matches: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Dictionary mentions, then retrieved ones with name and score (rounded to four places), numbered per article by place."""
    a = matches.select("pmc_id", F.lit(0).alias("source"), "identifier", "offset", "length", "text", "note",
        F.lit(None).cast("string").alias("retrieved_name"), F.lit(None).cast("double").alias("retrieved_score"))
    b = retrieved.select("pmc_id", F.lit(1).alias("source"), F.col("hpo_id").alias("identifier"), F.col("start").alias("offset"), "length", "text",
        F.lit(None).cast("string").alias("note"), F.col("name").alias("retrieved_name"), F.round("score", 4).alias("retrieved_score"))
    order = Window.partitionBy("pmc_id").orderBy("source", "offset")
    return a.unionByName(b).withColumn("ent_idx", F.row_number().over(order) - 1)
