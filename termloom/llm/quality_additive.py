"""Quality scores by an additive model over counts of the text: see additive.py for the model.

Features are made in Arrow batches with numpy, scores by adding up table cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import additive
from .sampling import counted_keys, least_of_key, row_key, threshold_of
from .textual import U, runs, segment_hash, slices, utf8, words
from .word_quality import base_counts

#: Byte classes: digit, upper case, lower case, sentence mark, other sign, separator, first byte of another character, its other bytes.
DIGIT, UPPER, LOWER, MARK, SIGN, GAP, HIGH, TAIL = range(8)
CLASS = np.full(256, SIGN, np.uint8)
CLASS[48:58], CLASS[65:91], CLASS[97:123], CLASS[128:192], CLASS[192:] = DIGIT, UPPER, LOWER, TAIL, HIGH
CLASS[[ord(c) for c in ".,;:!?"]] = MARK
CLASS[[32, 9, 10, 11, 12, 13]] = GAP
NAMES = ["log_words", "word_length", "symbols", "dup_lines", "repeat_words", "digits", "upper", "marks", "signs", "high", "lines", "distinct", "top_word", "echoes",
    "letterless", "long_words", "spread"]
LONG = 12
#: Texts of a slice, at most: a key holds their number in 19 bits.
TEXTS = 1 << 18


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[texts, len(NAMES)]: the log of the number of words; the rest are shares or means, 0 where there is nothing to divide by."""
    n = len(offsets) - 1
    base = base_counts(data, offsets)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(owner * 8 + CLASS[data], minlength=8 * n).reshape(n, 8)
    starts, ends, first = words(data, offsets)
    count = np.diff(first)
    text = np.repeat(np.arange(n), count)
    sums = np.concatenate([[0], np.cumsum(np.isin(CLASS[data], (UPPER, LOWER, HIGH)))])
    letterless = np.bincount(text[sums[ends] == sums[starts]], minlength=n)
    long_words = np.bincount(text[ends - starts > LONG], minlength=n)
    h = segment_hash(data, starts, ends)
    again = np.bincount(text[1:][(h[1:] == h[:-1]) & (text[1:] == text[:-1])], minlength=n)
    key, times = np.unique((text << 44) | (h >> U(20)).astype(np.int64), return_counts=True)
    of = key >> 44
    distinct, spread, top = np.bincount(of, minlength=n), np.bincount(of, times * np.log(times), n), np.zeros(n)
    np.maximum.at(top, of, times)
    lines = np.bincount(np.searchsorted(offsets, runs(data != 10, offsets)[0], "right") - 1, minlength=n) if len(data) else np.zeros(n)
    chars = kinds[:, : TAIL].sum(1)
    per_word, per_char = (lambda v: v / np.maximum(count, 1)), (lambda v: v / np.maximum(chars, 1))
    log_words = np.log(np.maximum(count, 1))
    return np.stack([np.log1p(count), per_word(base["word_chars"]), per_word(base["n_symbols"]), base["n_dup_lines"] / np.maximum(lines, 1), per_word(base["n_repeat_words"]),
        per_char(kinds[:, DIGIT]), per_char(kinds[:, UPPER]), per_char(kinds[:, MARK]), per_char(kinds[:, SIGN]), per_char(kinds[:, HIGH]),
        per_word(lines), per_word(distinct), per_word(top), per_word(again), per_word(letterless), per_word(long_words),
        (log_words - per_word(spread)) / np.maximum(log_words, 1)], 1)  # the last: the words' entropy, against the most it can be


def train(rows: DataFrame, max_rows: int = 4000, drawn: bool = False, **options: int) -> additive.AdditiveModel | float:
    """The model of ``rows`` (doc_id, text, quality 0/1), fitted on at most ``max_rows`` of them that a hash picks (see sampling.row_key).

    Rows of one id count once, as do rows without an id that have one text. A null text is empty; null labels don't count.
    If they are ``drawn`` already (by sampling.labelled), they aren't counted first. With under ten rows, or one kind of
    label alone, the result is the smoothed share of label 1 instead.
    """
    known = rows.where(F.col("quality").isin(0, 1)).select("text", F.col("quality").cast("int").alias("quality"), row_key().alias("key"),
        F.xxhash64("text", "quality").alias("tie"))
    if not drawn:
        known = known.where(F.col("key") < F.lit(threshold_of(max_rows, counted_keys(known, "key").first()["n_keys"])))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for b in batches:
            b = b.take(pa.array(least_of_key(b.column("key").to_pylist(), b.column("tie").to_pylist(), least), pa.int64()))
            for i, j, d, o in slices(*utf8(b.column("text")), texts=TEXTS):
                cells = [r.tobytes() for r in features(d, o)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("key", "tie", "quality")), pa.array(cells, pa.binary())],
                    ["key", "tie", "quality", "f"])

    once = known.select("key", "tie", "text", "quality").mapInArrow(made, "key long, tie long, quality int, f binary").groupBy("key")
    got = once.agg(F.min(F.struct("tie", "quality", "f")).alias("m")).orderBy("key").limit(max_rows).select("m.quality", "m.f").toArrow()
    y = got["quality"].to_numpy().astype(np.float64)
    if len(y) < 10 or y.min() == y.max():
        return float((y.sum() + 1) / (len(y) + 2))
    return additive.fit(np.stack([np.frombuffer(v.as_py()) for v in got["f"]]), y, **options)


def score(docs: DataFrame, model: additive.AdditiveModel | float, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs`` (doc_id, text; other columns are ignored): predicted is 1 from ``threshold`` on.

    A null text is empty, and scored as such. Repeated rows give repeated results; no rows give none.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, d, o in slices(*utf8(b.column("text")), texts=TEXTS):
                p = np.full(j - i, model) if isinstance(model, float) else model.score(features(d, o))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(p), pa.array(p >= threshold).cast(pa.int32())],
                    ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double, predicted int")
