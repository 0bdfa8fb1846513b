"""Quality rules: counted base rules and a calibrated logistic regression on hashed word and character n-grams.

The counts and the scores are made in Arrow batches with numpy; the model is fitted on a bounded, hash-chosen sample of
the labelled rows (``max_rows``) and then scores every row against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import counted_keys, least_of_key, row_key, threshold_of
from .textual import BYTE_VALUE, M1, M3, SEPARATOR, U, mix, runs, segment_hash, slices, utf8, words

#: Hash buckets of each family of features; a power of two. With 600 labelled rows held out of 2600, 2 ** 11 buckets gave a
#: log-loss of 0.155 and 2 ** 14 one of 0.153, for eight times the memory of a fit.
BUCKETS = 1 << 11
SYMBOL = np.zeros(256, np.int64)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
WINDOW = 8


def ngram_keys(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of the word unigrams and bigrams and of the byte trigrams and 5-grams; each family is ordered by text."""
    starts, ends, first = words(data, offsets)
    count = np.diff(first)
    h = segment_hash(data, starts, ends)
    text = np.repeat(np.arange(len(count)), count)
    shift = U(64 - (BUCKETS.bit_length() - 1))
    out = [((h >> shift).astype(np.int64), text)]
    pair = mix(h[:-1] * M1 + h[1:]) if len(h) > 1 else h[:0]
    same = text[:-1] == text[1:] if len(h) > 1 else np.zeros(0, bool)
    out.append(((pair[same] >> shift).astype(np.int64), text[:-1][same] if len(h) > 1 else text[:0]))
    value, owner = BYTE_VALUE[data], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for size in (3, 5):
        n = len(data) - size + 1
        if n <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        g = value[:n].copy()
        for k in range(1, size):
            g *= M3
            g += value[k : n + k]
        g ^= g >> U(29)
        g *= M1
        ok = owner[:n] == owner[size - 1 :]
        out.append(((g >> shift).astype(np.int64)[ok], owner[:n][ok]))
    return out


@dataclass
class QualityModel:
    """Weights of the hashed n-grams, the bias, and the two numbers of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        margin = np.full(n, self.bias)
        for k, (bucket, text) in enumerate(ngram_keys(data, offsets)):
            part, size = np.bincount(text, self.weights[k][bucket], n), np.bincount(text, minlength=n)
            margin += part / np.maximum(size, 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def train(rows: DataFrame, max_rows: int = 2000, drawn: bool = False, iterations: int = 300, penalty: float = 1e-3) -> QualityModel | None:
    """Fit on at most ``max_rows`` of ``rows`` (doc_id, text, quality 0/1) that a hash of the id picks.

    Rows of one id count once, as do rows without an id that have one text. If they are ``drawn`` already (by
    sampling.labelled), they aren't counted first.
    A fifth of the sample is held out of the fit and calibrates its margins (Platt). Null texts and labels don't count.
    Without rows of both kinds there is no model.
    """
    known = rows.where(F.col("text").isNotNull() & F.col("quality").isin(0, 1)).select("text", F.col("quality").cast("int").alias("quality"), row_key().alias("key"),
        F.xxhash64("text", "quality").alias("tie"))
    n = 0 if drawn else counted_keys(known, "key").first()["n_keys"]
    if n:
        known = known.where(F.col("key") < F.lit(threshold_of(max_rows, n)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for b in batches:
            b = b.take(pa.array(least_of_key(b.column("key").to_pylist(), b.column("tie").to_pylist(), least), pa.int64()))
            for i, j, d, o in slices(*utf8(b.column("text"))):
                packed = [[] for _ in range(j - i)]
                for k, (bucket, text) in enumerate(ngram_keys(d, o)):
                    bounds = np.searchsorted(text, np.arange(j - i + 1))
                    for t in range(j - i):
                        v, c = np.unique(bucket[bounds[t] : bounds[t + 1]], return_counts=True)
                        packed[t].append(np.rec.fromarrays([v + k * BUCKETS, c / max(c.sum(), 1)], dtype=[("i", "<u2"), ("v", "<f4")]))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("key", "tie", "quality")),
                    pa.array([np.concatenate(p).tobytes() for p in packed], pa.binary())], ["key", "tie", "quality", "f"])

    made = known.select("key", "tie", "text", "quality").mapInArrow(features, "key long, tie long, quality int, f binary")
    got = made.groupBy("key").agg(F.min(F.struct("tie", "quality", "f")).alias("m")).orderBy("key").limit(max_rows).select("m.quality", "m.f").toArrow()
    if n and not len(got):
        raise RuntimeError(f"none of {n} labelled rows was drawn")
    y = got["quality"].to_numpy().astype(np.float64)
    if len(y) < 10 or y.min() == y.max():
        return None
    x = np.zeros((len(y), 4 * BUCKETS), np.float32)
    for r, f in enumerate(got["f"]):
        cell = np.frombuffer(f.as_py(), [("i", "<u2"), ("v", "<f4")])
        x[r, cell["i"]] = cell["v"]
    scale = 1 / (np.sqrt((x * x).mean(0, dtype=np.float64)) + 1e-4)
    held = np.arange(len(y)) % 5 == 0
    fit_y, w, b = y[~held], np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    fx = x[~held] * scale.astype(np.float32) / np.float32(np.sqrt(x.shape[1]) / 8)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, iterations + 1):
        p = 1 / (1 + np.exp(-np.clip(fx @ w.astype(np.float32) + b, -30, 30)))
        g, gb = fx.T @ ((p - fit_y) / len(fit_y)).astype(np.float32) + penalty * w, float((p - fit_y).mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate, c1, c2 = 0.05, 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    model = QualityModel((w * scale / (np.sqrt(x.shape[1]) / 8)).reshape(4, BUCKETS), b)
    margin = x[held].astype(np.float64) @ model.weights.ravel() + b
    model.slope, model.offset = _platt(margin, y[held])
    return model


def _platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Newton steps for sigmoid(slope * margin + offset), with smoothed targets; the slope stays positive."""
    up = y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (len(y) - up + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - target) * margin).sum() + 1e-2 * (a - 1), (p - target).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-2, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
    return (float(a), float(b)) if a > 0.05 and np.isfinite(a + b) else (1.0, 0.0)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[offsets])
    inside = ~SEPARATOR[data]
    out = {"n_words": np.diff(first), "word_chars": total(inside & ((data & 0xC0) != 0x80)), "n_symbols": total(SYMBOL[data])}
    line_start, line_end = runs(data != 10, offsets)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    owner = np.searchsorted(offsets, line_start, "right") - 1
    key = np.unique(np.rec.fromarrays([owner, segment_hash(data, line_start, line_end)]))
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - np.bincount(key.f0, minlength=n) if len(owner) else np.zeros(n, np.int64)
    out["n_repeat_words"] = _repeated(segment_hash(data, starts, ends), first)
    return out


def _repeated(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window of eight words found twice or more in that text."""
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(len(count), np.int64)
    value = h[:n].copy()
    for k in range(1, WINDOW):
        value = value * M3 + h[k : n + k]
    value = mix(value) + text[:n].astype(U) * M1
    where = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    order = where[np.argsort(mix(value[where]), kind="stable")]
    v = value[order]
    same = v[1:] == v[:-1]
    dup = np.zeros(len(order), bool)
    dup[1:] |= same
    dup[:-1] |= same
    edge = np.zeros(len(h) + 1, np.int64)
    at = order[dup]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.bincount(text[np.cumsum(edge[:-1]) > 0], minlength=len(count))


def judge(docs: DataFrame, labelled: DataFrame, threshold: float = 0.2, max_rows: int = 2000, drawn: bool = False, min_words: int = 20,
        max_repeat: int = 30) -> DataFrame:
    """Counts, base verdict, probability and verdict of every row of ``docs`` (doc_id, text; other columns are ignored).

    base_failed: under ``min_words`` words, or more than ``max_repeat`` % of them in repeated 8-word windows. kept is
    false for these, else whether the calibrated probability of quality reaches ``threshold`` (always, without a model).
    A null text has no words. Repeated rows give repeated results; no rows give none.
    """
    model = train(labelled, max_rows, drawn)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            for i, j, d, o in slices(data, offsets):
                c = base_counts(d, o)
                failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat * c["n_words"])
                p = model.score(d, o) if model else np.ones(j - i)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *(pa.array(c[k], pa.int64()) for k in c), pa.array(failed),
                    pa.array(p), pa.array(~failed & (p >= threshold))], [*COLUMNS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))


COLUMNS = {"doc_id": "long", "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "quality": "double", "kept": "boolean"}
