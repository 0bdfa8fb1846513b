"""Language identification by the nearest of several centroids per language.

A text is a TF-IDF vector of hashed byte 1- to 4-grams of its lower-cased words, normalised to length one. Spherical
k-means gives each language several centroids; a text takes the language of the centroid with the highest cosine, and is
rejected where it is farther from that centroid than the training texts of its language allow. For that the cosine is
corrected for what the same weights dealt at random over all dimensions would give, as that grows with the text, and
compared with training texts of about as many distinct n-grams.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh
from .sampling import counted_keys, least_of_key, row_key, threshold_of
from .textual import BYTE_VALUE, LOWER, M1, M3, SEPARATOR, U, slices, utf8

DIMENSIONS = 1 << 12
UNKNOWN = "und"
#: Classes of length, by half powers of two of the number of distinct n-grams; a class's limit stands on this many rows.
CLASSES = 2 * DIMENSIONS.bit_length()
CLASS_ROWS = 20
#: A language gets at least so many rows of the sample, if it has them, and limits of its own from so many rows on.
LANGUAGE_FLOOR = 50
OWN_LIMITS = 10
FOLDS = 5
#: Space, digits and ASCII signs all count as one byte; what is left is letters and the bytes of other scripts.
FOLD = LOWER.copy()
FOLD[SEPARATOR] = 32
FOLD[[c for c in range(128) if not chr(c).isalpha() and not SEPARATOR[c]]] = 32


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n-gram counts [texts, DIMENSIONS]."""
    n, folded = len(offsets) - 1, FOLD[data]
    row = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, np.diff(offsets))
    value, g, out = BYTE_VALUE[folded], np.zeros(len(folded), U), np.zeros(n * DIMENSIONS, np.int64)
    shift = U(64 - (DIMENSIONS.bit_length() - 1))
    gap = folded == 32
    skip = gap.copy()
    skip[1:] &= gap[:-1]  # runs of gaps count as one
    skip[offsets[:-1][offsets[:-1] < len(skip)]] = False  # but not from text to text
    for size in (1, 2, 3, 4):
        m = len(folded) - size + 1
        if m <= 0:
            break
        g = g[:m] * M3 + value[size - 1 :] if size > 1 else value.copy()
        h = ((g ^ (g >> U(31))) * M1 >> shift).astype(np.int64) + row[:m]
        ok = (row[:m] == row[size - 1 :]) & ~skip[:m] & ~skip[size - 1 :]
        out += np.bincount(h[ok], minlength=len(out))
    return out.reshape(n, DIMENSIONS)


@dataclass
class Centroids:
    idf: np.ndarray
    vectors: np.ndarray  # [centroids, DIMENSIONS]
    languages: list[str]  # of each centroid
    least: np.ndarray  # [centroids, CLASSES], the corrected cosine under which a text is rejected

    def predict(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best centroid, the cosine with it, and whether that is too low."""
        x = weigh(c, self.idf)
        best, cosine, corrected = nearest(x, self.vectors)
        return best, np.clip(cosine, 0, 1), corrected < self.least[best, length_class(c)]


def length_class(c: np.ndarray) -> np.ndarray:
    return (2 * np.log2(np.maximum(np.count_nonzero(c, axis=1), 1))).astype(int)


def nearest(x: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best centroid, its cosine, and the cosine less that of the same weights dealt at random, scaled to end at 1."""
    cosine = x @ vectors.T
    best = cosine.argmax(1)
    cosine = cosine[np.arange(len(x)), best]
    chance = x.sum(1) * vectors.sum(1)[best] / DIMENSIONS
    return best, cosine, (cosine - chance) / np.maximum(1 - chance, 1e-9)


def limits(corrected: np.ndarray, classes: np.ndarray, quantile: float, slack: float) -> np.ndarray:
    """``slack`` times the quantile for each class of length, over the rows of the class and of as many shorter ones as it takes.

    A class shorter than all rows has the limit of the shortest, less by the root of the length. No limit is over that of
    a longer class. Without rows every limit is 0.
    """
    out = np.zeros(CLASSES)
    if not len(classes):
        return out
    first = int(classes.min())
    for k in range(first, CLASSES):
        low = k
        while low > first and np.count_nonzero((classes >= low) & (classes <= k)) < CLASS_ROWS:
            low -= 1
        out[k] = slack * max(float(np.quantile(corrected[(classes >= low) & (classes <= k)], quantile)), 0.0)
    out = np.minimum.accumulate(out[::-1])[::-1]
    out[:first] = out[first] * 2 ** ((np.arange(first) - first) / 4)
    return out


def weigh(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(c.astype(np.float32)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def bounds(sizes: dict[str, int], max_rows: int) -> dict[str, int]:
    """How many rows of each language are drawn: all of the small ones, and of the others equal shares of what is left of ``max_rows``.

    No share is under LANGUAGE_FLOOR, or under an equal part of max_rows where there are too many languages for that; the
    sum is never over max_rows.
    """
    out, left = {}, max_rows
    for k, name in enumerate(sorted(sizes, key=lambda name: (sizes[name], name))):
        out[name] = min(sizes[name], max(left // (len(sizes) - k), min(LANGUAGE_FLOOR, max_rows // len(sizes))))
        left -= out[name]
    return out


def sample(known: DataFrame, key: str, max_rows: int, max_languages: int) -> tuple[DataFrame, dict[str, int]]:
    """Rows of ``known`` (lang, and ``key``, see sampling.row_key) whose key is low enough, and how many distinct keys each language may keep.

    Only the ``max_languages`` languages with the most rows are learned; a warning names the next one.
    """
    largest = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(max_languages + 1).collect()
    if len(largest) > max_languages:
        warnings.warn(f"languages from {largest[-1]['lang']!r} on ({largest[-1]['count']} rows or fewer) are not learned", stacklevel=3)
    own = known.where(F.col("lang").isin([r["lang"] for r in largest[:max_languages]]))
    sizes = {r["lang"]: max(r["n_keys"], 1) for r in counted_keys(own, key, "lang").collect()} if largest else {}
    most = bounds(sizes, max_rows)
    if not sizes:
        return own, most
    limit = F.create_map(*(F.lit(v) for name in sizes for v in (name, threshold_of(most[name], sizes[name]))))
    return own.where(F.col(key) < F.try_element_at(limit, F.col("lang"))), most


def centroids(own: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means over one language's vectors; fewer centroids where there are fewer rows."""
    centre = own[np.linspace(0, len(own) - 1, min(k, len(own))).astype(int)].copy()
    for _ in range(rounds):
        near = (own @ centre.T).argmax(1)
        for j in range(len(centre)):
            if (near == j).any():
                s = own[near == j].sum(0)
                centre[j] = s / max(float(np.sqrt((s * s).sum())), 1e-9)
    return centre


def held_out(own: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """The corrected cosine of each row with the centroids of the rows of other folds."""
    out, fold = np.zeros(len(own)), np.arange(len(own)) % min(FOLDS, len(own))
    for f in range(fold.max() + 1):
        out[fold == f] = nearest(own[fold == f], centroids(own[fold != f], k, rounds))[2]
    return out


def fit(labelled: DataFrame, max_rows: int = 2000, per_language: int = 3, quantile: float = 0.002, slack: float = 0.6, rounds: int = 10,
        max_languages: int = 32) -> Centroids | None:
    """Centroids from at most ``max_rows`` rows of ``labelled`` (doc_id, text, lang), drawn by language (see bounds) with a hash of the id.

    Rows of one language and id count once, as do rows without an id that have one text. At most ``max_languages``
    languages are learned, those with the most rows.

    A language's limits come from rows held out of its centroids. One with under OWN_LIMITS rows takes those of rows of all
    languages against ``per_language`` rows alone, or folds of a small language's. Null texts and languages don't count. None if nothing is left.
    """
    key, tie = "key", "tie"
    named = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", row_key().alias(key), F.xxhash64("text").alias(tie))
    drawn, most = sample(named, key, max_rows, max_languages)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[str, int], int] = {}
        for b in batches:
            keys = list(zip(b.column("lang").to_pylist(), b.column(key).to_pylist(), strict=True))
            b = b.take(pa.array(least_of_key(keys, b.column(tie).to_pylist(), least), pa.int64()))
            for i, j, d, o in slices(*utf8(b.column("text")), texts=256):
                c, cells = counts(d, o), []
                for r in c:
                    at = np.flatnonzero(r)
                    cells.append(np.rec.fromarrays([at, r[at]], dtype=[("i", "<u2"), ("v", "<u4")]).tobytes())
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(i, j - i) for n in (key, tie, "lang")), pa.array(cells, pa.binary())], [key, tie, "lang", "f"])

    if not most:
        return None
    made = drawn.select(key, tie, "lang", "text").mapInArrow(features, "key long, tie long, lang string, f binary")
    once = made.groupBy("lang", key).agg(F.min(F.struct(tie, "f"))["f"].alias("f"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(key))
    limit = F.create_map(*(F.lit(v) for pair in most.items() for v in pair))
    kept = once.withColumn("place", place).where(F.col("place") <= F.try_element_at(limit, F.col("lang"))).select(key, "lang", "f")

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := [b for b in batches if len(b)]:
            model = learn(pa.Table.from_batches(rows).sort_by(key), per_language, quantile, slack, rounds)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # max_rows rows at most: one task learns from them, and the driver gets the centroids alone
    model = kept.coalesce(1).mapInArrow(learned, "model binary").first()
    if model is None:
        raise RuntimeError("no labelled row was drawn")
    return pickle.loads(model["model"])


def learn(got: pa.Table, per_language: int, quantile: float, slack: float, rounds: int) -> Centroids:
    """Centroids and limits from rows (lang, f), f the text's n-gram counts."""
    c = np.zeros((len(got), DIMENSIONS), np.float32)
    for r, f in enumerate(got["f"]):
        cell = np.frombuffer(f.as_py(), [("i", "<u2"), ("v", "<u4")])
        c[r, cell["i"]] = cell["v"]
    lang = np.array(got["lang"].to_pylist(), object)
    classes = length_class(c)
    del got
    idf = (np.log((1 + len(c)) / (1 + np.count_nonzero(c, axis=0))) + 0.1).astype(np.float32)
    x = np.log1p(c, out=c)  # as weigh does, in place
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)
    vectors, names, least, few, few_classes = [], [], [], [], []
    for name in sorted(set(lang)):
        own, of = x[lang == name], classes[lang == name]
        vectors.append(centroids(own, per_language, rounds))
        names += [name] * len(vectors[-1])
        if len(own) >= OWN_LIMITS:
            least += [limits(held_out(own, per_language, rounds), of, quantile, slack)] * len(vectors[-1])
            at = np.linspace(0, len(own) - 1, per_language).astype(int)
            few.append(nearest(np.delete(own, at, 0), own[at])[2])
            few_classes.append(np.delete(of, at))
        else:
            least += [None] * len(vectors[-1])
            if len(own) > 1:
                few.append(held_out(own, per_language, rounds))
                few_classes.append(of)
    shared = limits(np.concatenate([*few, []]), np.concatenate([*few_classes, []]).astype(int), quantile, slack)
    return Centroids(idf, np.concatenate(vectors), names, np.array([shared if own is None else own for own in least]))


ADDED = {"lang_pred": "string", "score": "double", "rejected": "boolean"}


def identify(docs: DataFrame, model: Centroids | None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (doc_id, if none are named) and lang_pred, score, rejected of every row of ``docs`` (doc_id, text).

    A null text, or one without a letter, is ``und`` with score 0 and rejected, as is every text where there is no model.
    A rejected text with letters still carries its nearest language. Repeated rows give repeated results. Columns of the
    three added names are replaced.
    """
    kept = [c for c in columns or ["doc_id"] if c not in ADDED]
    body, letter = fresh(docs, "body", "letter")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letters = b.column(letter).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, d, o in slices(*utf8(b.column(body)), texts=512):
                known = letters[i:j] & (model is not None)
                lang, score, far = np.full(j - i, UNKNOWN, object), np.zeros(j - i), np.ones(j - i, bool)
                if known.any():
                    best, cosine, low = model.predict(counts(d, o))
                    lang[known] = np.array(model.languages, object)[best[known]]
                    score[known] = cosine[known]
                    far[known] = low[known]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in kept), pa.array(lang, pa.string()),
                    pa.array(score, pa.float64()), pa.array(far)], [*kept, *ADDED])

    rows = docs.select(*kept, F.col("text").alias(body), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(letter))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields]
    return rows.mapInArrow(predicted, ", ".join([*schema, *(f"{k} {v}" for k, v in ADDED.items())]))
