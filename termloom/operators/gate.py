"""The learned gate: labels, features, preprocessing, model, thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import with_slice
from ..functions.text import split_ids
from ..session import maybe_broadcast
from .associate import associate_nearest, nearest
from .evaluate import score_thresholds, threshold_counts

#: Words that negate, and words for a normal finding.
NEGATION = r"\b(no|not|without|absent|denies|denied|deny|negative|neither|nor|none|ruled?\s+out|rules\s+out|cannot)\b"
NORMAL = r"\b(normal|unremarkable|within\s+normal\s+limits|wnl|unaffected)\b"
KEEP_WORDS = (NEGATION, NORMAL)
NUMERIC = ["retrieved_score", "mention_char_len", "mention_word_len", "hpo_depth", "rel_position", "dist_to_nearest_anchor_norm", "patient_count"]
BINARY = ["is_dict_hit", "has_negation_cue", "has_normal_cue"]
MISSABLE = ["retrieved_score", "hpo_depth", "dist_to_nearest_anchor_norm"]
OTHER = "__UNK__"


def gold_union(gold: DataFrame) -> DataFrame:
    """(pmc_id, token): what any patient of the article has."""
    return gold.select("pmc_id", F.explode(split_ids(F.col("identifier"))).alias("token")).distinct()


def label_samples(mentions: DataFrame, gold: DataFrame) -> DataFrame:
    """``mentions`` with label 1 where any of its tokens is in the article's gold union, else 0."""
    hit = mentions.select("pmc_id", "ent_idx", F.explode(split_ids(F.col("identifier"))).alias("token")).join(gold_union(gold), ["pmc_id", "token"],
        "left_semi").select("pmc_id", "ent_idx").distinct().withColumn("label", F.lit(1))
    return mentions.join(hit, ["pmc_id", "ent_idx"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def label_balance(samples: DataFrame) -> DataFrame:
    n = F.count("*")
    up = F.coalesce(F.sum("label"), F.lit(0))
    return samples.agg(up.alias("positive"), (n - up).alias("negative"), F.round(F.when(n > 0, 100.0 * up / n).otherwise(0.0), 4).alias("positive_pct"))


def cue(text: Column, pattern: str) -> Column:
    return F.when(F.lower(text).rlike("(?U)" + pattern), 1).otherwise(0)


def gate_features(mentions: DataFrame, texts: DataFrame, patients: DataFrame, depth: DataFrame, width: int = 120) -> DataFrame:
    """``mentions`` (with ``section``, and retrieved_score where retrieved) with the eleven raw features; no gold is used."""
    if "retrieved_score" not in mentions.columns:
        mentions = mentions.withColumn("retrieved_score", F.lit(None).cast("double"))
    names = mentions.select("identifier").distinct()
    depths = names.select("identifier", F.explode(split_ids(F.col("identifier"))).alias("id")).join(depth, "id").groupBy("identifier").agg(
        F.min("depth").alias("hpo_depth"))
    has = patients.groupBy("pmc_id").agg(F.countDistinct("roster_idx").alias("patient_count"))
    sizes = texts.select("pmc_id", F.length("text").alias("_size"))
    near = nearest(mentions, patients).withColumnRenamed("dist", "_d").drop("roster_idx", "patient_id")
    window = with_slice(near, texts, F.greatest(F.lit(0), F.col("offset") - width), F.col("offset") + F.col("length") + width, "_w")
    cues = window.withColumns({"has_negation_cue": cue(F.col("_w"), NEGATION), "has_normal_cue": cue(F.col("_w"), NORMAL)}).drop("_w")
    out = cues.join(sizes, "pmc_id").join(has, "pmc_id", "left").join(maybe_broadcast(depths, names.count(), 100), "identifier", "left")
    size = F.col("_size")
    return out.withColumns({
        "section_type": F.upper("section"),
        "is_dict_hit": F.when(F.col("retrieved_score").isNull(), 1).otherwise(0),
        "mention_char_len": F.length(F.coalesce("text", F.lit(""))),
        "mention_word_len": F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1))),
        "rel_position": F.when(size > 0, F.col("offset") / size).otherwise(0.0),
        "dist_to_nearest_anchor_norm": F.col("_d") / F.greatest(F.lit(1), size),
        "patient_count": F.coalesce("patient_count", F.lit(0)),
    }).drop("_size", "_d")


def gate_fit(samples: DataFrame) -> dict:
    """Means (which fill nulls), population deviations of the filled columns (1 for constant ones), and sections.

    Two aggregates over the training samples, whatever their number; nothing but these numbers is gathered.
    """
    means = samples.agg(*(F.avg(c).alias(c) for c in NUMERIC), F.sort_array(F.collect_set("section_type")).alias("sections")).first()
    fill = {c: float(means[c]) if means[c] is not None else 0.0 for c in NUMERIC}
    spread = samples.agg(*(F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(fill[c]))).alias(c) for c in NUMERIC)).first()
    sections = list(means["sections"]) + ([] if OTHER in means["sections"] else [OTHER])
    return {"sections": sections, "fill": fill, "mean": fill, "std": {c: float(spread[c]) if spread[c] else 1.0 for c in NUMERIC}}


def feature_names(state: dict) -> list[str]:
    return [*NUMERIC, *BINARY, *(f"{c}_isnull" for c in MISSABLE), *(f"section={s}" for s in state["sections"])]


def gate_vector(state: dict) -> list[Column]:
    """The features' columns in the order of feature_names."""
    known = [s for s in state["sections"] if s != OTHER]
    scaled = [(F.coalesce(F.col(c).cast("double"), F.lit(state["fill"][c])) - state["mean"][c]) / state["std"][c] for c in NUMERIC]
    section = F.when(F.col("section_type").isin(known), F.col("section_type")).otherwise(OTHER)
    return [*scaled, *(F.col(c).cast("double") for c in BINARY), *(F.when(F.col(c).isNull(), 1.0).otherwise(0.0) for c in MISSABLE),
        *(F.when(section == s, 1.0).otherwise(0.0) for s in state["sections"])]


def gate_transform(samples: DataFrame, state: dict) -> DataFrame:
    return samples.withColumn("features", F.array(*gate_vector(state)))


def newton_sums(rows: DataFrame, weights: np.ndarray, positive_weight: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Total weight, log-loss, its gradient and its matrix of second derivatives at ``weights`` (the last one is the bias), of rows (features, label).

    A task sums up its rows; the tasks' sums are added by cell, so only one number a cell reaches the driver.
    """
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 + size + size * size)
        for b in batches:
            if not len(b):
                continue
            x = np.column_stack([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1), np.ones(len(b))])
            y = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            m, each = x @ weights, np.where(y == 1, positive_weight, 1.0)
            p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
            second = (x * (each * p * (1 - p))[:, None]).T @ x
            sums += np.concatenate([[each.sum(), (each * (np.logaddexp(0, m) - y * m)).sum()], x.T @ (each * (p - y)), second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["cell", "value"])

    cells = rows.select("features", "label").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros(2 + size + size * size)
    for r in cells:
        sums[r["cell"]] = r["value"]
    return sums[0], sums[1], sums[2 : 2 + size], sums[2 + size :].reshape(size, size)


def gate_train(samples: DataFrame, state: dict, positive_weight: float = 1.0, iterations: int = 50, ridge: float = 1e-6,
    tolerance: float = 1e-9) -> tuple[list[float], float]:
    """(weights, bias) of the least mean log-loss; rows of label 1 count ``positive_weight`` times.

    Newton steps, each from sums over all rows; a step that raises the loss is halved. The ridge is no regularisation to
    speak of: it makes the weights unique where features depend on each other, as the sections' do, and keeps them finite
    where the classes come apart. Without rows all weights are 0.
    """
    rows, w = gate_transform(samples, state), np.zeros(len(feature_names(state)) + 1)

    def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        total, loss, first, second = newton_sums(rows, at, positive_weight)
        total = max(total, 1.0)
        return loss / total + ridge / 2 * at @ at, first / total + ridge * at, second / total + ridge * np.eye(len(at))

    loss, first, second = sums(w)
    for _ in range(iterations):
        step = np.linalg.solve(second, first)
        if np.abs(step).max() < tolerance:
            break
        new = sums(w - step)
        while new[0] > loss + 1e-12 and np.abs(step).max() > tolerance:
            step /= 2
            new = sums(w - step)
        w, (loss, first, second) = w - step, new
    return w[:-1].tolist(), float(w[-1])


def gate_predict(samples: DataFrame, state: dict, weights: list[float], bias: float) -> DataFrame:
    """``samples`` with keep_prob, an expression of its columns."""
    total = F.lit(float(bias))
    for w, c in zip(weights, gate_vector(state), strict=True):
        total = total + c * F.lit(float(w))
    return samples.withColumn("keep_prob", 1 / (1 + F.exp(-total)))


def gate_sweep(predicted: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, retention_pct, precision, recall, f1) of keeping probabilities at each threshold or above; one pass."""
    each = predicted.select("label", "keep_prob", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    keep = F.col("keep_prob") >= F.col("threshold")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = each.groupBy("threshold").agg(n(keep & (F.col("label") == 1)).alias("tp"), n(keep & (F.col("label") == 0)).alias("fp"),
        n(~keep & (F.col("label") == 1)).alias("fn"), F.count("*").alias("n"))
    from .evaluate import prf

    return counts.select("threshold", (100.0 * (F.col("tp") + F.col("fp")) / F.col("n")).alias("retention_pct"), *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def gate_apply(predicted: DataFrame, patients: DataFrame, threshold: float) -> DataFrame:
    """Mentions kept at the threshold, routed to the nearest patient."""
    return associate_nearest(predicted.where(F.col("keep_prob") >= threshold), patients)


def gate_threshold_scan(predicted: DataFrame, patients: DataFrame, gold_mentions: DataFrame, gold: DataFrame, articles: DataFrame,
    thresholds: list[float]) -> DataFrame:
    """(threshold, kept, f1_micro, f1_macro, score, delta_macro, best) by threshold, all in one pass.

    Best is the first highest score, to nine places: sums differ in the last ones by their order.

    ``predicted`` are the recognised mentions with keep_prob. Routing doesn't depend on the threshold, and what is kept at
    one is kept at all lower ones: mentions are routed once, and counted by the highest threshold they reach.
    """
    routed = nearest(predicted.select("pmc_id", "offset", "identifier", "keep_prob"), patients).where(F.col("patient_id").isNotNull()).select("pmc_id", "patient_id", "identifier", F.col("keep_prob").alias("prob"))
    all_mentions = predicted.select("pmc_id", "offset", "length", "identifier", "note", F.lit(float("inf")).alias("prob"))
    scores = score_thresholds(gold_mentions, all_mentions, articles, gold, routed, thresholds)
    counts = threshold_counts(predicted.select(F.col("keep_prob").alias("prob")), thresholds, "kept")
    order = Window.orderBy("threshold")  # of one row a threshold
    best = F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "threshold")) == 1
    return counts.join(F.broadcast(scores), "threshold").withColumn("delta_macro", F.col("f1_macro") - F.first("f1_macro").over(order)).withColumn("best",
        best).select("threshold", "kept", "f1_micro", "f1_macro", "score", "delta_macro", "best")
