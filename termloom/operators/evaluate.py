"""Scores: mentions, documents, patients (micro and macro), and their sum.

Mentions are (pmc_id, offset, length, identifier, note); associations (pmc_id, patient_id, identifier), with a null row
for a patient without any. Each score is one row; ids are compared as they are. Articles that a file repeats go through
last_mentions and last_associations first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_ids
from ..session import maybe_broadcast


def precision(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)


def recall(tp: Column, fn: Column) -> Column:
    return F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """The harmonic mean of precision and recall, 0 where both are 0."""
    return F.when(tp > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [precision(tp, fp).alias("precision"), recall(tp, fn).alias("recall"), f1(tp, fp, fn).alias("f1")]


def last_mentions(mentions: DataFrame, versions: DataFrame, ordinal: str = "doc_ord") -> DataFrame:
    """Of articles that a file holds more than once, the mentions of the last one; versions: (pmc_id, ordinal) of every article in it."""
    last = versions.groupBy("pmc_id").agg(F.max(ordinal).alias(ordinal))
    return mentions.join(last, ["pmc_id", ordinal], "left_semi").drop(ordinal)


def last_associations(associations: DataFrame, ordinal: str = "doc_ord") -> DataFrame:
    """Of patients that a file holds more than once, the identifiers of the last article that names them (with any or none)."""
    last = associations.groupBy("pmc_id", "patient_id").agg(F.max(ordinal).alias(ordinal))
    return associations.join(last, ["pmc_id", "patient_id", ordinal], "left_semi").drop(ordinal)


def units(mentions: DataFrame, *keys: str) -> DataFrame:
    """(keys, token) of mentions that aren't negated, repeated as they are; compounds are split."""
    return mentions.where(~F.col("note").eqNullSafe("NO")).select(*keys, F.explode(split_ids(F.col("identifier"))).alias("token"))


def seen(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The distinct rows of two tables with s: 1 in gold, 2 in pred, 3 in both; nulls equal nulls.

    The two sides are stacked and summed up by row, which a distinct on each and a full outer join would shuffle four times.
    """
    both = gold.withColumn("_g", F.lit(1)).unionByName(pred.select(*gold.columns).withColumn("_g", F.lit(2)))
    return both.groupBy(*gold.columns).agg(F.bit_or("_g").alias("s"))


def counted(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn of what ``seen`` gives, for each value of ``by`` or in one row."""
    n = lambda v: F.coalesce(F.sum(F.when(F.col("s") == v, 1).otherwise(0)), F.lit(0))
    return rows.groupBy(*(by or [])).agg(n(3).alias("tp"), n(2).alias("fp"), n(1).alias("fn"))


def compare(gold: DataFrame, pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn of the distinct rows of two tables."""
    return counted(seen(gold, pred), by)


def scored(counts: DataFrame) -> DataFrame:
    return counts.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def mentions_seen(gold: DataFrame, pred: DataFrame, articles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By place and token, in the gold ``articles`` (pmc_id) only."""
    keys = [*(by or []), "pmc_id", "offset", "length"]
    return seen(units(gold, *keys), units(pred.join(articles, "pmc_id", "left_semi"), *keys))


def documents_seen(mentions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By token of an article, from what ``mentions_seen`` gives."""
    return mentions.groupBy(*(by or []), "pmc_id", "token").agg(F.bit_or("s").alias("s"))


def score_mention(gold: DataFrame, pred: DataFrame, articles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By place and token, in the gold ``articles`` (pmc_id) only."""
    return scored(counted(mentions_seen(gold, pred, articles, by), by))


def score_document(gold: DataFrame, pred: DataFrame, articles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By token of an article, in the gold ``articles`` only."""
    return scored(counted(documents_seen(mentions_seen(gold, pred, articles, by), by), by))


def token_sides(*associations: DataFrame) -> DataFrame:
    """(pmc_id, patient_id, token, m): bit k of m is set where the kth association has the token, distinct; nulls equal nulls.

    A row without token has the bits of those that name the patient. All meet in one exchange, by article, which serves
    whatever is counted by article, patient or token after it; compounds are split behind it.
    """
    sides = [a.select("pmc_id", "patient_id", "identifier", F.lit(1 << k).alias("m")) for k, a in enumerate(associations)]
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    tokens = F.concat(F.array(F.lit(None).cast("string")), split_ids(F.col("identifier")))
    return rows.repartition("pmc_id").select("pmc_id", "patient_id", F.explode(tokens).alias("token"), "m").groupBy("pmc_id", "patient_id",
        "token").agg(F.bit_or("m").alias("m"))


def on_side(k: int) -> Column:
    """Whether the kth association has the row of ``token_sides``."""
    return F.col("m").bitwiseAND(1 << k) > 0


def patient_tokens(association: DataFrame, by: list[str] | None = None) -> DataFrame:
    return association.select(*(by or []), "pmc_id", "patient_id", F.explode(split_ids(F.col("identifier"))).alias("token"))


def score_micro(gold: DataFrame, pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By token of a patient; predicted patients and articles that gold lacks count as false."""
    return scored(compare(patient_tokens(gold, by), patient_tokens(pred, by), by))


def per_patient(gold: DataFrame, pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn and scores of every gold patient; one without any token on both sides has 1 throughout."""
    keys = [*(by or []), "pmc_id", "patient_id"]
    counts = gold.select(*keys).distinct().join(counted(seen(patient_tokens(gold, by), patient_tokens(pred, by)), keys), keys, "left").fillna(0,
        ["tp", "fp", "fn"])
    empty = F.col("tp") + F.col("fp") + F.col("fn") == 0
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*keys, "tp", "fp", "fn", *(F.when(empty, 1.0).otherwise(c).alias(a) for c, a in ((p, "precision"), (r, "recall"), (f, "f1"))))


def score_macro(gold: DataFrame, pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The mean of the gold patients' scores."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")]
    return per_patient(gold, pred, by).groupBy(*(by or [])).agg(F.count("*").alias("patients"), *means)


def score_total(gold_mentions: DataFrame, pred_mentions: DataFrame, articles: DataFrame, gold: DataFrame, pred: DataFrame,
    by: list[str] | None = None) -> DataFrame:
    """f1_men, f1_doc, f1_micro, f1_macro and score, a quarter of each."""
    by = by or []
    places = mentions_seen(gold_mentions, pred_mentions, articles, by)  # both scores of mentions come from one exchange
    scores = {
        "f1_men": scored(counted(places, by)), "f1_doc": scored(counted(documents_seen(places, by), by)),
        "f1_micro": score_micro(gold, pred, by), "f1_macro": score_macro(gold, pred, by),
    }
    parts = [df.select(*by, F.lit(k).alias("k"), "f1") for k, df in scores.items()]
    names = ["f1_men", "f1_doc", "f1_micro", "f1_macro"]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    wide = rows.groupBy(*by).agg(*(F.coalesce(F.max(F.when(F.col("k") == k, F.col("f1"))), F.lit(0.0)).alias(k) for k in names))
    return wide.withColumn("score", sum(F.col(k) for k in names) * 0.25)


def level_of(prob: Column, thresholds: list[float]) -> Column:
    """How many of the ascending thresholds a probability reaches; a null one reaches none."""
    return sum((F.coalesce(F.lit(float(t)) <= prob, F.lit(False)).cast("int") for t in thresholds), F.lit(0))


def levelled(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The distinct rows of ``gold`` and of ``pred`` (the same columns and level) with g, 1 if in gold, and level, the highest in pred or 0.

    What is predicted at a threshold is predicted at all lower ones, so one row holds what is known about it at every threshold.
    """
    both = gold.withColumns({"g": F.lit(1), "level": F.lit(0)}).unionByName(pred.select(*gold.columns, F.lit(0).alias("g"), "level"))
    return both.groupBy(*gold.columns).agg(F.max("g").alias("g"), F.max("level").alias("level"))


def cumulated(counts: DataFrame, columns: list[str], n: int, whole: tuple[str, ...] = ()) -> DataFrame:
    """``counts`` (level, columns, whole) with ``columns`` summed from the highest of n levels down and ``whole`` over all: a row for every level from 1 to n.

    The rows have been summed up by level before: the window is over n + 1 rows.
    """
    every = counts.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("level"), *(F.lit(0).alias(c) for c in (*columns, *whole)))
    summed = counts.select("level", *columns, *whole).unionByName(every).groupBy("level").agg(*(F.sum(c).alias(c) for c in (*columns, *whole)))
    down = Window.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return summed.select("level", *(F.sum(c).over(down).alias(c) for c in columns), *(F.sum(c).over(all_of).alias(c) for c in whole)).where(F.col("level") > 0)


def mentions_by_level(gold: DataFrame, pred: DataFrame, articles: DataFrame, n: int) -> DataFrame:
    """(level, f1_men, f1_doc) of ``gold`` (pmc_id, offset, length, identifier, note) and ``pred``, the same with level.

    Both meet in one exchange, by article; behind it each unit stands for its place and for its document, which are counted in
    one pass. What reaches no level changes nothing.
    """
    keys = ["pmc_id", "offset", "length"]
    there = maybe_broadcast(articles, articles.count(), 32)
    inside = pred.where(F.col("level") > 0).join(there if there is not articles else articles.hint("shuffle_hash"), "pmc_id", "left_semi")
    both = units(gold, *keys).withColumns({"g": F.lit(1), "level": F.lit(0)}).unionByName(units(inside, *keys, "level").withColumn("g", F.lit(0)))
    place = F.struct("offset", "length", F.lit(False).alias("doc"))
    document = F.struct(F.lit(None).cast("int").alias("offset"), F.lit(None).cast("int").alias("length"), F.lit(True).alias("doc"))
    each = both.repartition("pmc_id").select("pmc_id", "token", "g", "level", F.inline(F.array(place, document)))
    rows = each.groupBy("pmc_id", "token", "offset", "length", "doc").agg(F.max("g").alias("g"), F.max("level").alias("level"))
    of = lambda doc, c: F.sum(F.when(F.col("doc") == doc, c).otherwise(0))
    counts = rows.groupBy("level").agg(*(of(doc, c).alias(f"{k}_{name}") for k, doc in (("men", False), ("doc", True)) for name, c in (("tp", F.col("g")), ("fp", 1 - F.col("g")))))
    counts = counts.withColumns({"men_all": F.col("men_tp"), "doc_all": F.col("doc_tp")})
    sums = cumulated(counts, ["men_tp", "men_fp", "doc_tp", "doc_fp"], n, ("men_all", "doc_all"))
    return sums.select("level", *(f1(F.col(f"{k}_tp"), F.col(f"{k}_fp"), F.col(f"{k}_all") - F.col(f"{k}_tp")).alias(f"f1_{k}") for k in ("men", "doc")))


def patients_by_level(rows: DataFrame, n: int) -> DataFrame:
    """(level, f1_micro, f1_macro) of what ``levelled`` gives by pmc_id, patient_id and token.

    Macro is the mean F1 of the patients that have a row without token, as gold has them. A patient's F1 changes only at the
    levels of its own tokens: these changes are added up by level, from the highest down. Both come from one pass.
    """
    by = Window.partitionBy("pmc_id", "patient_id")
    there = F.col("token").isNotNull()
    levels = rows.groupBy("pmc_id", "patient_id", "level").agg(F.max(~there).alias("known"), F.sum(F.when(there, F.col("g")).otherwise(0)).alias("tp"),
        F.sum(F.when(there, 1 - F.col("g")).otherwise(0)).alias("fp"))
    down = by.orderBy(F.col("level").desc())
    total = lambda c: F.sum(c).over(down.rowsBetween(Window.unboundedPreceding, 0))
    placed = levels.select("pmc_id", "patient_id", "level", "tp", "fp", F.max("known").over(by).alias("known"), F.sum("tp").over(by).alias("gold"), total("tp").alias("tps"),
        total("fp").alias("fps"))
    nothing = F.when(F.col("gold") == 0, 1.0).otherwise(0.0)  # a patient without any token on both sides has 1
    at = F.when(F.col("tps") + F.col("fps") == 0, nothing).otherwise(f1(F.col("tps"), F.col("fps"), F.col("gold") - F.col("tps")))
    scored = placed.withColumn("_f1", at)
    change = F.when(F.col("known"), F.col("_f1") - F.coalesce(F.lag("_f1").over(down), nothing)).otherwise(0.0)
    # every known patient has one row of level 0, that of its missing token: there the changes are of no threshold
    first = F.col("known") & (F.col("level") == 0)
    changes = scored.select("level", "tp", "fp", F.when(F.col("level") > 0, change).otherwise(0.0).alias("change"), F.when(first, nothing).otherwise(0.0).alias("base"),
        first.cast("long").alias("n"))
    sums = changes.groupBy("level").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "change", "base", "n")), F.sum("tp").alias("gold"))
    mean = F.when(F.col("n") > 0, (F.col("base") + F.col("change")) / F.col("n")).otherwise(0.0)
    micro = f1(F.col("tp"), F.col("fp"), F.col("gold") - F.col("tp"))
    return cumulated(sums, ["tp", "fp", "change"], n, ("gold", "base", "n")).select("level", micro.alias("f1_micro"), mean.alias("f1_macro"))


def scores_by_level(mentions: DataFrame, patients: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, f1_men, f1_doc, f1_micro, f1_macro, score) of what mentions_by_level and patients_by_level give; thresholds ascend."""
    threshold = F.element_at(F.array(*(F.lit(float(t)) for t in thresholds)), F.col("level"))
    names = ["f1_men", "f1_doc", "f1_micro", "f1_macro"]
    return mentions.join(F.broadcast(patients), "level").select(threshold.alias("threshold"), *names, (sum(F.col(k) for k in names) * 0.25).alias("score"))


def gold_tokens(gold: DataFrame) -> DataFrame:
    """(pmc_id, patient_id, token) of an association, and a row without token for every patient."""
    return patient_tokens(gold).unionByName(gold.select("pmc_id", "patient_id", F.lit(None).cast("string").alias("token")))


def score_thresholds(gold_mentions: DataFrame, pred_mentions: DataFrame, articles: DataFrame, gold: DataFrame, pred: DataFrame,
    thresholds: list[float]) -> DataFrame:
    """(threshold, f1_men, f1_doc, f1_micro, f1_macro, score): score_total of the predictions whose ``prob`` reaches each threshold.

    ``pred_mentions`` and ``pred`` carry prob; a null one reaches no threshold. Nothing is repeated by threshold: every
    distinct place, token and patient is one row with the highest level it reaches, and scores are sums over levels.
    """
    distinct = sorted(set(thresholds))
    n, level = len(distinct), level_of(F.col("prob"), distinct)
    given = pred.select("pmc_id", "patient_id", "identifier", level.alias("level")).where(F.col("level") > 0)
    rows = levelled(gold_tokens(gold), given.select("pmc_id", "patient_id", "level", F.explode(split_ids(F.col("identifier"))).alias("token")))
    return scores_by_level(mentions_by_level(gold_mentions, pred_mentions.withColumn("level", level), articles, n), patients_by_level(rows, n), distinct)


def threshold_counts(rows: DataFrame, thresholds: list[float], name: str) -> DataFrame:
    """(threshold, name): how many rows of (prob) reach each threshold."""
    distinct = sorted(set(thresholds))
    counted = rows.groupBy(level_of(F.col("prob"), distinct).alias("level")).agg(F.count("*").alias(name))
    threshold = F.element_at(F.array(*(F.lit(float(t)) for t in distinct)), F.col("level"))
    return cumulated(counted, [name], len(distinct)).select(threshold.alias("threshold"), name)


def check_coverage(gold: DataFrame, pred: DataFrame, strict: bool = True) -> DataFrame:
    """One row: missing and extra articles. Disjoint sets are an error if ``strict``."""
    g, p = gold.select("pmc_id").distinct(), pred.select("pmc_id").distinct()
    counts = compare(g, p).select(F.col("fn").alias("missing"), F.col("fp").alias("extra"), F.col("tp").alias("common"))
    if strict and counts.first()["common"] == 0:
        raise ValueError("the prediction has none of the gold articles")
    return counts
