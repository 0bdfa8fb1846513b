"""Where one association loses against another, patient by patient."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast, stage
from .evaluate import f1, on_side, token_sides

EQUAL = 1e-9


def _counts(gold: DataFrame, base: DataFrame, model: DataFrame) -> DataFrame:
    """patient_delta without outcome, with missed and extra, how many tokens the model lacks and has in excess; one exchange."""
    there = F.col("token").isNotNull()
    n = lambda c: F.sum(F.when(there & c, 1).otherwise(0))
    sides = token_sides(gold, base, model).where(F.col("pmc_id").isNotNull() & F.col("patient_id").isNotNull())
    counts = sides.groupBy("pmc_id", "patient_id").agg(F.max(~there & on_side(0)).alias("known"), n(on_side(0)).alias("n_gold"),
        *(n(on_side(k)).alias(f"n{k}") for k in (1, 2)), *(n(on_side(0) & on_side(k)).alias(f"tp{k}") for k in (1, 2))).where("known")
    score = lambda k: F.when(F.col("n_gold") + F.col(f"n{k}") == 0, 1.0).otherwise(f1(F.col(f"tp{k}"), F.col(f"n{k}") - F.col(f"tp{k}"),
        F.col("n_gold") - F.col(f"tp{k}")))
    return counts.select("pmc_id", "patient_id", "n_gold", score(1).alias("f1_base"), score(2).alias("f1_model"), (F.col("n_gold") - F.col("tp2")).alias("missed"),
        (F.col("n2") - F.col("tp2")).alias("extra")).withColumn("delta", F.col("f1_model") - F.col("f1_base"))


def patient_delta(gold: DataFrame, base: DataFrame, model: DataFrame) -> DataFrame:
    """(pmc_id, patient_id, n_gold, f1_base, f1_model, delta, outcome) of every gold patient."""
    both = _counts(gold, base, model).select("pmc_id", "patient_id", "n_gold", "f1_base", "f1_model", "delta")
    return both.withColumn("outcome", F.when(F.col("delta") > EQUAL, "better").when(F.col("delta") < -EQUAL, "worse").otherwise("same"))


def bucket_delta(deltas: DataFrame) -> DataFrame:
    """By size of the gold set (<=2, 3-5, >5): patients, mean scores, mean delta, and the share of the macro change."""
    total = deltas.count()
    size = F.when(F.col("n_gold") <= 2, "<=2").when(F.col("n_gold") <= 5, "3-5").otherwise(">5")
    return deltas.groupBy(size.alias("bucket")).agg(F.count("*").alias("n"), F.avg("f1_base").alias("f1_base"), F.avg("f1_model").alias("f1_model"),
        F.avg("delta").alias("delta"), (F.sum("delta") / F.lit(max(total, 1))).alias("contribution"))


def token_states(gold: DataFrame, base: DataFrame, model: DataFrame) -> DataFrame:
    """(pmc_id, patient_id, token, in_gold, in_base, in_model) of the gold patients."""
    sides = token_sides(gold, base, model).where(F.col("pmc_id").isNotNull() & F.col("patient_id").isNotNull())
    known = F.max(F.col("token").isNull() & on_side(0)).over(Window.partitionBy("pmc_id", "patient_id"))
    return sides.withColumn("_known", known).where(F.col("_known") & F.col("token").isNotNull()).select("pmc_id", "patient_id", "token",
        on_side(0).alias("in_gold"), on_side(1).alias("in_base"), on_side(2).alias("in_model"))


def miss_extra(gold: DataFrame, base: DataFrame, model: DataFrame) -> DataFrame:
    """One row: gold tokens that the model missed, tokens that it has in excess, patients that it zeroed and rescued."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    base_has, model_has = F.col("f1_base") > EQUAL, F.col("f1_model") > EQUAL
    return _counts(gold, base, model).agg(total("missed").alias("missed"), total("extra").alias("extra"),
        total((base_has & ~model_has).cast("int")).alias("zeroed"), total((~base_has & model_has).cast("int")).alias("rescued"))


def miss_destination(gold: DataFrame, base: DataFrame, model: DataFrame) -> DataFrame:
    """(pmc_id, patient_id, token, destination) of each gold token that the model missed.

    to_other: the model gave it to another patient of the article; else to_none: the base had it right; else to_lost.
    The others are looked up by (article, token), so patients are not paired; what names a gold token names a gold patient.
    """
    sides = token_sides(gold, base, model).where(F.col("pmc_id").isNotNull() & F.col("token").isNotNull())
    other = sides.withColumn("_other", F.max(on_side(2)).over(Window.partitionBy("pmc_id", "token")))
    missed = other.where(F.col("patient_id").isNotNull() & on_side(0) & ~on_side(2))
    where = F.when(F.col("_other"), "to_other").when(on_side(1), "to_none").otherwise("to_lost")
    return missed.select("pmc_id", "patient_id", "token", where.alias("destination"))


def worst_patients(gold: DataFrame, base: DataFrame, model: DataFrame, n: int = 10) -> DataFrame:
    """The n patients that lose most, with their gold, base, model, missed and extra tokens, sorted."""
    worst = stage(patient_delta(gold, base, model).where(F.col("delta") < -EQUAL).orderBy("delta", "pmc_id", "patient_id").limit(n), "worst")
    few = maybe_broadcast(worst.select("pmc_id", "patient_id"), n, 100)
    s = token_states(*(a.join(few, ["pmc_id", "patient_id"], "left_semi") for a in (gold, base, model)))  # only their rows are dealt
    some = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("token"))))
    g, b, m = F.col("in_gold"), F.col("in_base"), F.col("in_model")
    sets = s.groupBy("pmc_id", "patient_id").agg(some(g).alias("gold"), some(b).alias("base"), some(m).alias("model"), some(g & ~m).alias("missed"),
        some(~g & m).alias("extra"))
    return worst.join(sets, ["pmc_id", "patient_id"], "left").orderBy("delta", "pmc_id", "patient_id")
