"""The experiment log: appended records, folded by tag, reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prep import in_parts

LOCAL = ["f1_men", "f1_doc", "f1_micro", "f1_macro", "score"]
ONLINE = ["board", "score", "task1_menF1", "task1_docF1", "task2_micF1", "task2_macF1", "submit_ts"]
RECORD = f"seq long, ts_local string, tag string, note string, split string, pred string, local struct<{','.join(f'{c}:double' for c in LOCAL)}>, online struct<{','.join(f'{c}:{'string' if c in ('board', 'submit_ts') else 'double'}' for c in ONLINE)}>"


def experiments_fold(log: DataFrame) -> DataFrame:
    """One row per tag: every leaf has its last value that isn't null; ``ord`` is the tag's first place in the log."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    flat = ["ts_local", "note", "split", "pred", *(f"local.{c}" for c in LOCAL), *(f"online.{c}" for c in ONLINE)]
    out = log.groupBy("tag").agg(F.min("seq").alias("ord"), *(last(c).alias(c.replace(".", "_")) for c in flat))
    return out.select("tag", "ord", "ts_local", "note", "split", "pred", F.struct(*(F.col(f"local_{c}").alias(c) for c in LOCAL)).alias("local"),
        F.struct(*(F.col(f"online_{c}").alias(c) for c in ONLINE)).alias("online"))


def experiments_upsert(log: DataFrame, records: DataFrame) -> DataFrame:
    """The log with records appended after it; read it through experiments_fold."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return log.unionByName(records.withColumn("seq", F.col("seq") + F.lit(last + 1)), allowMissingColumns=True)


def record_local(scores: DataFrame, tag: str, ts_local: str, note: str | None = None, split: str | None = None, pred: str | None = None) -> DataFrame:
    """A record of local scores (one row f1_men .. score), rounded to four places."""
    text = lambda x: F.lit(x).cast("string")
    return scores.select(F.lit(0).cast("long").alias("seq"), text(ts_local).alias("ts_local"), text(tag).alias("tag"), text(note).alias("note"),
        text(split).alias("split"), text(pred).alias("pred"),
                         F.struct(*(F.round(c, 4).alias(c) for c in LOCAL)).alias("local"),
                             F.lit(None).cast(RECORD.split("online ", 1)[1]).alias("online"))


def record_online(spark, tag: str, **values) -> DataFrame:
    """A record of leaderboard scores: any of ONLINE by name."""
    if odd := set(values) - set(ONLINE):
        raise ValueError(f"unknown {sorted(odd)}")
    return spark.createDataFrame([(0, None, tag, None, None, None, None, tuple(values.get(c) for c in ONLINE))], RECORD)


def _number(c: Column) -> Column:
    return F.when(c.isNull(), "--").otherwise(F.format_string("%.4f", c))


def experiments_report(folded: DataFrame) -> DataFrame:
    """(pos, tag, ts_local, local_score, delta_prev, online_score, gap, line) by ts_local, missing ones first.

    delta_prev is against the last local score before that isn't null; line is a row of a Markdown table. Tags are dealt
    by ranges of their order; what the parts before hold, their number and last score, comes from a window over the parts.
    """
    flat = folded.select(F.coalesce("ts_local", F.lit("")).alias("_at"), "ord", "tag", "ts_local", F.col("local.score").alias("local_score"),
        F.col("online.score").alias("online_score"))
    rows, parts = in_parts(flat, "_at", "ord")
    ends = rows.groupBy("_part").agg(F.max_by("local_score", F.when(F.col("local_score").isNotNull(), F.struct("_at", "ord"))).alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.join(ends, "_part").withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last", "_n")
    inside = Window.partitionBy("_part").orderBy("_at", "ord")
    previous = F.coalesce(F.last("local_score", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    # one row a part: bounded by the number of tasks
    placed = rows.join(F.broadcast(carried), "_part").withColumn("pos", (F.col("_base") + F.row_number().over(inside)).cast("int"))
    out = placed.withColumns({"delta_prev": F.col("local_score") - previous, "gap": F.col("online_score") - F.col("local_score")})
    cells = [F.coalesce("ts_local", F.lit("--")), F.col("tag"), *(_number(F.col(c)) for c in ("local_score", "delta_prev", "online_score", "gap"))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return out.select("pos", "tag", "ts_local", "local_score", "delta_prev", "online_score", "gap", line.alias("line"))
