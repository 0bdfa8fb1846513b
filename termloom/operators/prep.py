"""Corpus preparation and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import with_slice
from ..functions.text import split_ids, split_ids_real
from ..session import stage

#: Fields that every mention of a submission must have.
FIELDS = ["identifier", "type", "offset", "length", "text", "note"]


def in_parts(df: DataFrame, *order: str | Column) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): ``df`` dealt by ranges of ``order`` and written, with _part; and (_part, _n, _base), each part's rows and those before it.

    There are as many parts as tasks wrote, whatever the number of rows; a window over them is all that one task does.
    """
    rows = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")  # the parts are drawn once
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows, parts


def with_ordinal(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with doc_ord, the place from 0 in the given order.

    Rows are range-partitioned, written, and counted by partition first, so no task numbers them all.
    """
    rows, parts = in_parts(df, *order)
    inside = Window.partitionBy("_part").orderBy(*order)
    # one row a part: bounded by the number of tasks
    return rows.join(F.broadcast(parts), "_part").withColumn("doc_ord", F.col("_base") + F.row_number().over(inside) - 1).drop("_part", "_n", "_base")


def split_every_k(df: DataFrame, k: int = 5, ordinal: str = "doc_ord") -> DataFrame:
    """``df`` with split: dev where the ordinal is divisible by k, else train."""
    return df.withColumn("split", F.when(F.col(ordinal) % k == 0, "dev").otherwise("train"))


def blank_answers(articles: DataFrame) -> DataFrame:
    """The input version of articles: no entities, no associations."""
    kinds = dict(articles.dtypes)
    return articles.withColumns({c: F.array().cast(kinds[c]) for c in ("entities", "association")})


def corpus_stats(articles: DataFrame, patients: DataFrame, mentions: DataFrame, associations: DataFrame) -> DataFrame:
    """One row of totals: articles, patients, mentions, unique ids (without -1), negated, compound, without id, pairs, unique patient ids."""
    k = F.lit(1).alias("k")
    real = split_ids_real(F.col("identifier"))
    m = mentions.agg(F.count("*").alias("mentions"), F.sum(F.col("note").eqNullSafe("NO").cast("int")).alias("negated"),
        F.sum((F.size(split_ids(F.col("identifier"))) > 1).cast("int")).alias("compound"), F.sum((F.size(real) == 0).cast("int")).alias("no_id"))
    u = mentions.select(F.explode(real).alias("id")).agg(F.countDistinct("id").alias("unique_ids"))
    p = associations.where(F.col("identifier").isNotNull()).agg(F.count("*").alias("pairs"))
    up = associations.select(F.explode(split_ids_real(F.col("identifier"))).alias("id")).agg(F.countDistinct("id").alias("unique_patient_ids"))
    out = articles.agg(F.count("*").alias("articles")).select(k, "articles")
    for part in (patients.agg(F.count("*").alias("patients")), m, u, p, up):
        out = out.join(part.select(k, "*"), "k")
    return out.drop("k")


def section_counts(segments: DataFrame) -> DataFrame:
    label = F.coalesce("section_type", *(["type"] if "type" in segments.columns else []), F.lit("?"))
    return segments.groupBy(label.alias("section_type")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "section_type")


def patient_mentions(patients: DataFrame) -> DataFrame:
    """(pmc_id, patient_id, idx, offset, length, text): the mentions of (pmc_id, patient_id, mentions), numbered from 0 by patient."""
    return patients.select("pmc_id", "patient_id", F.posexplode("mentions").alias("idx", "m")).select("pmc_id", "patient_id", "idx", "m.offset",
        "m.length", "m.text")


def check_offsets(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """Mentions whose text isn't what stands at their place in (pmc_id, text); a null offset or text is skipped."""
    size = F.coalesce("length", F.length("text"))
    known = mentions.where(F.col("offset").isNotNull() & F.col("text").isNotNull())
    return with_slice(known, texts, F.col("offset"), F.col("offset") + size, "found").where(F.col("found") != F.col("text"))


def check_ontology_ids(mentions: DataFrame, aliases: DataFrame, descendants: DataFrame, terms: DataFrame) -> DataFrame:
    """(token, main_id, obsolete, n): tokens that, one alias hop on, lie outside the subtree, and how many mentions have them."""
    tokens = mentions.select(F.explode(split_ids_real(F.col("identifier"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    main = tokens.join(aliases.select(F.col("alias").alias("token"), F.col("id").alias("to")), "token", "left").withColumn("main_id", F.coalesce("to", "token"))
    out = main.join(descendants.select(F.col("id").alias("main_id")), "main_id",
        "left_anti").join(terms.select(F.col("id").alias("token"), "obsolete"), "token", "left")
    return out.select("token", "main_id", F.coalesce("obsolete", F.lit(False)).alias("obsolete"), "n")


def check_submission(inputs: DataFrame, lines: DataFrame) -> DataFrame:
    """One row about a submission: ``inputs`` (doc_ord, pmc_id) and the JSON ``lines`` (doc_ord, value).

    articles and expected, out_of_order (places with another id), missing_fields (articles with an incomplete mention),
    entities, phenotypes. A field counts as there if its key is, null or not.
    """
    entity = F.from_json(F.get_json_object("value", "$.entities"), "array<string>")
    phenotypes = F.from_json("value", "association array<struct<phenotype:array<string>>>")["association"]["phenotype"]
    parsed = lines.select("doc_ord", F.get_json_object("value", "$.pmc_id").alias("got"),
        F.coalesce(entity, F.array().cast("array<string>")).alias("e"), F.coalesce(F.size(F.flatten(phenotypes)), F.lit(0)).alias("n"))
    complete = F.forall("e", lambda x: F.size(F.array_intersect(F.json_object_keys(x), F.array(*(F.lit(f) for f in FIELDS)))) == len(FIELDS))
    both = inputs.select("doc_ord", "pmc_id").join(parsed, "doc_ord", "full_outer")
    return both.agg(F.count("got").alias("articles"), F.count("pmc_id").alias("expected"),
        F.sum((~F.col("got").eqNullSafe(F.col("pmc_id"))).cast("int")).alias("out_of_order"), F.sum((~complete).cast("int")).alias("missing_fields"),
        F.sum(F.size("e")).alias("entities"), F.sum("n").alias("phenotypes"))
