"""Article, answer and vector sources and sinks, with declared schemas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prep import with_ordinal
from ..session import stage

SEGMENT = "struct<offset:int,text:string,section_type:string,type:string>"
PATIENT = "struct<patient_id:string,mention:array<struct<offset:int,length:int,text:string>>>"
ENTITY = "struct<identifier:string,type:string,offset:int,length:int,text:string,note:string,retrieved_name:string,retrieved_score:double>"
ASSOCIATION = "struct<patient_id:string,phenotype:array<string>>"
ARTICLE = f"pmc_id string, pmid string, full_text array<{SEGMENT}>, patient array<{PATIENT}>, entities array<{ENTITY}>, association array<{ASSOCIATION}>"
ANSWER = "pmc_id string, response string, n_new_tokens int, budget int"
MANIFEST = "model string, pooling string, dim int, num_entries long, num_concepts long"


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as articles; blank lines are skipped, a malformed one is an error."""
    return spark.read.schema(ARTICLE).option("mode", "FAILFAST").json(path)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows``, just read from files, with doc_ord: their place from 0 by file name and place in the file.

    Files are read in splits, so a row's place is that of its split in the file, then that in the split.
    """
    at = {"_file": F.col("_metadata.file_path"), "_split": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()}
    return with_ordinal(rows.select("*", *(c.alias(k) for k, c in at.items())), *at).drop(*at)


def read_articles_numbered(spark: SparkSession, path: str) -> DataFrame:
    """read_articles with doc_ord, an article's place in the input."""
    return numbered(read_articles(spark, path))


def read_lines_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, doc_ord): the lines of text files, unparsed; blank ones are skipped."""
    return numbered(spark.read.text(path).where(F.trim("value") != ""))


def write_in_order(rows: DataFrame, path: str, *order: str | Column) -> None:
    """(value) as lines of files whose names and lines follow ``order``."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def place_in_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (file, split, line) as they are read: those with a line, numbered from 1 in their split, and each split's number of rows, without line."""

    def out(file: str, split: int, places: list[int], lines: list[str | None]) -> pa.RecordBatch:
        n = len(places)
        return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([split] * n, pa.int64()), pa.array(places, pa.int64()),
            pa.array(lines, pa.string())], ["file", "split", "place", "line"])

    here, n = None, 0
    for b in batches:
        codes = [b.column(c).dictionary_encode().indices.to_numpy() for c in ("file", "split")]
        begins = [0, *(np.flatnonzero((codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])) + 1)] if len(b) else []
        for i, j in zip(begins, [*begins[1:], len(b)], strict=False):
            now = (b.column("file")[i].as_py(), b.column("split")[i].as_py())
            if now != here:
                if here:
                    yield out(*here, [n], [None])
                here, n = now, 0
            lines = b.column("line").slice(i, j - i)
            at = np.flatnonzero(lines.is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                yield out(*here, (at + n + 1).tolist(), lines.take(pa.array(at)).to_pylist())
            n += j - i
    if here:
        yield out(*here, [n], [None])


def read_articles_tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(articles, bad lines): the bad ones as (file, line_no from 1, line); blank ones are neither, but count.

    Lines are numbered where they are read, split by split; what the splits before hold is added from their counts, one
    row a split. Only bad lines are written or moved, so a corpus in one file is read by as many tasks as it has splits.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))
    parsed = lines.withColumn("article", F.from_json("line", _with_corrupt(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    there = F.trim("line") != ""
    marked = parsed.select("file", "split", F.when(there & F.col("article._bad").isNotNull(), F.col("line")).alias("line"))
    placed = stage(marked.mapInArrow(place_in_split, "file string, split long, place long, line string"), "bad_lines")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.where(F.col("line").isNull()).select("file", "split", F.coalesce(F.sum("place").over(earlier), F.lit(0)).alias("_before"))
    bad = placed.where(F.col("line").isNotNull()).join(before, ["file", "split"]).select("file", (F.col("_before") + F.col("place")).alias("line_no"), "line")
    return parsed.where(there & F.col("article._bad").isNull()).select("article.*").drop("_bad"), bad


def _with_corrupt() -> T.StructType:
    return T._parse_datatype_string(f"{ARTICLE}, _bad string")


def read_ontology_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per stanza of ontology files: (ord, stanza), ord from 0 by file name and place. The record separator is the line that opens a stanza."""
    raw = numbered(spark.read.option("lineSep", "\n[").text(path))
    return raw.select(F.col("doc_ord").alias("ord"), F.col("value").alias("stanza"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWER).json(path)


def nest_predictions(articles: DataFrame, mentions: DataFrame, associations: DataFrame) -> DataFrame:
    """(pmc_id, pmid, entities, association): mentions by ent_idx and patients in roster order, back into one row per article."""
    fields = ["identifier", "type", "offset", "length", "text", "note", "retrieved_name", "retrieved_score"]
    full = mentions.select("pmc_id", "ent_idx",
        *(F.col(f) if f in mentions.columns else F.lit("Phenotype" if f == "type" else None).cast("double" if f == "retrieved_score"
        else "string").alias(f) for f in fields))
    entities = full.groupBy("pmc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ent_idx", *fields))),
        lambda e: F.struct(*(e[f].alias(f) for f in fields))).alias("entities"))
    by_patient = associations.groupBy("pmc_id", "roster_idx", "patient_id").agg(F.sort_array(F.collect_set("identifier")).alias("phenotype"))
    roster = by_patient.groupBy("pmc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("roster_idx", "patient_id", "phenotype"))),
        lambda p: F.struct(p["patient_id"].alias("patient_id"), p["phenotype"].alias("phenotype"))).alias("association"))
    out = articles.select("pmc_id", "pmid").join(entities, "pmc_id", "left").join(roster, "pmc_id", "left")
    return out.select("pmc_id", "pmid", F.coalesce("entities", F.array().cast(f"array<{ENTITY}>")).alias("entities"),
        F.coalesce("association", F.array().cast(f"array<{ASSOCIATION}>")).alias("association"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """JSON lines in UTF-8; null fields are written."""
    predictions.write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def write_gate_dataset(samples: DataFrame, path: str) -> None:
    """A flat row per sample, nulls kept."""
    samples.write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def write_concept_index(concepts: DataFrame, path: str, model: str, pooling: str) -> None:
    """``concepts`` (row_idx, hpo_id, name, embedding) with its manifest."""
    concepts.write.mode("overwrite").parquet(f"{path}/vectors")
    made = concepts.agg(F.lit(model).alias("model"), F.lit(pooling).alias("pooling"), F.max(F.size("embedding")).alias("dim"),
        F.count("*").alias("num_entries"), F.countDistinct("hpo_id").alias("num_concepts"))
    made.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_concept_index(spark: SparkSession, path: str) -> DataFrame:
    """The vectors of an index; it is an error if they and the manifest disagree."""
    concepts = spark.read.parquet(f"{path}/vectors")
    stated = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    n = concepts.agg(F.count("*").alias("n"), F.countDistinct("row_idx").alias("r")).first()
    if stated is None or stated["num_entries"] != n["n"] or n["n"] != n["r"]:
        raise ValueError(f"the index has {n['n']} vectors; its manifest says {stated and stated['num_entries']}")
    return concepts
