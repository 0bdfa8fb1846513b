"""Recognition over a stream of articles.

Tokens, dictionary mentions and routing need one article at a time, so each micro-batch runs the batch operators and
appends its predictions; a batch that is run again writes the same folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rebuild import rebuild_texts
from ..operators.associate import associate_nearest
from ..operators.recognize import dictionary_match, tokenize
from ..sources.articles import ARTICLE, nest_predictions, write_predictions


def stream_articles(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ARTICLE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def recognise(articles: DataFrame, phrases: DataFrame) -> DataFrame:
    """Predictions (pmc_id, pmid, entities, association) of a batch of articles by dictionary and nearest routing."""
    texts = rebuild_texts(articles)
    order = Window.partitionBy("pmc_id").orderBy("offset")
    mentions = dictionary_match(texts, tokenize(texts), phrases).withColumn("ent_idx", F.row_number().over(order) - 1)
    none = F.array().cast("array<struct<offset:int,length:int,text:string>>")
    patients = articles.select("pmc_id", F.posexplode("patient").alias("roster_idx", "p")).select("pmc_id", "roster_idx",
        F.col("p.patient_id").alias("patient_id"), F.coalesce("p.mention", none).alias("mentions"))
    return nest_predictions(articles, mentions, associate_nearest(mentions, patients))


def recognise_stream(articles: DataFrame, phrases: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the predictions of each micro-batch to ``out``/batch=<id>, for what there is now."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write_predictions(recognise(batch, phrases), f"{out}/batch={batch_id}")

    return articles.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
