"""Bounded samples of labelled rows, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes lie under this number.
SCALE = 1 << 62
#: Standard error of the distinct counts that thresholds stand on.
ERROR = 0.02


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A hash of the row's id, or of its text where it has none: rows of one id are one, as are rows without id that have one text."""
    return F.pmod(F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(F.lit("no id"), text)), F.lit(SCALE))


def threshold_of(rows: int, keys: int) -> int:
    """The hash under which at least ``rows`` of so many distinct keys lie, but for one case in thousands; SCALE takes all."""
    wanted = rows * (1 + 4 * ERROR) + 4 * rows**0.5 + 8
    return SCALE if wanted >= keys else max(int(SCALE * (wanted / keys)), 1)


def counted_keys(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """(*by, n_keys): about how many distinct keys; sketches, so one small row a group and task is shuffled."""
    return rows.groupBy(*by).agg(F.approx_count_distinct(key, ERROR).alias("n_keys"))


def least_of_key(keys: list, ties: list[int], least: dict) -> list[int]:
    """The rows whose tie is under all that their key had before; ``least`` is kept up to date.

    Of a key's rows, which may be many, a task passes on few, and the one with the least tie wins in every division into tasks.
    """
    out = []
    for i, (k, t) in enumerate(zip(keys, ties, strict=True)):
        if k not in least or t < least[k]:
            least[k] = t
            out.append(i)
    return out


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of the rows of ``docs`` whose id is among at least ``max_rows``, or all, that a hash draws of those with a label.

    ``labels`` (doc_id, label) may hold an id more than once: the greatest label counts. Ids are drawn before any text is
    read, so only ids are shuffled; those drawn are about max_rows, whatever the tables' sizes, and are broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).join(docs.select("doc_id"), "doc_id", "left_semi")
    key = F.pmod(F.xxhash64("doc_id"), F.lit(SCALE))
    n_keys = counted_keys(known.select(key.alias("key")), "key").first()["n_keys"]
    drawn = known.where(key < F.lit(threshold_of(max_rows, n_keys))).groupBy("doc_id").agg(F.max(label).alias(label))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
