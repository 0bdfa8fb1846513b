"""Ontology tables: terms, edges, closure, depth, aliases, phrases, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, normalise_phrase
from ..session import maybe_broadcast, stage, unstage

#: Fixed value: the root of the subtree of phenotypes.
ROOT = "HP:0000118"


def stanza_terms(stanzas: DataFrame) -> DataFrame:
    """(ord, id, name, syns, obsolete, replaced_by, alt_ids, parents) of the term stanzas of (ord, stanza)."""
    lines = stanzas.select("ord", F.split(F.regexp_replace("stanza", "\r", ""), "\n").alias("l")).where(F.regexp_replace(F.col("l")[0], r"^\[", "") == "Term]")
    values = lambda tag: F.transform(F.filter("l", lambda x: x.startswith(tag + ":")),
        lambda x: F.trim(F.substring(x, F.lit(len(tag) + 2), F.length(x))))
    first = lambda tag: F.try_element_at(values(tag), F.lit(1))
    out = lines.select(
        "ord", first("id").alias("id"), first("name").alias("name"),
        F.filter(F.transform(values("synonym"), lambda x: F.regexp_extract(x, r'"(.*?)"', 1)), lambda x: x != "").alias("syns"),
        F.exists(values("is_obsolete"), lambda x: F.lower(x) == "true").alias("obsolete"), first("replaced_by").alias("replaced_by"),
            values("alt_id").alias("alt_ids"),
        F.transform(values("is_a"), lambda x: F.trim(F.substring_index(x, "!", 1))).alias("parents"))
    return out.where(F.col("id").isNotNull() & (F.col("id") != ""))


def ontology_terms(parsed: DataFrame) -> DataFrame:
    """One row per id, the first stanza's; the edges of all its stanzas count (see ontology_edges)."""
    first = Window.partitionBy("id").orderBy("ord")
    return parsed.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).drop("_r", "parents")


def ontology_edges(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("id").alias("child"), F.explode("parents").alias("parent")).distinct()


def ontology_depth(edges: DataFrame, root: str = ROOT, most_levels: int = 200) -> DataFrame:
    """(id, depth): the shortest distance from the root, which has 0; ids outside its subtree are absent.

    Level by level: the children of the last level that were not met before. Each level is written, and the levels so far
    are put into one table every eighth time, so plans stay short and read few tables. See ontology_reach for all roots at once.
    """
    spark = edges.sparkSession
    size = edges.count()
    frontier = seen = spark.createDataFrame([(root, 0)], "id string, depth int")
    apart: list[DataFrame] = []
    for level in range(1, most_levels + 1):
        step = edges.join(maybe_broadcast(frontier.select(F.col("id").alias("parent")), size, 64), "parent").select(F.col("child").alias("id")).distinct()
        frontier = stage(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)), "level")
        if frontier.isEmpty():
            unstage(frontier)
            return seen
        apart.append(frontier)
        seen = seen.unionByName(frontier)
        if len(apart) == 8:
            seen = stage(seen, "levels")
            unstage(*apart[:-1])  # the last one is the frontier still
            apart = [seen, frontier]
    raise RuntimeError("the ontology is deeper than most_levels")


def ontology_reach(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(ancestor, id, depth, cycle): every id below every other, with the shortest distance, and each id below itself at distance 0.

    ``cycle`` is true for an id that its own descendants lead back to. Known distances are doubled: a round joins the
    pairs so far with each other, so paths of up to 2^k steps are known after k rounds, whatever the number of roots.
    """
    real = edges.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).select("child", "parent").distinct()
    pairs = stage(real.select(F.col("parent").alias("ancestor"), F.col("child").alias("id"), F.lit(1).alias("depth")), "reach")
    known = None
    for _ in range(most_rounds):
        now = tuple(pairs.agg(F.count("*"), F.sum("depth")).first())
        if now == known:
            ids = real.select(F.col("child").alias("id")).union(real.select("parent")).distinct()
            loops = pairs.where(F.col("ancestor") == F.col("id")).select("id", F.lit(True).alias("cycle"))
            own = ids.join(loops, "id", "left").select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("depth"), F.coalesce("cycle", F.lit(False)).alias("cycle"))
            return pairs.where(F.col("ancestor") != F.col("id")).select("ancestor", "id", "depth", F.lit(False).alias("cycle")).unionByName(own)
        known = now
        on = pairs.select(F.col("ancestor").alias("_middle"), F.col("id").alias("_below"), F.col("depth").alias("_more"))
        longer = pairs.join(on, F.col("id") == F.col("_middle")).select("ancestor", F.col("_below").alias("id"), (F.col("depth") + F.col("_more")).alias("depth"))
        wider = stage(pairs.unionByName(longer).groupBy("ancestor", "id").agg(F.min("depth").alias("depth")), "reach")
        unstage(pairs)
        pairs = wider
    raise RuntimeError("paths are longer than 2 ** most_rounds")


def ontology_descendants(edges: DataFrame, root: str = ROOT) -> DataFrame:
    """(id) of the root and all below it."""
    return ontology_depth(edges, root).select("id")


def ontology_alias_map(terms: DataFrame) -> DataFrame:
    """(alias, id): alternative ids, and obsolete ids with a replacement, one hop; the last in file order wins."""
    alternative = terms.select(F.explode("alt_ids").alias("alias"), "id", "ord", F.lit(0).alias("kind"))
    replaced = terms.where(F.col("obsolete") & F.col("replaced_by").isNotNull()).select(F.col("id").alias("alias"), F.col("replaced_by").alias("id"),
        "ord", F.lit(1).alias("kind"))
    return alternative.unionByName(replaced).groupBy("alias").agg(F.max_by("id", F.struct("ord", "kind")).alias("id"))


def phrase_dictionary(terms: DataFrame, descendants: DataFrame) -> DataFrame:
    """(phrase, n_tokens, first_token, hpo_id) of the names and synonyms of the subtree's terms that are not obsolete.

    A phrase is dropped under three characters, or under four without a space. Of several ids the smallest wins.
    """
    live = terms.where(~F.col("obsolete")).join(descendants, "id", "left_semi")
    each = live.select("id", F.explode(F.concat(F.array("name"), F.coalesce("syns", F.array().cast("array<string>")))).alias("raw")).select("id",
        normalise_phrase(F.col("raw")).alias("phrase"))
    kept = each.where((F.length("phrase") >= 3) & ((F.instr("phrase", " ") > 0) | (F.length("phrase") >= 4)))
    one = kept.groupBy("phrase").agg(F.min("id").alias("hpo_id"))
    return one.select("phrase", F.size(F.split("phrase", " ")).alias("n_tokens"), F.substring_index("phrase", " ", 1).alias("first_token"), "hpo_id")


def concept_names(terms: DataFrame, descendants: DataFrame) -> DataFrame:
    """(hpo_id, alias_idx, name): white space folded, one row per spelling within a concept without regard to case, first kept.

    Order by hpo_id and alias_idx to number the rows.
    """
    live = terms.where(~F.col("obsolete")).join(descendants, "id", "left_semi")
    each = live.select(F.col("id").alias("hpo_id"),
        F.posexplode(F.concat(F.array("name"), F.coalesce("syns", F.array().cast("array<string>")))).alias("pos", "raw")).select("hpo_id", "pos",
        collapse(F.col("raw")).alias("name")).where(F.col("name") != "")
    same = Window.partitionBy("hpo_id", F.lower("name")).orderBy("pos")
    first = each.withColumn("_r", F.row_number().over(same)).where(F.col("_r") == 1)
    return first.select("hpo_id", (F.row_number().over(Window.partitionBy("hpo_id").orderBy("pos")) - 1).alias("alias_idx"), "name")
