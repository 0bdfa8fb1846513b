"""Patients: anchors, nearest routing, model answers, gates, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import with_context
from ..functions.text import collapse, split_ids
from . import evaluate as E
from .evaluate import on_side, token_sides

#: Fixed value: a line of an answer, the mention's number, a sign, the patient's id.
ANSWER_LINE = r"^\s*[#\-*]?\s*(\d+)\s*[:.)]\s*([A-Za-z0-9_.:\-]+)"
#: Before all offsets.
LEAST = -(1 << 31)
MODES = ("assigned", "intersect", "filter", "whole")


def patient_anchors(patients: DataFrame) -> DataFrame:
    """(pmc_id, roster_idx, patient_id, anchor): every offset of a patient's mentions; a patient without one has a null anchor."""
    each = patients.select("pmc_id", "roster_idx", "patient_id",
        F.explode_outer(F.filter(F.transform("mentions", lambda m: m["offset"]), lambda x: x.isNotNull())).alias("anchor"))
    return each.distinct()


def nearest(mentions: DataFrame, patients: DataFrame, max_dist: int | None = None) -> DataFrame:
    """``mentions`` (pmc_id, offset, ...) with roster_idx, dist and patient_id of the nearest patient.

    Anchors and mentions of an article are merged by offset, and each mention looks at the last anchor before and, in the
    other direction, at the first after it, so the work is linear in both; ties go to the earlier patient. Further than ``max_dist`` is
    unassigned (null); without any anchor it is the first patient where no distance is set, else unassigned.
    Mentions go through one exchange, by article, with their columns; those that aren't needed are best left out.
    """
    own = [c for c in mentions.columns if c != "pmc_id"]
    kinds = dict(mentions.dtypes)
    kind = f"struct<{','.join(f'`{c}`:{kinds[c]}' for c in own)}>"
    people = patients.where(F.col("pmc_id").isNotNull())
    each = people.select("pmc_id", F.explode("mentions").alias("_p"), "roster_idx", "patient_id").where(F.col("_p.offset").isNotNull())
    none = lambda t: F.lit(None).cast(t)
    anchor = "struct<anchor:int,who:int,name:string>"
    points = each.select("pmc_id", F.col("_p.offset").alias("at"), F.lit(1).alias("kind"), F.col("roster_idx").alias("who"),
        F.struct(F.col("_p.offset").alias("anchor"), F.col("roster_idx").alias("who"), F.col("patient_id").alias("name")).alias("a"), none("string").alias("first"), none(kind).alias("m"))
    firsts = people.where(F.col("roster_idx") == 0).select("pmc_id", F.lit(-1).alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("who"), none(anchor).alias("a"),
        F.col("patient_id").alias("first"), none(kind).alias("m"))
    asked = mentions.select("pmc_id", F.col("offset").alias("at"), F.lit(2).alias("kind"), none("int").alias("who"), none(anchor).alias("a"), none("string").alias("first"),
        F.struct(*own).alias("m"))
    # of anchors at one place the earliest patient's comes last
    window = lambda at: Window.partitionBy("pmc_id").orderBy(at, "kind", F.desc("who")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left, right = window("at"), window(F.desc("at"))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    sides = points.unionByName(firsts).unionByName(asked).select("pmc_id", "at", "kind", "m", last("a", left).alias("l"), last("a", right).alias("r"),
        F.coalesce(last("first", left), last("first", right)).alias("first")).where(F.col("kind") == 2)
    options = F.filter(F.array("l", "r"), lambda x: x.isNotNull())
    best = F.array_min(F.transform(options, lambda x: F.struct(F.abs(F.col("at") - x["anchor"]).alias("dist"), x["who"].alias("who"), x["name"].alias("name"))))
    found = sides.withColumn("b", best)
    if max_dist is None:
        there = F.col("b.who").isNotNull()
        who, name = F.coalesce("b.who", F.lit(0)), F.when(there, F.col("b.name")).otherwise(F.col("first"))
    else:
        who, name = (F.when(F.col("b.dist") <= max_dist, F.col(c)) for c in ("b.who", "b.name"))
    return found.select("pmc_id", *(F.col("m")[c].alias(c) for c in own), who.alias("roster_idx"), F.col("b.dist").alias("dist"), name.alias("patient_id"))


def territories(patients: DataFrame) -> DataFrame:
    """(pmc_id, at, kind, patient_id): from ``at`` to the next row's, a mention without a largest distance is nearest to this patient, as ``nearest`` has it.

    Between two anchors the border is half-way, and half-way itself is the earlier patient's. An article without
    anchors is the first patient's, whose row (kind -1) comes before all others (kind 0).
    """
    people = patients.where(F.col("pmc_id").isNotNull()).repartition("pmc_id")
    each = people.select("pmc_id", "roster_idx", "patient_id", F.explode("mentions.offset").alias("a")).where(F.col("a").isNotNull())
    anchors = each.groupBy("pmc_id", "a").agg(F.min(F.struct("roster_idx", "patient_id")).alias("w"))
    order = Window.partitionBy("pmc_id").orderBy("a")
    middle = F.col("a").cast("long") + F.lag("a").over(order)
    even = (middle.bitwiseAND(F.lit(1)) == 0) & (F.col("w.roster_idx") < F.lag("w.roster_idx").over(order))
    at = F.coalesce((F.call_function("shiftright", middle, F.lit(1)) + F.when(even, 0).otherwise(1)).cast("int"), F.lit(LEAST))
    cells = anchors.select("pmc_id", at.alias("at"), F.lit(0).alias("kind"), F.col("w.patient_id").alias("patient_id"))
    return cells.unionByName(people.where(F.col("roster_idx") == 0).select("pmc_id", F.lit(LEAST).alias("at"), F.lit(-1).alias("kind"), "patient_id"))


def levelled_tokens(mentions: DataFrame, patients: DataFrame, gold: DataFrame) -> DataFrame:
    """What ``levelled`` gives of gold's tokens and the nearest patients' of ``mentions`` (pmc_id, offset, token, level).

    Mentions, patients' territories and gold meet in one exchange, by article; a mention looks back for its territory alone.
    """
    none = lambda t: F.lit(None).cast(t)
    asked = mentions.select("pmc_id", F.coalesce("offset", F.lit(LEAST)).alias("at"), F.lit(1).alias("kind"), none("string").alias("patient_id"), "token", F.lit(0).alias("g"), "level")
    known = E.gold_tokens(gold).select("pmc_id", F.lit(LEAST).alias("at"), F.lit(2).alias("kind"), "patient_id", "token", F.lit(1).alias("g"), F.lit(0).alias("level"))
    borders = territories(patients).select("pmc_id", "at", "kind", "patient_id", none("string").alias("token"), F.lit(0).alias("g"), F.lit(0).alias("level"))
    order = Window.partitionBy("pmc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    holder = F.last(F.when(F.col("kind") < 1, F.struct("patient_id")), ignorenulls=True).over(order)
    rows = borders.unionByName(asked).unionByName(known).withColumn("holder", holder).where(F.col("kind") > 0)
    own = rows.withColumn("patient_id", F.when(F.col("kind") == 1, F.col("holder.patient_id")).otherwise(F.col("patient_id")))
    return own.where((F.col("kind") == 2) | F.col("patient_id").isNotNull()).groupBy("pmc_id", "patient_id", "token").agg(F.max("g").alias("g"), F.max("level").alias("level"))


def with_roster(patients: DataFrame, assigned: DataFrame) -> DataFrame:
    """(pmc_id, roster_idx, patient_id, identifier): distinct identifiers by patient; a patient without any has one null row."""
    given = assigned.where(F.col("patient_id").isNotNull() & F.col("identifier").isNotNull()).select("pmc_id", "patient_id", "identifier").distinct()
    return patients.select("pmc_id", "roster_idx", "patient_id").join(given, ["pmc_id", "patient_id"], "left").select("pmc_id", "roster_idx",
        "patient_id", "identifier")


def associate_nearest(mentions: DataFrame, patients: DataFrame, max_dist: int | None = None) -> DataFrame:
    return with_roster(patients, nearest(mentions.select("pmc_id", "offset", "identifier"), patients, max_dist))


def patient_roster(patients: DataFrame) -> DataFrame:
    """(pmc_id, roster_idx, patient_id, label, refs): the longest mention's text (the first of ties, else empty) and all (text, offset), -1 without one."""
    refs = F.transform("mentions", lambda m: F.struct(F.coalesce(m["text"], F.lit("")).alias("text"), F.coalesce(m["offset"], F.lit(-1)).alias("offset")))
    longest = F.aggregate(refs, F.lit(""), lambda a, r: F.when(F.length(r["text"]) > F.length(a), r["text"]).otherwise(a))
    return patients.select("pmc_id", "roster_idx", "patient_id", F.coalesce(longest, F.lit("")).alias("label"),
        F.coalesce(refs, F.array().cast("array<struct<text:string,offset:int>>")).alias("refs"))


def section_lookup(mentions: DataFrame, segments: DataFrame) -> DataFrame:
    """``mentions`` with ``section``: the label of the first segment, by start, that holds the offset; ``?`` where none does.

    A segment that ends no later than one before it is never the first that holds an offset. The others' ends ascend
    with their starts, so merged by offset, from the last, each mention needs the segment of the next end alone.
    """
    label = F.coalesce("section_type", *(["type"] if "type" in segments.columns else []), F.lit("?"))
    parts = segments.select("pmc_id", "seg_idx", F.col("offset").alias("begin"), (F.col("offset") + F.length("text")).alias("at"), label.alias("label"))
    earlier = Window.partitionBy("pmc_id").orderBy("begin", "seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    longest = parts.withColumn("_m", F.max("at").over(earlier)).where((F.col("at") > F.col("begin")) & (F.col("_m").isNull() | (F.col("at") > F.col("_m"))))
    own = [c for c in mentions.columns if c not in ("pmc_id", "section")]
    kinds = dict(mentions.dtypes)
    ends = longest.select("pmc_id", "at", F.lit(1).alias("kind"), F.struct("begin", "label").alias("s"),
        F.lit(None).cast(f"struct<{','.join(f'`{c}`:{kinds[c]}' for c in own)}>").alias("m"))
    asked = mentions.select("pmc_id", F.col("offset").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("struct<begin:int,label:string>").alias("s"),
        F.struct(*own).alias("m"))
    later = Window.partitionBy("pmc_id").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = ends.unionByName(asked).withColumn("next", F.last("s", ignorenulls=True).over(later)).where(F.col("kind") == 0)
    section = F.when(F.col("next.begin") <= F.col("at"), F.col("next.label"))
    return met.select("pmc_id", *(F.col("m")[c].alias(c) for c in own), F.coalesce(section, F.lit("?")).alias("section"))


def _numbered(mentions: DataFrame, line: Column) -> DataFrame:
    return mentions.groupBy("pmc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ent_idx", line.alias("line")))),
        lambda x: x["line"]), "\n").alias("listed"))


#: The fixed parts of the prompts; callers may pass their own.
HEAD = "Below are the individuals of an article and the numbered phenotype mentions in it."
TAIL = "Answer with one line per mention, <number>: <individual ID or NONE>, and nothing else."


def prompt_window(mentions: DataFrame, patients: DataFrame, texts: DataFrame, width: int = 120, most: int = 120, head: str = HEAD,
    tail: str = TAIL) -> DataFrame:
    """(pmc_id, prompt): the roster (labels up to ``most`` characters) and the numbered mentions, each with section and context.

    ``mentions`` carry ``section``; articles without patients or mentions have no prompt.
    """
    line = F.concat(F.lit("  "), "patient_id", F.lit(' = "'), F.substring(collapse(F.col("label")), 1, most), F.lit('"'))
    roster = _roster_lines(patients, line)
    listed = _numbered(with_context(mentions, texts, width, "_c"), F.concat(F.format_string('  %d. [%s] "', F.col("ent_idx") + 1, F.col("section")), collapse(F.col("text")),
        F.lit('" | context: ...'), "_c", F.lit("...")))
    return roster.join(listed, "pmc_id").select("pmc_id",
        F.concat_ws("\n", F.lit(head), F.lit("Individuals:"), "roster", F.lit("Phenotype mentions:"), "listed", F.lit(tail)).alias("prompt"))


def prompt_whole(mentions: DataFrame, patients: DataFrame, texts: DataFrame, width: int = 120, most: int = 80, refs: int = 6, head: str = HEAD,
    tail: str = TAIL) -> DataFrame:
    """(pmc_id, prompt): the article's text, the roster with its first ``refs`` references (empty ones dropped), and the numbered mentions with place and context."""
    quoted = F.transform(F.filter(F.transform(F.slice("refs", 1, refs), lambda r: F.struct(collapse(r["text"]).alias("t"), r["offset"].alias("o"))),
        lambda r: r["t"] != ""), lambda r: F.concat(F.lit('"'), r["t"], F.lit('"@'), r["o"].cast("string")))
    line = F.concat(F.lit("  "), "patient_id", F.lit('  (e.g. "'), F.substring(collapse(F.col("label")), 1, most), F.lit('")  refs: '),
        F.array_join(quoted, "; "))
    listed = _numbered(with_context(mentions, texts, width, "_c"), F.concat(F.format_string('  %d. "', F.col("ent_idx") + 1), collapse(F.col("text")),
        F.format_string('" @char%d | context: ...', "offset"), "_c", F.lit("...")))
    return _roster_lines(patients, line).join(listed, "pmc_id").join(texts.select("pmc_id", "text"), "pmc_id").select("pmc_id",
        F.concat_ws("\n", F.lit(head), "text", F.lit("Individuals:"), "roster", F.lit("Phenotype mentions:"), "listed", F.lit(tail)).alias("prompt"))


def _roster_lines(patients: DataFrame, line: Column) -> DataFrame:
    lines = patient_roster(patients).withColumn("line", line)
    return lines.groupBy("pmc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("roster_idx", "line"))), lambda p: p["line"]),
        "\n").alias("roster"))


def strip_reasoning(response: Column) -> Column:
    """What follows the first closing mark of reasoning; all of it where there is none."""
    mark = "</think>"
    return F.when(F.instr(response, mark) > 0, F.substring(response, F.instr(response, mark) + len(mark), F.length(response))).otherwise(response)


def answer_lines(answers: DataFrame) -> DataFrame:
    """(pmc_id, line_no, number, target): the lines of (pmc_id, response) that have a number and a name."""
    lines = answers.select("pmc_id", F.posexplode(F.split(strip_reasoning(F.col("response")), r"\r?\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(ANSWER_LINE)).select("pmc_id", "line_no",
        F.try_to_number(F.regexp_extract("line", ANSWER_LINE, 1), F.lit("999999999")).cast("int").alias("number"),
        F.regexp_extract("line", ANSWER_LINE, 2).alias("target"))


def parse_answers(answers: DataFrame, mentions: DataFrame, patients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((pmc_id, ent_idx, patient_id), (pmc_id, n_parsed lines)): each mention's patient by the last line that names one of the roster.

    Numbers count from 1; those out of range are ignored, names that are no patient's assign nothing but count as parsed.
    """
    none = lambda t: F.lit(None).cast(t)
    lines = answer_lines(answers).select("pmc_id", (F.col("number") - 1).alias("ent_idx"), "line_no", "target", F.lit(0).alias("kind"))
    asked = mentions.select("pmc_id", "ent_idx", none("int").alias("line_no"), none("string").alias("target"), F.lit(1).alias("kind"))
    people = patients.select("pmc_id", none("int").alias("ent_idx"), none("int").alias("line_no"), F.col("patient_id").alias("target"), F.lit(2).alias("kind"))
    # answers hold many lines in few bytes, so these are dealt before anything is sorted
    dealt = lines.unionByName(asked).unionByName(people).where(F.col("pmc_id").isNotNull()).repartition("pmc_id")
    named = dealt.withColumn("known", F.max(F.col("kind") == 2).over(Window.partitionBy("pmc_id", "target"))).where((F.col("kind") < 2) & F.col("ent_idx").isNotNull())
    line = F.col("kind") == 0
    met = named.groupBy("pmc_id", "ent_idx").agg(F.max(F.col("kind") == 1).alias("there"), F.sum(F.when(line, 1).otherwise(0)).alias("n"),
        F.max(F.when(line & F.col("known"), F.struct("line_no", "target"))).alias("last")).where("there")
    counted = met.where(F.col("n") > 0).groupBy("pmc_id").agg(F.sum("n").alias("n_parsed"))
    return met.where(F.col("last").isNotNull()).select("pmc_id", "ent_idx", F.col("last.target").alias("patient_id")), counted


def assoc_assigned(mentions: DataFrame, given: DataFrame, patients: DataFrame) -> DataFrame:
    """The roster with the identifiers of the mentions given to each patient, one a mention; unanswered ones go to none."""
    none = F.lit(None).cast("string")
    asked = mentions.select("pmc_id", "ent_idx", "identifier", none.alias("patient_id"), F.lit(True).alias("asked"))
    rows = asked.unionByName(given.select("pmc_id", "ent_idx", none.alias("identifier"), "patient_id", F.lit(False).alias("asked")))
    # dealt by article, so that identifiers are made distinct without another exchange
    dealt = rows.where(F.col("pmc_id").isNotNull() & F.col("ent_idx").isNotNull()).repartition("pmc_id")
    return with_roster(patients, dealt.withColumn("patient_id", F.max("patient_id").over(Window.partitionBy("pmc_id", "ent_idx"))).where("asked"))


def gate_intersect_patient(near: DataFrame, given: DataFrame, patients: DataFrame) -> DataFrame:
    """Per patient, the identifiers that both associations (pmc_id, patient_id, identifier) give to that patient."""
    both = near.join(given.where(F.col("identifier").isNotNull()).select("pmc_id", "patient_id", "identifier").distinct(),
        ["pmc_id", "patient_id", "identifier"], "left_semi")
    return with_roster(patients, both)


def gate_filter_route(mentions: DataFrame, given: DataFrame, patients: DataFrame, max_dist: int | None = None) -> DataFrame:
    """Mentions that were given to anyone, routed to the nearest patient."""
    return associate_nearest(mentions.join(given.where(F.col("patient_id").isNotNull()).select("pmc_id", "ent_idx"), ["pmc_id", "ent_idx"],
        "left_semi"), patients, max_dist)


def tokens_of(association: DataFrame) -> DataFrame:
    """Associations by token: (pmc_id, patient_id, token), distinct, compounds split; patients without any are not here."""
    return association.select("pmc_id", "patient_id", F.explode(split_ids(F.col("identifier"))).alias("token")).distinct()


def gate_intersect_article(near: DataFrame, given: DataFrame, answered: DataFrame, patients: DataFrame) -> DataFrame:
    """(pmc_id, roster_idx, patient_id, identifier): tokens of ``near`` that ``given`` has for anyone of the article.

    Articles that ``answered`` (pmc_id) lacks keep all their tokens.
    """
    tokens = tokens_of(near)
    kept = tokens.join(tokens_of(given).select("pmc_id", "token").distinct(), ["pmc_id", "token"], "left_semi").select("pmc_id", "patient_id", "token")
    uncovered = tokens.join(answered.select("pmc_id").distinct(), "pmc_id", "left_anti").select("pmc_id", "patient_id", "token")
    return with_roster(patients, kept.unionByName(uncovered).distinct().withColumnRenamed("token", "identifier"))


def associate_with_fallback(mentions: DataFrame, patients: DataFrame, answers: DataFrame, mode: str = "assigned", max_dist: int | None = None) -> DataFrame:
    """(pmc_id, roster_idx, patient_id, identifier, how): the chosen mode where an answer could be read, else nearest routing.

    Articles without a roster have no rows; without mentions their patients have none. ``max_dist`` goes with mode filter.
    """
    if mode not in MODES or (max_dist is not None and mode != "filter"):
        raise ValueError(f"mode {mode} with max_dist {max_dist}")
    given, counted = parse_answers(answers, mentions, patients)
    read = counted.where(F.col("n_parsed") > 0).select("pmc_id")
    near = associate_nearest(mentions, patients)
    if mode == "intersect":
        chosen = gate_intersect_patient(near, assoc_assigned(mentions, given, patients), patients)
    elif mode == "filter":
        chosen = gate_filter_route(mentions, given, patients, max_dist)
    else:
        chosen = assoc_assigned(mentions, given, patients)
    return chosen.join(read, "pmc_id", "left_semi").withColumn("how",
        F.lit(mode)).unionByName(near.join(read, "pmc_id", "left_anti").withColumn("how", F.lit("nearest")))


#: An answer's budget of new tokens, by mention and besides.
BUDGET = (12, 128)


def decision_stats(mentions: DataFrame, patients: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: articles answered and fallen back, truncated, short; mentions assigned, none, and the share of none.

    An answer is truncated where it used up its BUDGET (n_new_tokens, where it is known).
    """
    given, counted = parse_answers(answers, mentions, patients)
    asked = mentions.join(patients.select("pmc_id").distinct(), "pmc_id", "left_semi").groupBy("pmc_id").agg(F.count("*").alias("n"))
    done = asked.join(answers.select("pmc_id",
        *(["n_new_tokens"] if "n_new_tokens" in answers.columns else [F.lit(None).cast("int").alias("n_new_tokens")])), "pmc_id",
        "left").join(counted, "pmc_id", "left")
    done = done.join(given.groupBy("pmc_id").agg(F.count("*").alias("got")), "pmc_id", "left").fillna(0, ["n_parsed", "got"])
    ok = F.col("n_parsed") > 0
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    total = lambda c: F.coalesce(F.sum(F.when(ok, c).otherwise(0)), F.lit(0))
    row = done.agg(one(ok).alias("answered"), one(~ok).alias("fallback"),
        one(ok & (F.col("n_new_tokens") >= BUDGET[0] * F.col("n") + BUDGET[1])).alias("truncated"),
        one(ok & (F.col("n_parsed") < F.col("n"))).alias("shortfall"), total(F.col("got")).alias("assigned"), total(F.col("n") - F.col("got")).alias("none"))
    return row.withColumn("none_pct", F.round(F.when(F.col("assigned") + F.col("none") > 0,
        100.0 * F.col("none") / (F.col("assigned") + F.col("none"))).otherwise(0.0), 4))


def gate_retention(near: DataFrame, gated: DataFrame, answered: DataFrame) -> DataFrame:
    """One row: tokens before and after the gate, the share dropped, articles joined and not covered."""
    before, after = tokens_of(near), tokens_of(gated)
    articles = near.select("pmc_id").distinct().join(answered.select("pmc_id").distinct().withColumn("hit", F.lit(1)), "pmc_id",
        "left").agg(F.count("hit").alias("joined"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("not_covered"))
    sums = before.agg(F.count("*").alias("before")).withColumn("k", F.lit(1)).join(after.agg(F.count("*").alias("after")).withColumn("k", F.lit(1)),
        "k").join(articles.withColumn("k", F.lit(1)), "k")
    return sums.select("before", "after", F.round(F.when(F.col("before") > 0,
        100.0 * (F.col("before") - F.col("after")) / F.col("before")).otherwise(0.0), 4).alias("dropped_pct"), "joined", "not_covered")


def fuse(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """(pmc_id, patient_id, token): the articles of ``a``, the patients of both, tokens in both (intersect) or in any (union).

    A patient without tokens has one row with null.
    """
    if how not in ("intersect", "union"):
        raise ValueError(how)
    articles = a.select("pmc_id").distinct()
    b = b.join(articles, "pmc_id", "left_semi")
    people = a.select("pmc_id", "patient_id").union(b.select("pmc_id", "patient_id")).distinct()
    ta, tb = tokens_of(a), tokens_of(b)
    tokens = ta.join(tb, ["pmc_id", "patient_id", "token"], "left_semi") if how == "intersect" else ta.union(tb).distinct()
    return people.join(tokens, ["pmc_id", "patient_id"], "left").select("pmc_id", "patient_id", "token")


def fusion_compare(gold: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(variant, f1_micro, f1_macro): score_micro and score_macro of both associations and of what ``fuse`` makes of them.

    Which of the four has a token follows from whether both have it and whether ``a`` has the article: all meet in one
    exchange, and nothing is repeated by variant before the sums, which are four rows.
    """
    named = F.col("pmc_id").isNotNull() & F.col("patient_id").isNotNull()
    sides = token_sides(gold, a, b).withColumn("inside", F.max(on_side(1)).over(Window.partitionBy("pmc_id")) & named)
    there, g, x, y = F.col("token").isNotNull(), on_side(0), on_side(1), on_side(2)
    variants = {"A": x, "B": y, "intersect": F.col("inside") & x & y, "union": F.col("inside") & (x | y)}
    n = lambda c: F.sum(F.when(there & c, 1).otherwise(0))
    counts = sides.groupBy("pmc_id", "patient_id").agg(F.max(~there & g).alias("known"), n(g).alias("g"),
        F.array(*(F.struct(F.lit(v).alias("variant"), n(c).alias("n"), n(c & g).alias("tp")) for v, c in variants.items())).alias("v"))
    each = counts.select("known", "g", named.alias("named"), F.inline("v"))
    f1_of = lambda n, g: E.f1(F.col("tp"), n - F.col("tp"), g - F.col("tp"))
    own = F.when(~F.col("named") | (F.col("n") + F.col("g") == 0), 1.0).otherwise(f1_of(F.col("n"), F.col("g")))
    sums = each.groupBy("variant").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("tp").alias("tp"), F.avg(F.when(F.col("known"), own)).alias("f1_macro"))
    return sums.where((F.col("n") + F.col("g") > 0) & F.col("f1_macro").isNotNull()).select("variant", f1_of(F.col("n"), F.col("g")).alias("f1_micro"), "f1_macro")


def check_mentions_aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (misaligned): the articles of ``a`` whose sets of (offset, length, identifier) are others in ``b``."""
    keys = ["pmc_id", "offset", "length", "identifier"]
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct().join(a.select("pmc_id").distinct(), "pmc_id", "left_semi")
    odd = x.exceptAll(y).select("pmc_id").union(y.exceptAll(x).select("pmc_id")).distinct()
    return odd.agg(F.count("*").alias("misaligned"))
