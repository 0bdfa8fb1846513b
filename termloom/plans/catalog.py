"""The registered queries over the derived tables, one for each operator, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import rebuild as W
from ..functions import text as T
from ..operators import associate as A
from ..operators import diagnose as D
from ..operators import evaluate as E
from ..operators import gate as G
from ..operators import ontology as O
from ..operators import prep as P
from ..operators import recognize as R
from ..operators import scan as N
from ..operators import track as K
from ..session import shared_dir
from ..sources import articles as S
from .fixtures import Fixtures, fixtures

#: Thresholds of the scans over similarity and over keep probability.
SIMILARITY = [0.3, 0.4, 0.5]
KEEP = [0.0, 0.25, 0.5, 0.75]
#: Fixed value: characters of context on either side of a mention.
WIDTH = 120


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# sources and sinks: a table goes out and comes back


def _articles(f: Fixtures) -> DataFrame:
    empty = {"pmid": "string", "patient": f"array<{S.PATIENT}>"}
    full = f.nested().withColumns({k: F.lit(None).cast(v) for k, v in empty.items()})
    entity = F.struct("ent_idx", "identifier", F.lit("Phenotype").alias("type"), "offset", "length", "text", "note")
    ents = f.gold().groupBy("pmc_id").agg(F.sort_array(F.collect_list(entity)).alias("e")).select("pmc_id",
        F.expr("transform(e, x -> named_struct('identifier', x.identifier, 'type', x.type, 'offset', x.offset, 'length', x.length, 'text', x.text, 'note', x.note))").alias("entities"))
    return full.join(ents, "pmc_id", "left")


def _path(f: Fixtures, name: str) -> str:
    import uuid

    return f"{shared_dir(f.spark)}/{name}-{uuid.uuid4().hex}"


def read_articles(f: Fixtures) -> DataFrame:
    path = _path(f, "articles")
    S.write_predictions(_articles(f), path)
    back = S.read_articles(f.spark, path)
    return back.select("pmc_id", F.size("full_text").alias("n_segments"), F.coalesce(F.size("entities"), F.lit(0)).alias("n_entities"))


def read_articles_tolerant(f: Fixtures) -> DataFrame:
    """Every article's line is followed by a broken one."""
    path = _path(f, "lines")
    f.articles().select(F.explode(F.array(F.to_json(F.struct("pmc_id")), F.concat(F.lit('{"pmc_id": "'), "pmc_id"))).alias("value")).write.text(path)
    good, bad = S.read_articles_tolerant(f.spark, path)
    return good.select("pmc_id", F.lit("good").alias("state")).unionByName(bad.select(F.regexp_extract("line", "PMC[0-9]+", 0).alias("pmc_id"),
        F.lit("bad").alias("state")))


def _stanzas(f: Fixtures) -> DataFrame:
    t, up = f.terms(), f.edges().groupBy("child").agg(F.sort_array(F.collect_list("parent")).alias("parents"))
    line = lambda tag, c: F.concat(F.lit(tag + ": "), c)
    each = t.join(up, t["id"] == up["child"])
    parts = F.flatten(F.array(F.array(F.lit("Term]"), line("id", F.col("id")), line("name", F.col("name"))),
        F.transform("syns", lambda s: F.concat(F.lit('synonym: "'), s, F.lit('" EXACT []'))),
        F.transform("parents", lambda p: F.concat(F.lit("is_a: "), p, F.lit(" ! label"))), F.transform("alt_ids", lambda a: line("alt_id", a)),
        F.when(F.col("obsolete"), F.array(F.lit("is_obsolete: true"), line("replaced_by", F.col("replaced_by")))).otherwise(F.array().cast("array<string>"))))
    return each.select("ord", F.array_join(parts, "\n").alias("stanza"))


def read_ontology(f: Fixtures) -> DataFrame:
    """The terms written as an ontology file and parsed again: ids, names, counts of synonyms, obsolete."""
    path = _path(f, "ontology")
    _stanzas(f).select(F.concat(F.lit("["), "stanza", F.lit("\n")).alias("value")).write.text(path)
    parsed = O.stanza_terms(S.read_ontology_text(f.spark, path))
    return O.ontology_terms(parsed).select("id", "name", F.size("syns").alias("n_syns"), "obsolete", "replaced_by",
        F.array_join("alt_ids", "|").alias("alt_ids"))


def write_predictions(f: Fixtures) -> DataFrame:
    path = _path(f, "predictions")
    S.write_predictions(S.nest_predictions(f.articles().withColumn("pmid", F.lit(None).cast("string")), f.pred(), f.assoc_pred()), path)
    back = S.read_articles(f.spark, path)
    return back.select("pmc_id", F.explode("association").alias("a")).select("pmc_id", F.col("a.patient_id").alias("patient_id"),
        F.explode_outer("a.phenotype").alias("identifier"))


def write_gate_dataset(f: Fixtures) -> DataFrame:
    path = _path(f, "gate")
    samples = f.samples().select("pmc_id", "ent_idx", "label", *G.NUMERIC, *G.BINARY, "section_type")
    S.write_gate_dataset(samples, path)
    return rounded(f.spark.read.schema(samples.schema).json(path), "rel_position", "dist_to_nearest_anchor_norm").drop("retrieved_score")


def read_concept_index(f: Fixtures) -> DataFrame:
    path = _path(f, "index")
    S.write_concept_index(f.concepts(), path, "given", "none")
    return S.read_concept_index(f.spark, path).select("row_idx", "hpo_id", "name", F.size("embedding").alias("dim"))


def read_answers(f: Fixtures) -> DataFrame:
    path = _path(f, "answers")
    f.answers().write.json(path)
    return S.read_answers(f.spark, path).select("pmc_id", F.coalesce("response", F.lit("")).alias("response"))


# ontology


def ontology_terms(f: Fixtures) -> DataFrame:
    parsed = O.stanza_terms(_stanzas(f))
    return O.ontology_terms(parsed).select("id", "name", F.explode("syns").alias("synonym"), "obsolete", "replaced_by")


def ontology_edges(f: Fixtures) -> DataFrame:
    return O.ontology_edges(O.stanza_terms(_stanzas(f)))


def ontology_descendants(f: Fixtures) -> DataFrame:
    return O.ontology_descendants(f.edges())


def ontology_depth(f: Fixtures) -> DataFrame:
    return O.ontology_depth(f.edges())


def ontology_reach(f: Fixtures) -> DataFrame:
    return O.ontology_reach(f.edges())


def ontology_alias_map(f: Fixtures) -> DataFrame:
    return O.ontology_alias_map(f.terms())


def phrase_dictionary(f: Fixtures) -> DataFrame:
    return O.phrase_dictionary(f.terms(), f.depth().select("id")).select("phrase", "n_tokens", "first_token", "hpo_id")


def concept_names(f: Fixtures) -> DataFrame:
    return O.concept_names(f.terms(), f.depth().select("id"))


# text


def rebuild_text(f: Fixtures) -> DataFrame:
    return W.rebuild_texts(f.nested())


def rebuild_text_sorted(f: Fixtures) -> DataFrame:
    """Segments in reversed list order, laid down by offset."""
    return W.rebuild_texts(f.nested().select("pmc_id", F.reverse("full_text").alias("full_text")), by_offset=True)


def tokenize_offsets(f: Fixtures) -> DataFrame:
    return f.tokens().select("pmc_id", "tok_idx", "token", "start", "end")


def section_lookup(f: Fixtures) -> DataFrame:
    return A.section_lookup(f.gold(), f.segments()).select("pmc_id", "ent_idx", "section")


def context_window(f: Fixtures) -> DataFrame:
    return B.with_context(f.gold(), f.texts(), WIDTH, "context").select("pmc_id", "ent_idx", "context")


def split_ids(f: Fixtures) -> DataFrame:
    return f.gold().select("pmc_id", "ent_idx", F.explode(T.split_ids(F.concat(F.lit(" "), "identifier", F.lit(" ;-1;")))).alias("token"))


def split_ids_real(f: Fixtures) -> DataFrame:
    return f.gold().select("pmc_id", "ent_idx", F.explode(T.split_ids_real(F.concat(F.lit(" "), "identifier", F.lit(" ;-1;")))).alias("token"))


# recognition


def dictionary_candidates(f: Fixtures) -> DataFrame:
    return R.text_candidates(f.texts(), f.phrases()).drop("text")


def dictionary_match(f: Fixtures) -> DataFrame:
    return f.matches().select("pmc_id", "identifier", "offset", "length", "text")


def free_token_ngrams(f: Fixtures) -> DataFrame:
    return R.text_ngrams(f.texts(), f.matches(), 4)


def candidate_filter(f: Fixtures) -> DataFrame:
    return f.ngrams().select("pmc_id", "start", "length", "text")


def distinct_candidate_texts(f: Fixtures) -> DataFrame:
    return R.distinct_candidate_texts(f.ngrams())


def retrieve_top1(f: Fixtures) -> DataFrame:
    return f.top1().select("key", "hpo_id", "name", F.round("score", 4).alias("score"))


def similarity_profile(f: Fixtures) -> DataFrame:
    p = R.similarity_profile(f.top1())
    return p.select(*(F.round(c, 6).alias(c) for c in p.columns))


def select_retrieved(f: Fixtures) -> DataFrame:
    return f.selected(SIMILARITY).select("threshold", "pmc_id", "start", "length", "text", "hpo_id",
        F.round("score", 6).alias("score"))


def merge_mentions(f: Fixtures) -> DataFrame:
    return R.merge_mentions(f.matches(), f.selected([0.5])).select("pmc_id", "ent_idx", "source", "identifier",
        "offset", "length", "text", "retrieved_name", "retrieved_score")


def threshold_scan_recognition(f: Fixtures) -> DataFrame:
    """(threshold, n_new, scores, best)"""
    taken = f.selected([min(SIMILARITY)], with_text=False)
    both = f.once("taken", lambda: taken.select("pmc_id", "hpo_id", "start", "length", "score"))
    scan = N.threshold_scan_recognition(f.matches(), both, f.patients(), f.gold(), f.assoc_gold(), f.articles(), SIMILARITY)
    return rounded(scan, "f1_men", "f1_doc", "f1_micro", "f1_macro", "score")


# association


def patient_anchors(f: Fixtures) -> DataFrame:
    return A.patient_anchors(f.patients()).select("pmc_id", "patient_id", "anchor")


def associate_nearest(f: Fixtures) -> DataFrame:
    return f.assoc_pred().select("pmc_id", "patient_id", "identifier")


def associate_nearest_maxdist(f: Fixtures) -> DataFrame:
    return A.associate_nearest(f.pred(), f.patients(), 800).select("pmc_id", "patient_id", "identifier")


def patient_roster(f: Fixtures) -> DataFrame:
    return A.patient_roster(f.patients()).select("pmc_id", "patient_id", "label", F.size("refs").alias("n_refs"))


def prompt_window(f: Fixtures) -> DataFrame:
    return A.prompt_window(A.section_lookup(f.pred(), f.segments()), f.patients(), f.texts())


def prompt_whole(f: Fixtures) -> DataFrame:
    return A.prompt_whole(f.pred(), f.patients(), f.texts())


def parse_answers(f: Fixtures) -> DataFrame:
    return f.given_patients()[0].select("pmc_id", "ent_idx", "patient_id")


def strip_reasoning(f: Fixtures) -> DataFrame:
    return f.answers().select("pmc_id", A.strip_reasoning(F.concat(F.lit("1: P1</think>"), "response", F.lit("</think>"))).alias("answer"))


def assoc_assigned(f: Fixtures) -> DataFrame:
    return f.assigned().select("pmc_id", "patient_id", "identifier")


def gate_intersect_patient(f: Fixtures) -> DataFrame:
    return A.gate_intersect_patient(f.assoc_pred(), f.assigned(), f.patients()).select("pmc_id", "patient_id", "identifier")


def gate_filter_route(f: Fixtures) -> DataFrame:
    return A.gate_filter_route(f.pred(), f.given_patients()[0], f.patients(), 800).select("pmc_id", "patient_id", "identifier")


def _answered(f: Fixtures) -> DataFrame:
    return f.answers().where(F.col("response") != "").select("pmc_id")


def gate_intersect_article(f: Fixtures) -> DataFrame:
    return A.gate_intersect_article(f.assoc_pred(), f.assigned(), _answered(f), f.patients()).select("pmc_id", "patient_id", "identifier")


def associate_with_fallback(f: Fixtures) -> DataFrame:
    return A.associate_with_fallback(f.pred(), f.patients(), f.answers(), "intersect").select("pmc_id", "patient_id", "identifier", "how")


def decision_stats(f: Fixtures) -> DataFrame:
    return A.decision_stats(f.pred(), f.patients(), f.answers())


def gate_retention(f: Fixtures) -> DataFrame:
    return A.gate_retention(f.assoc_pred(), A.gate_intersect_article(f.assoc_pred(), f.assigned(), _answered(f), f.patients()), _answered(f))


def fuse_intersect(f: Fixtures) -> DataFrame:
    return A.fuse(f.assoc_pred(), f.assigned(), "intersect")


def fuse_union(f: Fixtures) -> DataFrame:
    return A.fuse(f.assoc_pred(), f.assigned(), "union")


def check_mentions_aligned(f: Fixtures) -> DataFrame:
    return A.check_mentions_aligned(f.pred(), f.gold())


def fusion_compare(f: Fixtures) -> DataFrame:
    return rounded(A.fusion_compare(f.assoc_gold(), f.assoc_pred(), f.assigned()), "f1_micro", "f1_macro")


# gate


def gold_union(f: Fixtures) -> DataFrame:
    return G.gold_union(f.assoc_gold())


def label_samples(f: Fixtures) -> DataFrame:
    return f.samples().select("pmc_id", "ent_idx", "label")


def label_balance(f: Fixtures) -> DataFrame:
    return G.label_balance(f.samples())


def gate_features(f: Fixtures) -> DataFrame:
    return rounded(f.samples().select("pmc_id", "ent_idx", "section_type", *G.NUMERIC, *G.BINARY), "retrieved_score", "rel_position",
        "dist_to_nearest_anchor_norm")


def gate_fit(f: Fixtures) -> DataFrame:
    s = G.gate_fit(f.samples())
    return f.spark.createDataFrame([(c, round(s["mean"][c], 6), round(s["std"][c], 6)) for c in G.NUMERIC], "feature string, mean double, std double")


def gate_transform(f: Fixtures) -> DataFrame:
    out = G.gate_transform(f.samples(), G.gate_fit(f.samples()))
    return out.select("pmc_id", "ent_idx", F.posexplode("features").alias("pos", "value")).withColumn("value", F.round("value", 6))


def _predicted(f: Fixtures) -> DataFrame:
    def build() -> DataFrame:
        state = G.gate_fit(f.samples())
        return G.gate_predict(f.samples(), state, *G.gate_train(f.samples(), state))

    return f.once("predicted", build)


def gate_train(f: Fixtures) -> DataFrame:
    """The trained gate's mean log-loss and that of the constant model."""
    p = F.least(F.greatest(F.col("keep_prob"), F.lit(1e-9)), F.lit(1 - 1e-9))
    loss = lambda q: -(F.col("label") * F.log(q) + (1 - F.col("label")) * F.log(1 - q))
    rows = _predicted(f)
    share = rows.agg(F.avg("label").alias("share"), F.avg(loss(p)).alias("loss"), F.count("*").alias("n"))
    return share.select("n", F.round("share", 6).alias("share"), F.round("loss", 4).alias("loss"),
        F.round(-(F.col("share") * F.log("share") + (1 - F.col("share")) * F.log(1 - F.col("share"))), 4).alias("constant_loss"))


def gate_predict(f: Fixtures) -> DataFrame:
    """By the trained weights."""
    return _predicted(f).select("pmc_id", "ent_idx", "label", F.round("keep_prob", 4).alias("keep_prob"))


def gate_sweep(f: Fixtures) -> DataFrame:
    return rounded(G.gate_sweep(_predicted(f), KEEP), "retention_pct", "precision", "recall", "f1")


def gate_apply(f: Fixtures) -> DataFrame:
    return G.gate_apply(_predicted(f), f.patients(), 0.5).select("pmc_id", "patient_id", "identifier")


def gate_threshold_scan(f: Fixtures) -> DataFrame:
    scan = G.gate_threshold_scan(_predicted(f), f.patients(), f.gold(), f.assoc_gold(), f.articles(), KEEP)
    return rounded(scan, "f1_micro", "f1_macro", "score", "delta_macro")


# evaluation


def _score(df: DataFrame) -> DataFrame:
    return rounded(df, "precision", "recall", "f1")


def prf(f: Fixtures) -> DataFrame:
    n = f.given("lineitem").groupBy("l_suppkey").agg(F.sum((F.col("l_returnflag") == "N").cast("long")).alias("tp"),
        F.sum((F.col("l_returnflag") == "A").cast("long")).alias("fp"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("fn"))
    return _score(n.select("l_suppkey", *E.prf(F.col("tp"), F.col("fp"), F.col("fn"))))


def score_mention(f: Fixtures) -> DataFrame:
    return _score(E.score_mention(f.gold(), f.scored_pred()[0], f.articles()))


def score_document(f: Fixtures) -> DataFrame:
    return _score(E.score_document(f.gold(), f.scored_pred()[0], f.articles()))


def score_micro(f: Fixtures) -> DataFrame:
    return _score(E.score_micro(f.assoc_gold(), f.scored_pred()[1]))


def score_macro(f: Fixtures) -> DataFrame:
    return _score(E.score_macro(f.assoc_gold(), f.scored_pred()[1]))


def _total(f: Fixtures) -> DataFrame:
    mentions, associations = f.scored_pred()
    return E.score_total(f.gold(), mentions, f.articles(), f.assoc_gold(), associations)


def score_total(f: Fixtures) -> DataFrame:
    return rounded(_total(f), "f1_men", "f1_doc", "f1_micro", "f1_macro", "score")


def check_coverage(f: Fixtures) -> DataFrame:
    return E.check_coverage(f.gold(), f.pred()).select("missing", "extra")


# diagnosis


def patient_delta(f: Fixtures) -> DataFrame:
    return rounded(D.patient_delta(f.assoc_gold(), f.assoc_pred(), f.assigned()), "f1_base", "f1_model", "delta")


def bucket_delta(f: Fixtures) -> DataFrame:
    return rounded(D.bucket_delta(D.patient_delta(f.assoc_gold(), f.assoc_pred(), f.assigned())), "f1_base", "f1_model", "delta", "contribution")


def miss_extra(f: Fixtures) -> DataFrame:
    return D.miss_extra(f.assoc_gold(), f.assoc_pred(), f.assigned())


def miss_destination(f: Fixtures) -> DataFrame:
    return D.miss_destination(f.assoc_gold(), f.assoc_pred(), f.assigned())


def worst_patients(f: Fixtures) -> DataFrame:
    w = D.worst_patients(f.assoc_gold(), f.assoc_pred(), f.assigned(), 10)
    return rounded(w.select("pmc_id", "patient_id", "delta", *(F.array_join(c, "|").alias(c) for c in ("gold", "base", "model", "missed", "extra"))), "delta")


# tracking


def experiments_upsert(f: Fixtures) -> DataFrame:
    folded = K.experiments_fold(f.experiments())
    return rounded(folded.select("tag", "ord", "ts_local", F.col("local.score").alias("local_score"), F.col("online.score").alias("online_score")),
        "local_score", "online_score")


def record_local(f: Fixtures) -> DataFrame:
    """The local scores of the derived prediction, appended to the log and folded."""
    scores = _total(f)
    log = K.experiments_upsert(f.experiments(), K.record_local(scores, "own", "2024-12-31 00:00"))
    return K.experiments_fold(log).where(F.col("local.f1_men").isNotNull()).select("tag", *(F.col(f"local.{c}").alias(c) for c in K.LOCAL))


def record_online(f: Fixtures) -> DataFrame:
    """A leaderboard score for the tag of the first user, and its gap to the local one."""
    log = K.experiments_upsert(f.experiments(), K.record_online(f.spark, "exp1", board="A", score=50.0))
    return rounded(K.experiments_fold(log).select("tag", F.col("online.board").alias("board"),
        (F.col("online.score") - F.col("local.score")).alias("gap")), "gap")


def experiments_report(f: Fixtures) -> DataFrame:
    return rounded(K.experiments_report(K.experiments_fold(f.experiments())).drop("line"), "local_score", "delta_prev", "online_score", "gap")


# preparation


def _input(f: Fixtures) -> str:
    """The articles as a file in the reverse order of their ids."""
    path = _path(f, "input")
    S.write_in_order(f.documents().select("doc_id", F.to_json(F.struct("pmc_id")).alias("value")), path, F.desc("doc_id"))
    return path


def split_every_k(f: Fixtures) -> DataFrame:
    """By the articles' places in the input, not by their ids."""
    return P.split_every_k(S.read_articles_numbered(f.spark, _input(f))).select("pmc_id", "doc_ord", "split")


def blank_answers(f: Fixtures) -> DataFrame:
    blank = P.blank_answers(_articles(f).withColumn("association", F.array().cast(f"array<{S.ASSOCIATION}>")))
    return blank.select("pmc_id", F.size("full_text").alias("n_segments"), F.size("entities").alias("n_entities"),
        F.size("association").alias("n_associations"))


def corpus_stats(f: Fixtures) -> DataFrame:
    return P.corpus_stats(f.articles(), f.patients(), f.gold(), f.assoc_gold())


def section_counts(f: Fixtures) -> DataFrame:
    return P.section_counts(f.segments())


def check_offsets(f: Fixtures) -> DataFrame:
    """Gold mentions and patients' mentions, every third moved by one character."""
    at = F.when(F.col("idx") % 3 == 0, F.col("offset") + 1).otherwise(F.col("offset")).alias("offset")
    gold = f.gold().select("pmc_id", F.lit("entity").alias("kind"), F.lit("").alias("owner"), F.col("ent_idx").alias("idx"), "offset", "length", "text")
    each = P.patient_mentions(f.patients()).select("pmc_id", F.lit("patient").alias("kind"), F.col("patient_id").alias("owner"), "idx", "offset",
        "length", "text")
    moved = gold.unionByName(each).select("pmc_id", "kind", "owner", "idx", at, "length", "text")
    text = W.rebuild_texts(f.nested(), by_offset=True)
    return P.check_offsets(moved, text).select("pmc_id", "kind", "owner", "idx", "offset", "text", "found")


def check_ontology_ids(f: Fixtures) -> DataFrame:
    return P.check_ontology_ids(f.gold(), O.ontology_alias_map(f.terms()), f.depth().select("id"), f.terms())


def check_submission(f: Fixtures) -> DataFrame:
    """The prediction written in the order of the input, read again line by line."""
    inputs = S.read_articles_numbered(f.spark, _input(f)).select("doc_ord", "pmc_id")
    nested = S.nest_predictions(inputs.withColumn("pmid", F.lit(None).cast("string")), f.pred(), f.assoc_pred()).join(inputs, "pmc_id")
    path = _path(f, "submission")
    S.write_in_order(nested.select("doc_ord",
        F.to_json(F.struct("pmc_id", "pmid", "entities", "association"), {"ignoreNullFields": "false"}).alias("value")), path, "doc_ord")
    return P.check_submission(inputs, S.read_lines_numbered(f.spark, path))


ALL = (
    read_articles, read_articles_tolerant, read_ontology, write_predictions, write_gate_dataset, read_concept_index, read_answers,
    ontology_terms, ontology_edges, ontology_descendants, ontology_depth, ontology_reach, ontology_alias_map, phrase_dictionary, concept_names,
    rebuild_text, rebuild_text_sorted, tokenize_offsets, section_lookup, context_window, split_ids, split_ids_real,
    dictionary_candidates, dictionary_match, free_token_ngrams, candidate_filter, distinct_candidate_texts, retrieve_top1,
    similarity_profile, select_retrieved, merge_mentions, threshold_scan_recognition,
    patient_anchors, associate_nearest, associate_nearest_maxdist, patient_roster, prompt_window, prompt_whole, parse_answers, strip_reasoning,
    assoc_assigned, gate_intersect_patient, gate_filter_route, gate_intersect_article, associate_with_fallback, decision_stats, gate_retention,
    fuse_intersect, fuse_union, check_mentions_aligned, fusion_compare,
    gold_union, label_samples, label_balance, gate_features, gate_fit, gate_transform, gate_train, gate_predict, gate_sweep, gate_apply, gate_threshold_scan,
    prf, score_mention, score_document, score_micro, score_macro, score_total, check_coverage,
    patient_delta, bucket_delta, miss_extra, miss_destination, worst_patients,
    experiments_upsert, record_local, record_online, experiments_report,
    split_every_k, blank_answers, corpus_stats, section_counts, check_offsets, check_ontology_ids, check_submission,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: (lambda spark, sf_dir, q=q: q(fixtures(spark, sf_dir))) for q in ALL}


def oracle_sql() -> dict[str, str]:
    from .oracles import oracle_sql as sql

    return sql()
