"""Small literal frames for the edges of the operators' rules."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions import blocks as B
from termloom.functions import rebuild as W
from termloom.functions import text as T
from termloom.functions.digest import md5_head
from termloom.operators import associate as A
from termloom.operators import diagnose as D
from termloom.operators import evaluate as E
from termloom.operators import gate as G
from termloom.operators import ontology as O
from termloom.operators import recognize as R
from termloom.operators import scan as N
from termloom.operators import track as K
from termloom.sources import articles as S
from termloom.streaming import articles as stream

PATIENTS = "pmc_id string, roster_idx int, patient_id string, mentions array<struct<offset:int,length:int,text:string>>"
MENTIONS = "pmc_id string, ent_idx int, identifier string, offset int, length int, text string, note string"
ASSOC = "pmc_id string, patient_id string, identifier string"


def column(spark, c, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(c).first()[0]


def test_ids(spark):
    assert column(spark, T.split_ids(F.col("x")), x=" a; ; b ;-1 ") == ["a", "b", "-1"]
    assert column(spark, T.split_ids_real(F.col("x")), x="a;-1") == ["a"]
    assert spark.sql("SELECT CAST(NULL AS STRING) AS x").select(T.split_ids(F.col("x"))).first()[0] == []


@pytest.mark.parametrize(
    "segments,plain,by_offset",
    [
        ([(0, "abc"), (3, "def")], "abcdef", "abcdef"),
        ([(2, "ab"), (6, "c")], "  ab  c", "  ab  c"),
        ([(4, "EFGH"), (0, "abcdef")], "abcdefGH", "abcdEFGH"),
        ([(0, "abcdef"), (1, "X")], "aXcdef", "aXcdef"),
        ([(0, "😀b"), (2, "c")], "😀bc", "😀bc"),
        ([(None, "x"), (3, None)], "x  ", "x  "),
        ([], "", ""),
    ],
)
def test_rebuild(spark, segments, plain, by_offset):
    df = spark.createDataFrame([("p", segments)], "pmc_id string, full_text array<struct<offset:int,text:string>>")
    got = [W.rebuild_texts(df, by).first()["text"] for by in (False, True)]
    assert (got[0].rstrip(), got[1].rstrip()) == (plain.rstrip(), by_offset.rstrip())


def plain_layers(segments):
    out = []
    for offset, text in segments:
        offset, text = offset or 0, text or ""
        out += " " * max(0, offset + len(text) - len(out))
        out[offset : offset + len(text)] = text
    return "".join(out)


def test_rebuild_of_many_layers(spark):
    """Random segments over each other, one under thousands, thousands under one, empty and null ones, with and without overlap."""
    r = random.Random(7)
    word = lambda n: "".join(r.choices("abcdé😀", k=n))
    articles = {f"r{i}": [(r.choice([None, *range(30)]), r.choice([None, word(r.randint(0, 12))])) for _ in range(r.randint(0, 12))] for i in range(40)}
    articles["under"] = [(0, word(30_000)), *((r.randint(0, 31_000), word(r.randint(1, 4))) for _ in range(3000))]
    articles["over"] = [*((r.randint(0, 20_000), word(r.randint(1, 50))) for _ in range(3000)), (10, word(9000))]
    articles["none"], articles["plain"] = None, [(3, "abc"), (9, "d")]
    df = spark.createDataFrame(list(articles.items()), "pmc_id string, full_text array<struct<offset:int,text:string>>").repartition(3)
    for by_offset in (False, True):
        order = (lambda s: sorted(s, key=lambda x: x[0] or 0)) if by_offset else (lambda s: s)
        got = {x["pmc_id"]: x["text"] for x in W.rebuild_texts(df, by_offset).collect()}
        assert got == {k: plain_layers(order(v or [])) for k, v in articles.items()}


def test_phrases(spark):
    terms = spark.createDataFrame([(0, "HP:1", "a b", ["ab", "abc", "abcd", "A-B", " Two  Words "], False), (1, "HP:0", "abcd", [], False),
        (2, "HP:2", "gone one", [], True)], "ord int, id string, name string, syns array<string>, obsolete boolean")
    got = {r["phrase"]: (r["n_tokens"], r["hpo_id"]) for r in O.phrase_dictionary(terms, terms.select("id")).collect()}
    assert got == {"a b": (2, "HP:1"), "abcd": (1, "HP:0"), "two words": (2, "HP:1")}
    names = [(r["hpo_id"], r["name"]) for r in O.concept_names(terms, terms.select("id")).orderBy("hpo_id", "alias_idx").collect()]
    assert names == [("HP:0", "abcd"), ("HP:1", "a b"), ("HP:1", "ab"), ("HP:1", "abc"), ("HP:1", "abcd"), ("HP:1", "A-B"), ("HP:1", "Two Words")]


def match(spark, text, phrases):
    texts = spark.createDataFrame([("p", text)], "pmc_id string, text string")
    table = spark.createDataFrame([(p, len(p.split()), p.split()[0], f"H:{p}") for p in phrases],
        "phrase string, n_tokens int, first_token string, hpo_id string")
    return sorted((r["offset"], r["text"]) for r in R.dictionary_match(texts, R.tokenize(texts), table).collect())


def test_match_is_leftmost_longest(spark):
    assert match(spark, "😀 A b c d", ["a b", "b c d"]) == [(2, "A b")]
    assert match(spark, "a b, c-d", ["a", "a b", "c d"]) == [(0, "a b"), (5, "c-d")]
    nine = "k1 k2 k3 k4 k5 k6 k7 k8 k9"
    assert match(spark, nine, [nine, "k9"]) == [(24, "k9")]


def test_greedy_by_score(spark):
    grams = spark.createDataFrame([("p", 0, 0, 3, "a b"), ("p", 0, 2, 5, "b c d"), ("p", 0, 8, 1, "e")],
        "pmc_id string, run_id int, start int, length int, text string")
    hits = spark.createDataFrame([("a b", "H:1", "one", 0.8), ("b c d", "H:2", "two", 0.9), ("e", "H:3", "three", 0.5)],
        "text string, hpo_id string, name string, score double")
    got = sorted((r["threshold"], r["start"]) for r in R.select_retrieved(grams, hits, [0.5, 0.85, 0.95]).collect())
    assert got == [(0.5, 2), (0.5, 8), (0.85, 2)]


@pytest.fixture
def people(spark):
    return spark.createDataFrame([("p", 0, "P1", [(10, 1, "x")]), ("p", 1, "P2", [(20, 1, "xx"), (40, 2, "yyy"), (None, None, "")]),
        ("q", 0, "P1", []), ("q", 1, "P2", [])], PATIENTS)


def test_nearest(spark, people):
    m = spark.createDataFrame([("p", 0, "a", 15, 1, "", None), ("p", 1, "b", 48, 1, "", None), ("p", 2, "c", 0, 1, "", None),
        ("q", 0, "d", 5, 1, "", None), ("r", 0, "e", 5, 1, "", None)], MENTIONS)
    who = lambda d: {(r["pmc_id"], r["ent_idx"]): r["patient_id"] for r in A.nearest(m, people, d).collect()}
    assert who(None) == {("p", 0): "P1", ("p", 1): "P2", ("p", 2): "P1", ("q", 0): "P1", ("r", 0): None}
    assert who(8) == {("p", 0): "P1", ("p", 1): "P2", ("p", 2): None, ("q", 0): None, ("r", 0): None}
    flat = A.associate_nearest(m, people, 8).collect()
    assert sorted((r["pmc_id"], r["patient_id"], r["identifier"] or "") for r in flat) == [("p", "P1", "a"), ("p", "P2", "b"), ("q", "P1", ""), ("q", "P2", "")]


def test_roster(people):
    got = {(r["pmc_id"], r["patient_id"]): (r["label"], [tuple(x) for x in r["refs"]]) for r in A.patient_roster(people).collect()}
    assert got[("p", "P2")] == ("yyy", [("xx", 20), ("yyy", 40), ("", -1)]) and got[("q", "P1")] == ("", [])


def test_answers(spark, people):
    m = spark.createDataFrame([("p", i, f"i{i}", 15, 1, "", None) for i in range(5)], MENTIONS)
    text = "0: P1</think>- 1: P1\n1: P9\n2) P2.\n# 3. P2\n3: P1\n9: P1\n4: NONE\nno line\n 5: P2 (sure)"
    given, counted = A.parse_answers(spark.createDataFrame([("p", text)], "pmc_id string, response string"), m, people)
    assert sorted((r["ent_idx"], r["patient_id"]) for r in given.collect()) == [(0, "P1"), (2, "P1"), (4, "P2")]
    assert counted.first()["n_parsed"] == 7


def test_gates_differ(spark, people):
    m = spark.createDataFrame([("p", 0, "a", 10, 1, "", None), ("p", 1, "b", 11, 1, "", None), ("p", 2, "b", 40, 1, "", None)], MENTIONS)
    answers = spark.createDataFrame([("p", "1: P2\n2: P2\n3: NONE")], "pmc_id string, response string")
    given, _ = A.parse_answers(answers, m, people)
    near, own = A.associate_nearest(m, people), A.assoc_assigned(m, given, people)
    flat = lambda df: sorted((r["patient_id"], r["identifier"]) for r in df.where("pmc_id = 'p' AND identifier IS NOT NULL").collect())
    assert flat(near) == [("P1", "a"), ("P1", "b"), ("P2", "b")]
    assert flat(A.gate_intersect_patient(near, own, people)) == [("P2", "b")]
    assert flat(A.gate_filter_route(m, given, people)) == [("P1", "a"), ("P1", "b")]
    assert flat(A.gate_intersect_article(near, own, answers, people)) == [("P1", "a"), ("P1", "b"), ("P2", "b")]
    with pytest.raises(ValueError):
        A.associate_with_fallback(m, people, answers, "whole", 5)


def test_scores(spark):
    """One article, two patients, a negated mention and a compound id: 2/3, 2/3, 3/4 and (0.8 + 2/3) / 2."""
    gold_m = spark.createDataFrame([("d", 0, "H:1", 0, 2, "", None), ("d", 1, "H:2;H:3", 5, 2, "", None), ("d", 2, "H:9", 9, 2, "", "NO")], MENTIONS)
    pred_m = spark.createDataFrame([("d", 0, "H:1", 0, 2, "", None), ("d", 1, "H:2", 5, 2, "", None), ("d", 2, "H:7", 20, 2, "", None),
        ("x", 0, "H:1", 0, 2, "", None)], MENTIONS)
    gold = spark.createDataFrame([("d", "P1", "H:1"), ("d", "P1", "H:2;H:3"), ("d", "P2", "H:4")], ASSOC)
    pred = spark.createDataFrame([("d", "P1", "H:1"), ("d", "P1", "H:2"), ("d", "P2", "H:4"), ("d", "P2", "H:5")], ASSOC)
    articles = spark.createDataFrame([("d",)], "pmc_id string")
    r = E.score_total(gold_m, pred_m, articles, gold, pred).first()
    want = (2 / 3, 2 / 3, 0.75, (0.8 + 2 / 3) / 2)
    assert all(abs(r[k] - w) < 1e-9 for k, w in zip(("f1_men", "f1_doc", "f1_micro", "f1_macro"), want))
    assert abs(r["score"] - sum(want) / 4) < 1e-9


def test_empty_patients(spark):
    gold = spark.createDataFrame([("d", "P1", None), ("d", "P2", None)], ASSOC)
    pred = spark.createDataFrame([("d", "P1", None), ("d", "P2", "H:1"), ("e", "P1", "H:2")], ASSOC)
    assert E.score_macro(gold, pred).first()["f1"] == 0.5
    r = E.score_micro(gold, pred).first()
    assert (r["tp"], r["fp"], r["fn"], r["f1"]) == (0, 2, 0, 0.0)
    with pytest.raises(ValueError):
        E.check_coverage(gold, pred.where("pmc_id = 'e'"))


def test_fit_rules(spark):
    names = [*G.NUMERIC, *G.BINARY]
    rows = spark.createDataFrame([(None, 3.0, 1.0, None, 0.5, None, 2.0, 1, 0, 0, "A"), (None, 3.0, 2.0, None, 0.7, None, 2.0, 0, 1, 0, "B")],
        ", ".join(f"{n} double" for n in G.NUMERIC) + ", " + ", ".join(f"{n} int" for n in G.BINARY) + ", section_type string")
    state = G.gate_fit(rows)
    assert state["fill"]["retrieved_score"] == 0.0 and state["std"]["mention_char_len"] == 1.0 and state["std"]["mention_word_len"] == 0.5 and state["sections"] == ["A", "B", G.OTHER]
    v = G.gate_transform(rows.limit(1).withColumn("section_type", F.lit("Z")), state).first()["features"]
    assert len(v) == len(G.feature_names(state)) == len(names) + 6 and v[-1] == 1.0 and sum(v[-3:]) == 1.0


def test_log_fold(spark):
    log = spark.createDataFrame([(0, None, "t", "first", None, None, (0.1, None, None, None, 0.5), None),
        (1, "2024", "t", None, None, None, None, ("A", 0.7, None, None, None, None, None)), (2, "2023", "u", None, None, None, None, None)], K.RECORD)
    rows = {r["tag"]: r for r in K.experiments_fold(log).collect()}
    assert rows["t"]["note"] == "first" and rows["t"]["ts_local"] == "2024" and rows["t"]["local"]["score"] == 0.5 and rows["t"]["online"]["score"] == 0.7
    lines = [r["line"] for r in K.experiments_report(K.experiments_fold(log)).orderBy("pos").collect()]
    assert lines == ["| 2023 | u | -- | -- | -- | -- |", "| 2024 | t | 0.5000 | -- | 0.7000 | 0.2000 |"]


def test_stream_equals_batch(spark, tmp_path):
    articles = spark.createDataFrame([("a", "1", [(0, "Big head", None, None)], [("P1", [(0, 1, "x")])], None, None),
        ("b", "2", [(3, "no match", None, None)], [], None, None)], S.ARTICLE)
    phrases = spark.createDataFrame([("big head", 2, "big", "H:1")], "phrase string, n_tokens int, first_token string, hpo_id string")
    S.write_predictions(articles, str(tmp_path / "in"))
    stream.recognise_stream(stream.stream_articles(spark, str(tmp_path / "in")), phrases, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    flat = lambda df: sorted(str(r) for r in df.select("pmc_id", "pmid", "entities", "association").collect())
    assert flat(S.read_articles(spark, str(tmp_path / "out" / "*"))) == flat(stream.recognise(articles, phrases))


def test_the_last_version_counts(spark):
    """An article that comes twice: its last mentions, also where it has none; a patient's last identifiers, from the last version that names them."""
    mentions = spark.createDataFrame([("p", 0, "H:1", 1, 2, 0), ("p", 0, "H:2", 5, 2, 1), ("q", 0, "H:3", 1, 2, 0)],
        "pmc_id string, ent_idx int, identifier string, offset int, length int, doc_ord int")
    versions = spark.createDataFrame([("p", 0), ("p", 1), ("q", 0), ("q", 2)], "pmc_id string, doc_ord int")
    assert [(r["pmc_id"], r["identifier"]) for r in E.last_mentions(mentions, versions).collect()] == [("p", "H:2")]
    pairs = [("p", "P1", "H:1", 0), ("p", "P1", "H:2", 1), ("p", "P1", "H:3", 1), ("p", "P2", "H:4", 0), ("p", "P3", "H:5", 0), ("p", "P3", None, 1)]
    given = spark.createDataFrame(pairs, "pmc_id string, patient_id string, identifier string, doc_ord int")
    got = {(r["patient_id"], r["identifier"]) for r in E.last_associations(given).collect()}
    assert got == {("P1", "H:2"), ("P1", "H:3"), ("P2", "H:4"), ("P3", None)}


def test_section_of_overlapping_segments(spark):
    """The first segment by start that holds the offset, against a plain search; touching, nested and empty ones, ties and gaps."""
    import random

    r = random.Random(5)
    segments = [(p, i, r.randrange(60), "x" * r.choice([0, 1, 5, 20, 50]), f"s{i}") for p in "ab" for i in range(12)] + [("c", 0, 3, "abc", None)]
    mentions = [(p, i, o) for p in "abcd" for i, o in enumerate(range(0, 110, 1))]
    got = A.section_lookup(spark.createDataFrame(mentions, "pmc_id string, ent_idx int, offset int"),
        spark.createDataFrame(segments, "pmc_id string, seg_idx int, offset int, text string, section_type string")).collect()
    assert len(got) == len(mentions)
    for row in got:
        held = [(s[2], s[1], s[4]) for s in segments if s[0] == row["pmc_id"] and s[2] <= row["offset"] < s[2] + len(s[3])]
        assert row["section"] == ((min(held)[2] or "?") if held else "?")


def test_places_in_the_input(spark, tmp_path):
    """Ordinals follow file names and lines, also over several splits of a file."""
    for k, name in enumerate(["b.jsonl", "a.jsonl"]):
        (tmp_path / name).write_text("".join(f'{{"pmc_id": "{name[0]}{i}"}}\n' + "\n" * (i % 2) for i in range(300 + k)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        rows = S.read_articles_numbered(spark, str(tmp_path)).orderBy("doc_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["pmc_id"] for r in rows] == [f"a{i}" for i in range(301)] + [f"b{i}" for i in range(300)]
    assert [r["doc_ord"] for r in rows] == list(range(601))


def test_report_over_many_parts(spark):
    """delta_prev is carried over ranges that hold no local score."""
    import random

    r, before = random.Random(1), spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(f"t{i}", i, f"2024-{i // 28 % 12 + 1:02d}-{i % 28 + 1:02d}", r.choice([None, None, None, round(r.random(), 4)]), 0.5) for i in range(200)]
    folded = spark.createDataFrame(rows, "tag string, ord int, ts_local string, l double, o double").selectExpr("tag", "ord", "ts_local",
        "named_struct('score', l) AS local", "named_struct('score', o) AS online")
    got = K.experiments_report(folded).orderBy("pos").collect()
    last = None
    for x, (tag, _, _, local, _) in zip(got, sorted(rows, key=lambda x: (x[2], x[1])), strict=True):
        assert x["tag"] == tag
        assert x["delta_prev"] == (None if last is None or local is None else pytest.approx(local - last))
        last = local if local is not None else last
    assert [x["pos"] for x in got] == list(range(1, 201)) and before


def test_ngram_texts(spark):
    """N-grams with their gaps, beyond the basic plane as well, as they stand in the text."""
    text = "Ab  😀 c-d\tE9! \n f " * 3
    texts = spark.createDataFrame([("p", text)], "pmc_id string, text string")
    tokens = R.tokenize(texts)
    none = spark.createDataFrame([], "pmc_id string, tok_idx int, n_tokens int")
    got = {(r["start"], r["length"]): r["text"] for r in R.free_token_ngrams(tokens, none, 6).collect()}
    assert len(got) == 6 * 15 - 15 and all(text[s : s + n] == t for (s, n), t in got.items())


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from termloom import session

    sc = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda *a: None), getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        session.shared_dir(SimpleNamespace(sparkContext=sc))


def test_staged_tables_go(spark):
    import os

    from termloom import session

    df = session.stage(spark.range(5), "some")
    path = df._staged_path
    assert os.path.exists(path.removeprefix("file:")) and path in session._staged
    session.unstage(df)
    assert not os.path.exists(path.removeprefix("file:"))


def test_a_changed_folder_has_new_tables(spark, tmp_path):
    from termloom.plans.fixtures import fixtures

    for n in (3, 5):
        spark.range(n).selectExpr("id AS doc_id", "'a b' AS text").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        assert fixtures(spark, str(tmp_path)).segments().count() == n
        assert fixtures(spark, str(tmp_path)) is fixtures(spark, str(tmp_path))


def test_slices_come_from_blocks(spark):
    """Slices of any length and place, against plain ones; characters outside the basic plane count as one."""
    r = random.Random(3)
    texts = {"a": "".join(r.choices("abc \n😀é", k=20_000)), "b": "short", "c": "", "d": None, "e": "x" * B.SIZE, "f": "y" * (B.SIZE + 1)}
    spans = [(k, i, r.randint(0, len(t or "") + 10)) for k, t in texts.items() for i in range(60)]
    rows = [(k, i, at, at + r.choice([0, 1, 30, B.OVERLAP, B.OVERLAP + 1, 5000, 12_000])) for k, i, at in spans]
    rows += [("a", 100, -3, 5), ("a", 101, None, 5), ("a", 102, 5, None), ("a", 103, 9, 2), ("zz", 104, 0, 5), (None, 105, 0, 5), *rows[:5]]
    df = spark.createDataFrame(rows, "pmc_id string, i int, begin int, finish int")
    got = B.with_slice(df, spark.createDataFrame(list(texts.items()), "pmc_id string, text string"), F.col("begin"), F.col("finish"), "found")
    assert got.columns == [*df.columns, "found"]
    plain = lambda k, a, z: "" if a is None or z is None or a < 0 else (texts.get(k) or "")[a:z]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((k, i, a, z, plain(k, a, z))) for k, i, a, z in rows)


def test_context(spark):
    texts = spark.createDataFrame([("p", "one  two\nthree four")], "pmc_id string, text string")
    spans = spark.createDataFrame([("p", 5, 3), ("p", 0, 3)], "pmc_id string, offset int, length int")
    assert [r["c"] for r in B.with_context(spans, texts, 4, "c").orderBy("offset").collect()] == ["one tw", "ne two thr"]


def test_leftmost_longest_over_long_runs(spark):
    """Random candidates, sparse and without a gap, against a plain run from left to right."""
    r = random.Random(5)
    rows, want = [], []
    for name, n, density in (("gaps", 400, 0.2), ("dense", 3000, 1.0), ("ones", 50, 1.0)):
        best = {}
        for at in range(n):
            for _ in range(2):
                if r.random() < density:
                    size = 1 if name == "ones" else r.randint(1, 8)
                    rows.append((name, at, size, f"H{size}", at, at + size))
                    best[at] = max(best.get(at, 0), size)
        last = 0
        for at in sorted(best):
            if at >= last:
                last = at + best[at]
                want.append((name, at, best[at], f"H{best[at]}", at, last))
    df = spark.createDataFrame(rows, "pmc_id string, tok_idx int, n_tokens int, hpo_id string, start int, end int").repartition(3)
    assert sorted(map(tuple, R.leftmost_longest(df).collect())) == sorted(want)
    assert R.leftmost_longest(df.limit(0)).count() == 0


def test_candidates_are_filtered_before_they_meet_phrases(spark, monkeypatch):
    """Many phrases with one first word, too large to broadcast: tokens that begin none are dropped first, and probes are whole phrases."""
    monkeypatch.setattr("termloom.session.BROADCAST_LIMIT", 1000)
    phrases = spark.range(5000).selectExpr("concat('the w', id, IF(id % 2 = 0, '', ' x')) AS phrase", "IF(id % 2 = 0, 2, 3) AS n_tokens", "'the' AS first_token",
        "concat('H', id) AS hpo_id")
    text = " ".join(f"the w{i} x" for i in range(300)) + " none of these"
    tokens = R.tokenize(spark.createDataFrame([("p", text)], "pmc_id string, text string"))
    found = R.dictionary_candidates(tokens, phrases)
    got = sorted((r["tok_idx"], r["n_tokens"], r["hpo_id"]) for r in found.collect())
    assert got == [(3 * i, 2 + i % 2, f"H{i}") for i in range(300)]
    assert found._jdf.queryExecution().analyzed().toString().count("strategy=broadcast") == 1  # the first words alone


@pytest.mark.parametrize("n", [1, 4, 100])
def test_threshold_scores(spark, n):
    """Scores by level against those of the whole table at each threshold; ties, nulls, repeated rows, patients without tokens."""
    r = random.Random(n)
    thresholds = sorted(r.choice([0.0, 1.0, round(r.random(), 2)]) for _ in range(n))
    prob = lambda: r.choice([None, 0.0, 1.0, float("inf"), round(r.random(), 2)])
    ids = lambda: r.choice(["a", "b", "c;d", " a ; a", "-1", "", None])
    place = lambda: (r.choice("pqrs"), r.randint(0, 5), r.randint(1, 2), ids(), r.choice(["NO", None, None]))
    gold_m, pred_m = [place() for _ in range(40)], [(*place(), prob()) for _ in range(60)]
    gold_a = [(r.choice("pq"), r.choice(["P1", "P2", "P3"]), ids()) for _ in range(12)] + [("r", "P1", None), ("s", "P1", None)]
    pred_a = [(r.choice("pqr"), r.choice(["P1", "P2", "P4"]), ids(), prob()) for _ in range(40)]
    m, a = "pmc_id string, offset int, length int, identifier string, note string", "pmc_id string, patient_id string, identifier string"
    gm, ga = spark.createDataFrame(gold_m, m), spark.createDataFrame(gold_a, a)
    articles = spark.createDataFrame([(k,) for k in "pqr"], "pmc_id string")
    pm, pa_ = spark.createDataFrame(pred_m, m + ", prob double"), spark.createDataFrame(pred_a, a + ", prob double")
    got = {x["threshold"]: tuple(x)[1:] for x in E.score_thresholds(gm, pm, articles, ga, pa_, thresholds).collect()}
    assert sorted(got) == sorted(set(thresholds))
    for t in sorted(set(thresholds))[:: max(1, len(set(thresholds)) // 5)]:
        want = E.score_total(gm, pm.where(F.col("prob") >= t), articles, ga, pa_.where(F.col("prob") >= t)).first()
        assert got[t] == pytest.approx(tuple(want), abs=1e-9)
    counts = {x["threshold"]: x["k"] for x in E.threshold_counts(pa_, thresholds, "k").collect()}
    assert counts == {t: sum(x[3] is not None and x[3] >= t for x in pred_a) for t in thresholds}


def test_threshold_scores_of_nothing(spark):
    empty = spark.createDataFrame([], "pmc_id string, offset int, length int, identifier string, note string, prob double")
    people = spark.createDataFrame([], "pmc_id string, patient_id string, identifier string, prob double")
    got = E.score_thresholds(empty.drop("prob"), empty, empty.select("pmc_id"), people.drop("prob"), people, [0.5, 0.1]).collect()
    assert [tuple(x) for x in sorted(got)] == [(0.1, 0, 0, 0, 0, 0), (0.5, 0, 0, 0, 0, 0)]


def test_bad_lines_of_files_with_many_splits(spark, tmp_path):
    """Line numbers over many splits and files, blank lines and long ones among them; no line goes through an exchange."""
    r, want, good = random.Random(2), [], 0
    for name in ("b.json", "a.json", "empty.json"):
        lines = []
        for i in range(0 if name == "empty.json" else 700):
            kind = r.choice(["good", "good", "bad", "blank", "long"])
            line = {"good": f'{{"pmc_id": "P{i}"}}', "bad": f'{{"pmc_id": "P{i}', "blank": r.choice(["", "  "]), "long": '{"pmc_id": "' + "x" * 3000 + '"}'}[kind]
            good += kind in ("good", "long")
            want += [(name, i + 1, line)] * (kind == "bad")
            lines.append(line)
        (tmp_path / name).write_text("\n".join(lines) + ("" if name == "a.json" else "\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        articles, bad = S.read_articles_tolerant(spark, str(tmp_path))
        got = sorted((x["file"].rsplit("/", 1)[1], x["line_no"], x["line"]) for x in bad.collect())
        assert got == sorted(want) and articles.count() == good and articles.rdd.getNumPartitions() > 100
        splits = bad.sparkSession.read.text(str(tmp_path)).rdd.getNumPartitions()
        assert splits > 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ontology_stanzas_are_in_order(spark, tmp_path):
    """By file name and place, whatever the files' sizes."""
    for name, n in (("b.obo", 3), ("a.obo", 400), ("c.obo", 50)):
        (tmp_path / name).write_text("".join(f"[Term]\nid: {name}{i:03d}\nname: n\n\n" for i in range(n)))
    rows = S.read_ontology_text(spark, str(tmp_path)).orderBy("ord").collect()
    assert [x["ord"] for x in rows] == list(range(453))
    ids = [x["stanza"].split("id: ")[1].split("\n")[0] for x in rows]
    assert ids == sorted(ids)


def plain_greedy(rows):
    """(start, length) taken of (start, length, score) of one run."""
    covered, taken = set(), set()
    for s, n, _ in sorted(rows, key=lambda x: (-x[2], x[0], -x[1])):
        if covered.isdisjoint(range(s, s + n)):
            covered.update(range(s, s + n))
            taken.add((s, n))
    return taken


@pytest.mark.parametrize("scores", ["random", "few", "rising", "falling"])
def test_greedy_selection_of_long_runs(spark, scores):
    """50,000 n-grams that all hang together, in batches, against a plain greedy run; other runs before and after."""
    r = random.Random(4)
    score = {"random": lambda i: r.random(), "few": lambda i: r.choice([0.5, 0.6, 0.7]), "rising": lambda i: 0.3 + i / 1e6, "falling": lambda i: 0.9 - i / 1e6}[scores]
    rows = [(article, run, 2 * i, 2 * n - 1, f"{article} {run} {i} {n}", score(i)) for article, run, m in (("p", 0, 12_500), ("p", 30_000, 30), ("o", 0, 40), ("q", 5, 1))
        for i in range(m) for n in (1, 2, 3, 4) if i + n <= m]
    df = spark.createDataFrame(rows, "pmc_id string, run_id int, start int, length int, text string, score double").repartition(4)
    hits = df.select("text", F.lit("H").alias("hpo_id"), F.lit("n").alias("name"), "score")
    got = {}
    for x in R.select_retrieved(df.drop("score"), hits, [0.0]).collect():
        got.setdefault((x["pmc_id"], x["run_id"]), set()).add((x["start"], x["length"]))
    want = {}
    for a, run, s, n, _, v in rows:
        want.setdefault((a, run), []).append((s, n, v))
    assert got == {k: plain_greedy(v) for k, v in want.items()}


def test_gate_weights_are_the_least_loss(spark):
    """Weighted rows, sections that depend on each other, classes that come apart, no rows: finite weights, and the plain optimum."""
    import numpy as np

    r = random.Random(1)
    names = [*G.NUMERIC, *G.BINARY, "section_type", "label"]
    schema = ", ".join(f"{c} {'string' if c == 'section_type' else 'int' if c == 'label' else 'double'}" for c in names)
    row = lambda apart: (lambda x: (*x, *(float(r.random() < 0.5) for _ in G.BINARY), r.choice("AB"), int(x[1] > 0.5 if apart else r.random() < 1 / (1 + 2.7 ** (2 - 4 * x[1])))))(
        [r.random() for _ in G.NUMERIC])
    for apart in (False, True):
        samples = spark.createDataFrame([row(apart) for _ in range(400)], schema)
        state = G.gate_fit(samples)
        weights, bias = G.gate_train(samples, state, positive_weight=2.0)
        rows = G.gate_transform(samples, state).select("features", "label").collect()
        x, y = np.array([[*v["features"], 1.0] for v in rows]), np.array([v["label"] for v in rows], float)
        each = np.where(y == 1, 2.0, 1.0)
        objective = lambda w: (each * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() / each.sum() + 5e-7 * w @ w
        best = np.array([*weights, bias])
        assert np.isfinite(best).all() and all(objective(best) <= objective(best + 1e-3 * np.eye(len(best))[k] * s) + 1e-12 for k in range(len(best)) for s in (1, -1))
    assert G.gate_train(samples.limit(0), state) == ([0.0] * len(weights), 0.0)


def test_nearest_concepts(spark, monkeypatch):
    """Clustered vectors, copies, vectors of other lengths, null, ragged and broken ones, against a plain search; clusters leave packs out."""
    import numpy as np

    monkeypatch.setattr(R, "CONCEPT_ROWS", 20)
    monkeypatch.setattr(R, "QUERY_ROWS", 16)
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 10))
    unit = lambda v: v / np.linalg.norm(v)
    cluster = lambda n: [unit(centres[i % 12] + 0.1 * r.normal(size=10)).tolist() for i in range(n)]
    concepts = cluster(600)
    concepts[7] = concepts[500] = concepts[300]
    concepts[11] = (np.array(concepts[11]) * 3).tolist()
    rows = [(i, f"H{i}", f"n{i}", v) for i, v in enumerate(concepts)]
    broken = [(900, "H", "n", None), (901, "H", "n", [1.0] * 9), (902, "H", "n", [None, *[1.0] * 9]), (903, "H", "n", [float("nan")] * 10), (None, "H", "n", [1.0] * 10)]
    asked = cluster(200) + [concepts[300], [0.0] * 10, (5 * unit(centres[0])).tolist()]
    schema = "row_idx long, hpo_id string, name string, embedding array<double>"
    c = spark.createDataFrame([*broken, *rows], schema).repartition(3)
    q = spark.createDataFrame([*enumerate(asked), (900, None), (901, [1.0]), (902, [None] * 10), (None, asked[0])], "key long, embedding array<double>")
    got = {x["key"]: x for x in R.retrieve_top1(q, c, report=True).collect()}
    score = np.array(asked) @ np.array(concepts).T
    assert sorted(got) == list(range(len(asked)))
    for k, x in got.items():
        assert x["score"] == pytest.approx(score[k].max(), abs=1e-12) and score[k][x["row_idx"]] >= score[k].max() - 1e-12 and x["hpo_id"] == f"H{x['row_idx']}"
    assert got[200]["row_idx"] in (7, 11) and got[201]["row_idx"] == 0
    assert got[201]["packs_met"] == got[201]["packs"] >= 30
    assert np.mean([got[k]["packs_met"] / got[k]["packs"] for k in range(200)]) < 0.5
    assert R.retrieve_top1(q, c.limit(0)).count() == 0 and R.retrieve_top1(q.limit(0), c).count() == 0


def test_settled_leaves_its_result_alone(spark):
    """Tables staged on the way go, with or without a frame that still stands for them; earlier ones stay until they are unstaged."""
    import os

    from termloom import session

    there = lambda: {n for n in os.listdir(session.staging_dir(spark).removeprefix("file:")) if n.startswith("settled_")}
    early = session.stage(spark.range(3), "settled_early")

    def build():
        session.stage(spark.range(5), "settled_lost")
        return session.stage(spark.range(4), "settled_way").where("id > 1")

    out = session.settled(build, "settled_out")
    assert [r["id"] for r in out.orderBy("id").collect()] == [2, 3] and early.count() == 3
    assert sorted(n.rsplit("-", 1)[0] for n in there()) == ["settled_early", "settled_out"]
    session.unstage(early, out)
    session.unstage(early)
    assert not there()


def test_reach_of_all_roots(spark):
    """Shortest distances over diamonds, long chains and a cycle, against a plain walk from every id."""
    r = random.Random(3)
    edges = [(f"n{i}", f"n{r.randint(0, i - 1)}") for i in range(1, 40) for _ in range(r.randint(1, 2))] + [(f"c{i + 1}", f"c{i}") for i in range(33)]
    edges += [("x", "y"), ("y", "z"), ("z", "x"), ("n5", "z"), ("s", "s"), (None, "n1"), ("n1", None)]
    down = {}
    for child, parent in edges:
        if child and parent:
            down.setdefault(parent, set()).add(child)
            down.setdefault(child, set())
    want = set()
    for a in down:
        level, seen, d = {a}, {a: 0}, 0
        back = False
        while level:
            d += 1
            following = {c for x in level for c in down[x]}
            back |= a in following
            level = {c for c in following if c not in seen}
            seen |= {c: d for c in level}
        want |= {(a, i, n, back and i == a) for i, n in seen.items()}
    df = spark.createDataFrame(edges, "child string, parent string")
    assert {tuple(x) for x in O.ontology_reach(df).collect()} == want
    depth = {x["id"]: x["depth"] for x in O.ontology_depth(df.where("child IS NOT NULL AND parent IS NOT NULL"), "c0").collect()}
    assert depth == {f"c{i}": i for i in range(34)}
    assert O.ontology_reach(df.limit(0)).count() == 0


def test_streamed_log_equals_the_folded_one(spark, tmp_path):
    """Records in many files and out of order, nulls, a second run that goes on from the checkpoint."""
    from termloom.streaming import experiments

    r = random.Random(8)
    pick = lambda v: r.choice([None, v])
    rows = [(i, pick(f"t{i}"), r.choice(["a", "b", "c", None]), pick(f"n{i}"), None, pick("p"), pick((float(i), None, 1.0, pick(2.0), pick(float(-i)))),
        pick((pick("board"), pick(float(i)), None, None, None, None, pick(f"s{i}")))) for i in range(80)]
    r.shuffle(rows)
    log = spark.createDataFrame(rows, K.RECORD)
    state, out, log_in = (str(tmp_path / n) for n in ("state", "out", "in"))
    for k in (0, 1):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], K.RECORD).repartition(5).write.mode("append").json(log_in)
        experiments.fold_stream(experiments.stream_log(spark, log_in, 2), out, state).awaitTermination()
        part = spark.createDataFrame(rows[: 40 * k + 40], K.RECORD)
        assert sorted(map(repr, experiments.folded(spark, out).collect())) == sorted(map(repr, K.experiments_fold(part).collect()))
    assert log.count() == 80


def exchanges(df):
    """Shuffles in the plan, before it has run."""
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_texts_are_taken_apart_where_they_are_read(spark, monkeypatch):
    """Tokens, lines, candidates and n-grams made in the reading task are those of the tables of tokens, without an exchange of tokens."""
    r = random.Random(3)
    rows = [(f"p{i}", "".join(r.choice(["a", "B7", "é", " ", " - ", "\n", "😀", "cd"]) for _ in range(r.choice([0, 1, 5, 60])))) for i in range(60)]
    texts = spark.createDataFrame([*rows, ("null", None), ("mark", "?!")], "pmc_id string, text string").repartition(3).localCheckpoint()
    words = spark.createDataFrame([(p, len(p.split()), p.split()[0], f"H:{p}") for p in ("a", "a b7", "cd a a", "b7 b7 cd", "a a a a a a a a")],
        "phrase string, n_tokens int, first_token string, hpo_id string")
    tokens = R.tokenize(texts)
    assert exchanges(tokens) == 0 and exchanges(R.split_lines(texts)) == 0
    got = {(x["pmc_id"], x["start"]): (x["tok_idx"], x["token"], x["end"], x["run"], x["gap"]) for x in tokens.collect()}
    want = {}
    for p, t in rows:
        for k, m in enumerate(re.finditer("[A-Za-z0-9]+", t)):
            want[p, m.start()] = (k, m[0].lower(), m.end(), m[0], re.match("[^A-Za-z0-9]*", t[m.end() :])[0])
    assert got == want
    lines = [(p, k, len("\n".join([*t.split("\n")[:k], ""])), x) for p, t in rows + [("mark", "?!")] for k, x in enumerate(t.split("\n"))]
    assert sorted(map(tuple, R.split_lines(texts).collect())) == sorted(lines)
    found = R.text_candidates(texts, words)
    whole = found.collect()
    assert exchanges(R.text_candidates(texts, words)) == 0
    assert sorted(map(tuple, found.drop("text").collect())) == sorted(map(tuple, R.dictionary_candidates(tokens, words).collect()))
    with monkeypatch.context() as m:  # too many phrases for the tasks
        m.setattr(R, "BROADCAST_LIMIT", 100)
        assert sorted(map(tuple, R.text_candidates(texts, words).collect())) == sorted(map(tuple, whole))
    old, new = R.dictionary_match(texts, tokens, words), R.dictionary_match(texts, None, words)
    assert sorted(map(repr, new.collect())) == sorted(map(repr, old.collect())) and new.count()
    for most in (1, 4):
        grams = R.text_ngrams(texts, new, most)
        assert sorted(map(tuple, grams.collect())) == sorted(map(tuple, R.free_token_ngrams(tokens, old, most).collect()))
        for part in grams.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.collect_list(F.struct("pmc_id", "run_id", "start", "length"))).collect():
            by = {}
            for k, x in enumerate(part[1]):
                by.setdefault(x[0], []).append((k, tuple(x[1:])))
            assert all(v[-1][0] - v[0][0] == len(v) - 1 and [x for _, x in v] == sorted(x for _, x in v) for v in by.values())


def test_ordered_ngrams_are_selected_without_an_exchange(spark):
    r = random.Random(4)
    texts = spark.createDataFrame([(f"p{i}", " ".join(r.choice("abcdefg") for _ in range(80))) for i in range(12)], "pmc_id string, text string")
    grams = R.text_ngrams(texts, spark.createDataFrame([("p1", 3, 2), ("p2", 0, 1)], "pmc_id string, tok_idx int, n_tokens int"), 3)
    grams = grams.withColumn("place", F.pmod(F.xxhash64("text"), F.lit(50)))
    hits = spark.createDataFrame([(i, f"H{i}", f"n{i}", r.randint(1, 20) / 20) for i in range(50)], "place long, hpo_id string, name string, score double")
    plain = hits.join(grams.select("text", "place").distinct(), "place").drop("place")
    want = sorted(map(tuple, R.select_retrieved(grams.drop("place"), plain, [0.2, 0.7]).collect()))
    got = R.select_retrieved(grams, hits, [0.2, 0.7], "place", ordered=True)
    assert exchanges(got) == exchanges(grams) < exchanges(R.select_retrieved(grams.drop("place"), plain, [0.2, 0.7]))
    assert sorted(map(tuple, got.collect())) == want and want


def test_texts_give_what_is_selected_among_their_ngrams(spark):
    """Selection where the text is read takes what select_retrieved takes of all n-grams, and no n-gram leaves its task."""
    r = random.Random(5)
    parts = ["a", "Bc", "def", "9", "12ab", "é", "-", " ", "\n", " " * 70, "😀", "long" * 20]
    rows = [(f"p{i}", "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.choice([0, 1, 9, 90])))) for i in range(50)]
    texts = spark.createDataFrame([*rows, ("null", None), ("mark", "?!")], "pmc_id string, text string").repartition(3).localCheckpoint()
    matches = R.tokenize(texts).where("tok_idx % 7 = 3").select("pmc_id", "tok_idx", F.lit(1).alias("n_tokens")).localCheckpoint()
    for scores in ([k / 40 for k in range(40)][::-1], [r.choice([0.2, 0.4, 0.6, None]) for _ in range(40)], [None] * 40):
        hits = spark.createDataFrame([(i, f"H{i}", f"n{i}", x) for i, x in enumerate(scores)], "place long, hpo_id string, name string, score double")
        grams = R.text_ngrams(texts, matches).where(R.is_candidate(F.col("text")))
        placed = grams.withColumn("place", F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long") % 40)
        got = R.select_in_texts(texts, matches, hits, [0.3, 0.5], lambda data, starts, ends: md5_head(data, starts, ends) % 40)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.select_retrieved(placed, hits, [0.3, 0.5], "place").collect()))
        assert exchanges(got) == exchanges(grams) and got.count() or scores[0] is None
        assert "md5" not in got._jdf.queryExecution().executedPlan().toString()


def test_md5_of_many():
    r = random.Random(6)
    texts = [r.randbytes(n) for n in [*range(130), *r.choices(range(70), k=3000)]]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    want = [int(hashlib.md5(t).hexdigest()[:8], 16) for t in texts]
    assert md5_head(data, ends - [len(t) for t in texts], ends).tolist() == want
    assert md5_head(np.zeros(0, np.uint8), ends[:0], ends[:0]).tolist() == []


def test_territories_are_the_nearest_patients(spark):
    """Ties, anchors at one place, articles without anchors or patients, missing offsets: as nearest routes them."""
    r = random.Random(7)
    people = [(f"p{i}", k, f"P{k + 1}" if r.random() < 0.95 else None, [(r.choice([None, *range(0, 40, 3)]), 1, "t") for _ in range(r.choice([0, 1, 4]))])
        for i in range(40) for k in range(r.choice([0, 1, 3]))]
    people = spark.createDataFrame(people + [(None, 0, "P1", [(1, 1, "t")])], PATIENTS)
    asked = [(p, x, f"{p}-{x}", 1) for p in [*(f"p{i}" for i in range(40)), "none", None] for x in [None, *range(45)]]
    asked = spark.createDataFrame(asked, "pmc_id string, offset int, token string, level int")
    gold = spark.createDataFrame([("p1", "P1", "x;y"), ("p2", "P9", None)], ASSOC)
    want = {(x["pmc_id"], x["patient_id"], x["token"]): (0, 1) for x in A.nearest(asked, people).where("patient_id is not null").collect()}
    want |= {("p1", "P1", t): (1, 0) for t in ("x", "y", None)} | {("p2", "P9", None): (1, 0)}
    got = A.levelled_tokens(asked, people, gold)
    assert {tuple(x)[:3]: tuple(x)[3:] for x in got.collect()} == want and got.count() == len(want)


def test_scan_reads_what_was_retrieved_once_a_score(spark, people, tmp_path):
    """Places and documents are counted in one pass, patients micro and macro in one; scores are those of each threshold alone."""
    r = random.Random(8)
    rows = [(r.choice("pqr"), f"H{r.randint(0, 5)}", r.randint(0, 60), r.randint(1, 3), r.choice([0.2, 0.3, 0.45, 0.9])) for _ in range(60)]
    spark.createDataFrame(rows, "pmc_id string, hpo_id string, start int, length int, score double").write.parquet(str(tmp_path / "retrieved"))
    new, m = spark.read.parquet(str(tmp_path / "retrieved")), "pmc_id string, offset int, length int, identifier string, note string"
    matches = spark.createDataFrame([(r.choice("pqr"), r.randint(0, 60), r.randint(1, 3), r.choice(["H1", "H2;H3", "-1"]), r.choice([None, "NO"])) for _ in range(20)], m)
    gold_m = spark.createDataFrame([(x[0], x[2], x[3], x[1], None) for x in rows[::3]] + [tuple(x) for x in matches.collect()[::2]], m)
    gold = spark.createDataFrame([("p", "P1", "H1;H2"), ("p", "P2", None), ("q", "P1", "H3"), ("r", "P3", "H4")], ASSOC)
    articles = spark.createDataFrame([("p",), ("q",)], "pmc_id string")
    thresholds = [0.3, 0.5, 0.45]
    got = N.threshold_scan_recognition(matches, new, people, gold_m, gold, articles, thresholds)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 3  # of all tables what was retrieved alone is a file
    scores = {}
    for t in thresholds:
        at = new.where(F.col("score") >= t).select("pmc_id", F.col("start").alias("offset"), "length", F.col("hpo_id").alias("identifier"), F.lit(None).cast("string").alias("note"))
        pred = matches.unionByName(at)
        routed = A.nearest(pred.select("pmc_id", "offset", "identifier"), people).where("patient_id is not null").select("pmc_id", "patient_id", "identifier")
        scores[t] = (sum(x[4] >= t for x in rows), *E.score_total(gold_m, pred, articles, gold, routed).first())
    assert {x["threshold"]: tuple(x)[1:-1] for x in got.collect()} == {t: pytest.approx(v, abs=1e-9) for t, v in scores.items()}
    assert [x["threshold"] for x in got.collect() if x["best"]] == [max(thresholds, key=lambda t: (round(scores[t][-1], 9), -t))]


def test_mentions_take_their_columns_along(spark, people):
    """Routing and sections put mentions through one exchange, with all their columns, also where numbers repeat."""
    m = spark.createDataFrame([("p", 1, 3, "x"), ("p", 1, 900, "y"), ("none", 2, 5, None)], "pmc_id string, ent_idx int, offset int, text string")
    segments = spark.createDataFrame([("p", 0, 0, "abcdef", "TITLE")], "pmc_id string, seg_idx int, offset int, text string, section_type string")
    routed, placed = A.nearest(m, people), A.section_lookup(m, segments)
    assert exchanges(routed) == 1 and "Join" not in routed._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["pmc_id"], r["ent_idx"], r["offset"], r["text"] or "") for r in routed.collect()) == [("none", 2, 5, ""), ("p", 1, 3, "x"), ("p", 1, 900, "y")]
    assert sorted((r["offset"], r["text"] or "", r["section"]) for r in placed.collect()) == [(3, "x", "TITLE"), (5, "", "?"), (900, "y", "?")]


def associations(spark):
    """Gold, base and model with shared, missing and null patients, compounds, and an article that only the model has."""
    rows = lambda x: spark.createDataFrame(x, "pmc_id string, patient_id string, identifier string")
    gold = rows([("a", "P1", "x;y"), ("a", "P2", None), ("a", "P3", "z"), ("b", "P1", "x"), ("b", "P2", "y"), ("c", None, "x"), ("d", "P1", None)])
    base = rows([("a", "P1", "x"), ("a", "P2", "z"), ("a", "P3", "z"), ("b", "P1", "x"), ("b", "P9", "y"), ("c", None, "x"), ("d", "P1", None)])
    model = rows([("a", "P1", " y ;z"), ("a", "P2", None), ("a", "P3", None), ("b", "P1", "x"), ("b", "P2", "x"), ("e", "P1", "x"), ("d", "P1", None), (None, "P1", "x")])
    return gold, base, model


def exchanges(df):
    """Exchanges of rows by key in the plan, without the last sums' into one task."""
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_fusion_compare_is_what_the_scores_give(spark):
    gold, a, b = associations(spark)
    pred = {"A": a, "B": b, **{how: A.fuse(a, b, how).withColumnRenamed("token", "identifier") for how in ("intersect", "union")}}
    want = {v: (E.score_micro(gold, p).first()["f1"], E.score_macro(gold, p).first()["f1"]) for v, p in pred.items()}
    got = A.fusion_compare(gold, a, b)
    assert {r["variant"]: pytest.approx((r["f1_micro"], r["f1_macro"])) for r in got.collect()} == want
    assert exchanges(got) <= 2  # by article, and the four sums


def test_deltas_come_from_one_exchange(spark):
    gold, base, model = associations(spark)
    keys = ["pmc_id", "patient_id"]
    b, m = (E.per_patient(gold, p).select(*keys, "tp", "fp", "fn", "f1") for p in (base, model))
    want = {tuple(r) for r in b.select(*keys, (F.col("tp") + F.col("fn")).alias("n"), F.col("f1").alias("x")).join(m.select(*keys, F.col("f1").alias("y")), keys).collect()}
    got = D.patient_delta(gold, base, model)
    assert {tuple(r)[:5] for r in got.collect()} == want and exchanges(got) == 1
    for df in (D.miss_extra(gold, base, model), D.miss_destination(gold, base, model)):
        assert exchanges(df) == 1
    assert D.miss_extra(gold, base, model).first().asDict() == {"missed": 3, "extra": 2, "zeroed": 1, "rescued": 1}
    assert {tuple(r) for r in D.miss_destination(gold, base, model).collect()} == {("a", "P1", "x", "to_none"), ("a", "P3", "z", "to_other"), ("b", "P2", "y", "to_lost")}
    worst = D.worst_patients(gold, base, model, 2).collect()
    assert [(r["pmc_id"], r["patient_id"], r["gold"], r["base"], r["model"], r["missed"], r["extra"]) for r in worst] == [
        ("a", "P3", ["z"], ["z"], [], ["z"], []), ("a", "P1", ["x", "y"], ["x"], ["y", "z"], ["x"], ["z"])]


def test_answers_are_dealt_before_they_are_sorted(spark):
    """Lines are many in few bytes: a task that reads them sorts none."""
    text = "1: P2\n1: P1\n2: P9\n3: P2\n9: P1\n2 P1"
    answers = spark.createDataFrame([("p", text), (None, text), ("q", text)], "pmc_id string, response string")
    m = spark.createDataFrame([("p", 0), ("p", 1), ("p", 2), (None, 0)], "pmc_id string, ent_idx int")
    people = spark.createDataFrame([("p", "P1"), ("p", "P2"), ("q", "P1")], "pmc_id string, patient_id string")
    given, counted = A.parse_answers(answers, m, people)
    assert {tuple(r) for r in given.collect()} == {("p", 0, "P1"), ("p", 2, "P2")}
    assert [tuple(r) for r in counted.collect()] == [("p", 4)]
    assert exchanges(given) == 1 and exchanges(counted) == 1


def test_split_ids_as_they_are_and_with_odd_spaces(spark):
    for x, want in {"HP:1": ["HP:1"], "a\n": ["a"], " a": ["a"], "": [], ";": [], "a;b": ["a", "b"], "-1": ["-1"], "a b": ["a b"]}.items():
        assert column(spark, T.split_ids(F.col("x")), x=x) == want


def test_patients_write_no_texts(spark, tmp_path):
    from termloom.plans.fixtures import Fixtures

    text = "case one\nand its son"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    f = Fixtures(spark, str(tmp_path))
    assert [len(r["mentions"]) for r in f.patients().orderBy("roster_idx").collect()] == [1, 1] and "segments" not in f.kept


def test_split_ids_is_compiled(spark):
    """Splitting is part of the generated code, also under explode, and gives the stripped parts that are not empty."""
    r = random.Random(9)
    texts = [None, "", *("".join(r.choices(["a", "B1", ";", " ", "\t", "\n", "\u00a0", "\u2003", "é", "-1"], k=r.randint(0, 9))) for _ in range(2000))]
    ids = spark.createDataFrame(list(enumerate(texts)), "i long, c string")
    each = ids.select("i", F.explode(T.split_ids(F.col("c"))).alias("token"))
    assert re.search(r"\*\(\d+\) Generate", each._jdf.queryExecution().executedPlan().toString())
    parts = F.filter(F.transform(F.split("c", ";"), T.strip), lambda x: x != "")
    want = {x["i"]: x["p"] or [] for x in ids.select("i", parts.alias("p")).collect()}
    assert {x["i"]: x["p"] for x in ids.select("i", T.split_ids(F.col("c")).alias("p")).collect()} == want
