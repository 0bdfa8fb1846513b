"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib
import random
import warnings
import zlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.llm import additive, byte_bpe, chunk_dedup, components, divergence, kd_search, language_id, packing, pseudonyms, quality_additive, sampling
from termloom.llm import setsketch, suffix_dedup, threshold_clusters, url_reputation, word_quality
from termloom.llm import queries as Q
from termloom.llm.textual import utf8

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path
WORDS = [f"w{i:x}q" for i in range(4000)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n))


def hard_texts():
    passage = prose(1, 60)
    return [
        (0, None), (1, ""), (2, " \n\t"), (3, "word"), (4, "a b"), (5, prose(2, 80)), (6, prose(2, 80)), (7, prose(3, 40) + " " + passage + " " + prose(4, 40)),
        (8, prose(5, 30) + " " + passage + " " + prose(6, 50)), (9, "é" * 300), (10, "é" * 301), (11, "na na " * 200), (12, "x" * 5000),
            (13, prose(7, 9000)), (14, "12345 678 !!"), (15, "a  b   c\n\n d  "),
        (16, "emoji 😀 " * 30), (None, prose(8, 50)), (17, prose(9, 50)), (17, prose(9, 50)),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in hard_texts()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def known(rows):
    return [(i, t) for i, t in rows if i is not None]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.B.net", "HTTP://X.net/a?b#c", "http://e.net/en/x", "http://m.example.net/en/1", "a://b://c/d",
        "http://h.org/fr/", "http://h.org?q=/fr/", "http://É.com/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, None, "y")], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(0, True), (4, False), (4, False), (None, True), (5, None)], "page_id long, good boolean")
    for known_outcomes in (outcomes, outcomes.limit(0)):
        got = url_reputation.judge_urls(pages, known_outcomes, Q.RULES).collect()
        assert len(got) == len(urls) + 1
        for r in got:
            host, path, rule = brute.op1(urls[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0]) and r["verdict"] in ("allow", "block")
    assert url_reputation.judge_urls(pages.limit(0), outcomes, Q.RULES).count() == 0


def test_reputation_shrinks(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 40 else 'good'}.d{i % 7}.com/{i}") for i in range(80)] + [(80, "http://new.d1.com/")],
        "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i >= 40) for i in range(80)], "page_id long, good boolean")
    lower = {r["host"]: r["lower"] for r in url_reputation.judge_urls(pages, outcomes, []).collect()}
    assert lower["bad.d1.com"] < lower["new.d1.com"] < lower["good.d1.com"]


def test_reputation_blocks_and_leaves_own_outcomes_out(spark):
    """A host of bad outcomes is blocked; its domain's other host has them as a prior, and a host alone in its domain only its suffix's."""
    hosts = ["bad.one.com"] * 60 + ["bad2.one.com"] * 2 + ["good.two.com"] * 60 + ["alone.org"] * 30
    pages = spark.createDataFrame([(i, f"http://{h}/{'x' * (20000 if i == 0 else 1)}") for i, h in enumerate(hosts)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, h.startswith("good") or h == "alone.org") for i, h in enumerate(hosts) if h != "bad2.one.com"],
        "page_id long, good boolean")
    got = {r["host"]: r for r in url_reputation.judge_urls(pages, outcomes, []).collect()}
    assert {h: r["verdict"] for h, r in got.items()} == {"bad.one.com": "block", "bad2.one.com": "block", "good.two.com": "allow", "alone.org": "allow"}
    assert got["bad2.one.com"]["n_labelled"] == 0 and got["bad2.one.com"]["lower"] < 0.2
    suffix = {r["host"]: r["lower"] for r in url_reputation.judge_urls(pages, outcomes, [], suffixes=("one.com",)).collect()}
    assert suffix["bad2.one.com"] != got["bad2.one.com"]["lower"]
    parts = pages.select("page_id", url_reputation.host_of(pages["url"]).alias("host"))
    # the only host of its domain and suffix: the prior is the corpus rate
    alone = next(r for r in url_reputation.host_reputation(parts, outcomes).collect() if r["host"] == "alone.org")
    assert alone["rate"] < 1 and alone["n_good"] == alone["n_labelled"] == 30


def test_pseudonyms(spark, docs, empty):
    cases = ["4417744280351547", "4417-7442-8035-1547", "9807915762804490", "+1 (743) 555-3824", "743-555-3824", "97.51.17.173", "999.1.1.1",
        "1984-02-29", "02/29/1984", "2023-02-31", "123-45-6789", "666-12-3456", "DE89 3704 0044 0532 0130 00", "DE00370400440532013000",
        "und.34@mail7.example.com"]
    rows = pseudonyms.pseudonymise(spark.createDataFrame([(i, f"<{c}> and <{c}>") for i, c in enumerate(cases)], "doc_id long, text string"), "k").collect()
    new = {}
    for r in rows:
        a, b = r["text"].split(" and ")
        assert a == b
        new[cases[r["doc_id"]]] = a[1:-1]
    kept = {"9807915762804490", "999.1.1.1", "2023-02-31", "666-12-3456", "DE00370400440532013000"}
    for old, now in new.items():
        assert (now == old) == (old in kept), old
        assert "." in old or len(now) == len(old) and [c.isdigit() for c in now] == [c.isdigit() for c in old]
    assert new["4417744280351547"] == new["4417-7442-8035-1547"].replace("-", "")
    assert new["+1 (743) 555-3824"][4:7] == new["743-555-3824"][:3]
    iban = new["DE89 3704 0044 0532 0130 00"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    digits = [int(c) for c in new["4417744280351547"]]
    assert sum(sum(divmod(2 * d, 10)) if k % 2 == 0 else d for k, d in enumerate(digits)) % 10 == 0
    out = pseudonyms.pseudonymise(docs, "k")
    assert out.columns[:5] == docs.columns and out.count() == docs.count()
    assert pseudonyms.pseudonymise(empty, "k").count() == 0


def test_pseudonyms_of_phones(spark):
    """Grouped and unbroken phones of other countries, and a bracket without a separator; equal ones stay equal."""
    cases = ["(743)555-3824", "+1(743)555-3824", "743-555-3824", "+44 20 7946 0958", "+442079460958", "+33 1 23 45 67 89", "+33.1.23.45.67.89",
        "+6591234567", "+65 9123 4567", "+4721234567", "+44 (0)20 7946 0958"]
    left = ["+1234567", "+12345678901234567", "12 345 678"]
    rows = pseudonyms.pseudonymise(spark.createDataFrame([(i, f"call {c}, or not") for i, c in enumerate(cases + left)], "doc_id long, text string"),
        "k").collect()
    new = {(cases + left)[r["doc_id"]]: r["text"][5:-8] for r in rows}
    assert {c: r["n_phone"] for c, r in zip(cases + left, sorted(rows, key=lambda r: r["doc_id"]))} == {**dict.fromkeys(cases, 1), **dict.fromkeys(left, 0)}
    for old, now in new.items():
        assert (now == old) == (old in left) and [c.isdigit() or c for c in now] == [c.isdigit() or c for c in old], old
    digits = lambda c: "".join(filter(str.isdigit, new[c]))
    assert digits("(743)555-3824") == digits("743-555-3824") == digits("+1(743)555-3824")[1:]
    assert digits("+44 20 7946 0958") == digits("+442079460958") and digits("+6591234567") == digits("+65 9123 4567") and digits("+33 1 23 45 67 89") == digits("+33.1.23.45.67.89")
    assert new["+6591234567"].startswith("+65") and new["+44 20 7946 0958"].startswith("+44 ")
    rows = pseudonyms.pseudonymise(spark.createDataFrame([(0, "+6591234567 2024-01-02")], "doc_id long, text string"), "k").collect()
    assert (rows[0]["n_phone"], rows[0]["n_date"]) == (1, 1)


def test_feistel_is_a_permutation(spark):
    got = spark.range(378 * 11).selectExpr(f"{pseudonyms.feistel('id div 11', 'id % 11', '378', '11', 'k', 't')} AS p").distinct().count()
    assert got == 378 * 11
    five = spark.range(1000).selectExpr(f"{pseudonyms.permuted_digits("lpad(id, 3, '0')", 'k', 't')} AS p").collect()
    assert len({r["p"] for r in five}) == 1000 and all(len(r["p"]) == 3 for r in five)


def test_chunks(spark, docs, empty):
    out = {}
    for r in chunk_dedup.dedup(docs).collect():
        out.setdefault(r["doc_id"], r)
    text = dict(hard_texts())
    assert out[5]["text"] == text[5] and out[6]["text"] == "" and out[0]["text"] is None and out[1]["text"] == ""
    assert out[7]["n_removed"] == 0 and out[8]["n_removed"] > 150 and out[13]["n_removed"] == 0
    assert out[None]["text"] == text[None] and out[17]["text"] == text[17]
    assert chunk_dedup.dedup(docs).count() == docs.count() and chunk_dedup.dedup(empty).count() == 0
    r = random.Random(5)
    base = prose(20, 3000)
    moved = base[:5000] + "inserted " + base[5000:]
    got = chunk_dedup.dedup(spark.createDataFrame([(1, base, [1]), (2, moved, [2])], "doc_id long, text string, spans array<int>")).orderBy("doc_id").collect()
    assert got[0]["n_removed"] == 0 and len(got[1]["text"]) < 1200 and r


def test_gear_is_the_plain_recurrence():
    data = np.frombuffer(prose(30, 50).encode(), np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunk_dedup.gear(data, np.array([0, len(data)])).tolist() == want


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH("byte_bpe_50k.json"))
    rows = hard_texts() + [(90, "before <|endoftext|> after")]
    df = spark.createDataFrame([(i, x, 7) for i, x in rows], "doc_id long, text string, length int")
    got = packing.pack(df, PATH("byte_bpe_50k.json"), PATH("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    cells = got.collect()
    key = lambda p: (p[0] is None, p)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"]) for r in cells),
        key=lambda p: str(p)) == sorted(((i, *p[:3]) for i, x in rows for p in brute.op4_pieces(x, t)), key=lambda p: str(p)) and key
    joined = packing.sequences(got).collect()
    assert sum(r["n_tokens"] for r in joined) == sum(r["length"] for r in cells) and all(len(r["ids"]) == 4 * r["n_tokens"] <= 4096 for r in joined)
    assert packing.pack(empty, PATH("byte_bpe_50k.json"), PATH("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_packing_places_pieces_without_further_python_workers(spark, docs, monkeypatch):
    """The plan of runs must not become an RDD of Python rows: that starts a second set of workers beside the first."""

    def refused(*a, **b):
        raise AssertionError("rows were sent through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    got = packing.pack(docs, PATH("byte_bpe_50k.json"), PATH("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_added_tokens_without_the_tokenizer():
    want = [t.content for t in brute_tokenizer().get_added_tokens_decoder().values()]
    assert want and sorted(packing.added_tokens(PATH("byte_bpe_50k.json"))) == sorted(want)


def test_pipeline_batches_are_small(spark, empty):
    """40 rows of 1 MB reach a Python worker a few MB at a time after any stage; a session's own setting stays."""
    name = corpus_pipeline.BATCH_SETTING
    before = spark.conf.getAll.get(name)
    rows = spark.range(40).repartition(1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = lambda: [r["n"] for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()]
    try:
        for stage_name, function in corpus_pipeline.STAGES:
            if stage_name != "pii":  # runs no Python
                spark.conf.unset(name)
                function(spark, empty, None)
                assert max(sizes()) <= 6 << 20
        spark.conf.set(name, "16m")
        corpus_pipeline.STAGES[0][1](spark, empty, None)
        assert spark.conf.get(name) == "16m"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_sequences(seed):
    r = random.Random(seed)
    counts = {length: r.choice([0, 1, 2, 5, 40, 1000]) for length in range(1, 1025)}
    used, ranks = {}, {}
    for length, first, end, start, offset, each in packing.plan(counts, 1024):
        assert ranks.get(length, 0) == first
        ranks[length] = end
        for k in range(end - first):
            used.setdefault(start + k // each, []).append((offset + k % each * length, length))
    assert ranks == {k: v for k, v in counts.items() if v}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    bound = max(sum(k * v for k, v in counts.items()) / 1024, sum(v for k, v in counts.items() if k > 512))
    assert len(used) <= 1.02 * bound + 2


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist(), "x") for i in range(700)] + [(1000 + i, [0.5] * 8, "x") for i in range(300)]
    rows += [(None, [1.0] * 8, "x"), (1, None, "x"), (50, [float("nan")] * 8, "x"), (1400, [None] + [1.0] * 7, "x"), (1450, [1e6] * 8, "x")]
    rows = [x for x in rows if x[0] not in (1, 50) or x[1] is None or x[1][0] != x[1][0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string")
    for shard in (16, 64, 1 << 15):
        got = sorted((q["query_id"], q["rank"], q["vec_id"], q["score"])
            for q in kd_search.top_k(df, df.where("vec_id % 50 = 0"), 5, shard_rows=shard, block_rows=7).collect())
        assert got == brute.op5([x[:2] for x in rows])
    doubled = sorted((q["query_id"], q["rank"], q["vec_id"], q["score"])
        for q in kd_search.top_k(df.union(df), df.union(df).where("vec_id % 50 = 0"), 5).collect())
    assert doubled == brute.op5([x[:2] for x in rows])
    assert kd_search.top_k(df.limit(0), df.limit(0)).count() == 0
    assert kd_search.top_k(df.limit(1), df.limit(1)).count() == 0


def test_components_too_large_for_a_long(spark):
    """Near the limit scores are exact; over it there is an error, not a wrong score."""
    rows = lambda x: spark.createDataFrame([(i, [x, float(i)]) for i in range(60)], "vec_id long, embedding array<double>")
    got = kd_search.top_k(rows(2.0**21), rows(2.0**21).where("vec_id = 0")).collect()
    assert {r["score"] for r in got} == {2**58} and [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
    for x in (2.0**40, 2.0**60, -1e300):
        with pytest.raises(Exception, match="may not fit into a long"):
            kd_search.top_k(rows(x), rows(x).where("vec_id = 0")).collect()


def test_trees_are_numbered_without_gaps(spark):
    rows = spark.range(0, 1000, 1, 7).selectExpr("(cast(spark_partition_id() as long) << 32) + id % 3 AS shard").where("shard >> 32 <> 2").distinct()
    assert sorted(r["cell"] for r in kd_search.dense(rows, "shard", "cell").collect()) == list(range(18))


def test_near_duplicates(spark, docs, empty):
    want = brute.op6(known(hard_texts()), 2)
    got = setsketch.near_duplicates(docs, 2).collect()
    assert len(got) == docs.count() and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert setsketch.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups(spark, size):
    """A large group of copies that differ from each other about as much as the limit allows."""
    r, base, rows = random.Random(4), prose(40, 200).split(), []
    for i in range(260):
        w = base[:]
        for k in r.sample(range(len(w)), r.choice([0, 2, 4, 6, 8])):
            w[k] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(50 + i, 120)) for i in range(60)]
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute.op6(rows, size)


def test_near_group_of_many_blocks(spark, monkeypatch):
    """A bucket of several blocks by its number of classes, all just about the limit, and one by the bytes of its very long texts."""
    r, base, rows = random.Random(14), prose(41, 60).split(), []
    for i in range(700):
        w = base[:]
        for k in r.sample(range(len(w)), r.choice([3, 4, 5])):
            w[k] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    long = [f"x{i}" for i in range(700_000)]
    for i in range(4):
        w = long[:]
        for k in r.sample(range(len(w)), 70_000 if i else 0):
            w[k] = f"y{i}"
        rows.append((5000 + i, " ".join(w)))
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1 + 1).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute.op6(rows, 2)


def test_rows_that_share_an_id_are_linked(spark):
    rows = [(1, prose(1, 50)), (5, prose(1, 50)), (5, prose(2, 50)), (7, prose(2, 50)), (7, prose(3, 50)), (9, prose(3, 50)), (11, prose(4, 50))]
    got = {r["doc_id"]: r["component_id"] for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 1, 11: 11}


def test_columns_with_the_operators_own_names(spark):
    names = ["doc", "_doc", "own", "_own", "found", "_found", "new", "_new", "_text", "body", "_body", "letter", "_letters", "n_removed", "spans"]
    rows = [(i, prose(i % 3, 60) + " x@y.org", "en", *range(len(names))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` long" for n in names))
    kept = [n for n in names if n not in ("n_removed", "spans")]
    cut = chunk_dedup.dedup(df)
    assert cut.count() == 12 and cut.columns == ["doc_id", "text", "lang", *kept, "n_removed", "spans"]
    hidden = pseudonyms.pseudonymise(df, "k")
    assert hidden.columns == [*df.columns, *(f"n_{k}" for k in pseudonyms.KINDS)]
    told = language_id.identify(df, language_id.fit(df), df.columns)
    assert told.columns == [*df.columns, "lang_pred", "score", "rejected"]
    for out in (cut, hidden, told):
        assert {tuple(r[n] for n in kept) for r in out.collect()} == {tuple(names.index(n) for n in kept)}
    assert all(r["n_email"] == 1 and "x@y.org" not in r["text"] for r in hidden.collect())


def test_pseudonyms_are_one_to_one(spark):
    """Every network permutes its values: dates of all years, all names of two letters and of one, SSNs, IPs and phones with shared parts."""
    import datetime

    begin = datetime.date(1600, 1, 1)
    values = {
        "date": [(begin + datetime.timedelta(k)).isoformat() for k in range(0, 292194, 7)],
        "email": [f"{a}{b}@x.org" for a in "abcdefghijklmnopqrstuvwxyz" for b in ["", *"abcdefghijklmnopqrstuvwxyz"]],
        "ssn": [f"{a:03d}-{b:02d}-0001" for a in (*range(1, 666), *range(667, 900)) for b in (1, 50, 99)],
        "ip": [f"10.0.{a}.{b}" for a in range(256) for b in range(0, 256, 8)],
        "phone": [f"+1 (743) 555-{n:04d}" for n in range(0, 10000, 3)],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs]
    new = {}
    for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "kind string, text string").repartition(8), "k").collect():
        assert r[f"n_{r['kind']}"] == 1
        new.setdefault(r["kind"], []).append(r["text"])
    for k, vs in values.items():
        assert len(set(new[k])) == len(vs) == len(new[k])
    assert sorted(x for x in new["email"] if len(x) == 7) == sorted(x for x in values["email"] if len(x) == 7)
    p = brute.Pseudonyms("k")
    assert len({p.card(c) for c in cards()}) == len(cards()) and len({p.iban(c) for c in ibans()}) == len(ibans())
    same = pseudonyms.pseudonymise(spark.createDataFrame([(c,) for c in (*cards(), *ibans())], "text string"), "k").collect()
    assert {r["text"] for r in same} == {p.card(c) for c in cards()} | {p.iban(c) for c in ibans()}
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise(spark.createDataFrame(rows[:1], "kind string, text string"), "")


def cards():
    numbers = [f"4539{n:011d}" for n in range(0, 3000, 7)]
    return [d + next(c for c in "0123456789" if brute.Pseudonyms.luhn(d + c)) for d in numbers]


def ibans():
    bodies = [f"37040044{n:010d}" for n in range(0, 3000, 11)]
    return [f"DE{98 - int(b + '131400') % 97:02d}{b}" for b in bodies]


def test_estimate():
    r, out = np.random.default_rng(1), []
    for j in (0.3, 0.6, 0.8, 0.95):
        a = r.integers(0, 2**63, 1000, dtype=np.uint64)
        same = int(2000 * j / (1 + j))
        b = np.concatenate([a[:same], r.integers(0, 2**63, 1000 - same, dtype=np.uint64)])
        s = setsketch.registers(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 1000, 2000]))
        out.append(abs(float(setsketch.likely(s[:1], s[1:], np.array([1000.0]), np.array([1000.0]))[0]) - j))
    assert max(out) < 0.17
    merged = setsketch.registers(np.sort(np.concatenate([a, b])), np.array([0, 2000]))
    assert (merged[0] == np.maximum(s[0], s[1])).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    for many in (components.MANY, 0):
        got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long"), many=many).collect()}
        assert got == {x: find(x) for x in parent if any(a != b and x in (a, b) for a, b in edges)}


def test_quality(spark, docs, empty):
    labelled = spark.createDataFrame([(i, prose(i, 60), 1) for i in range(60)] + [(100 + i, " ".join(f"{w}%%%" for w in prose(i, 60).split()), 0)
        for i in range(60)], "doc_id long, text string, quality int")
    got = {r["doc_id"]: r for r in word_quality.judge(docs, labelled).collect()}
    for i, t in known(hard_texts()):
        want = brute.op7(t)
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
    assert got[5]["kept"] and not got[3]["kept"]
    scores = {r["doc_id"]: r["quality"] for r in word_quality.judge(labelled, labelled).collect()}
    assert min(v for k, v in scores.items() if k < 100) > max(v for k, v in scores.items() if k >= 100)
    assert word_quality.judge(empty, labelled).count() == 0 and word_quality.judge(docs, labelled.limit(0)).count() == docs.count()


def test_language(spark, docs, empty):
    texts = {"xx": "alpha beta gamma delta epsilon", "yy": "uno dos tres cuatro cinco seis"}
    rows = [(i, " ".join(random.Random(i).choices(texts[k].split(), k=30)), k) for k in texts for i in range(0 if k == "xx" else 100, 40 if k == "xx" else 140)]
    labelled = spark.createDataFrame([*rows, (900, None, "xx"), (901, "alpha", None)], "doc_id long, text string, lang string")
    model = language_id.fit(labelled)
    got = {r["doc_id"]: r for r in language_id.identify(labelled, model).collect()}
    assert all(got[i]["lang_pred"] == k and not got[i]["rejected"] for i, _, k in rows) and got[900]["lang_pred"] == "und"
    other = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert other[14]["lang_pred"] == "und" and other[0]["rejected"] and other[12]["rejected"] and len(other) == 19
    assert language_id.fit(labelled.limit(0)) is None and language_id.identify(empty, None).count() == 0


def test_language_rejects_long_texts(spark, sf_dir):
    """Texts in no learned language are rejected at every length, and clean short ones of a learned one stay."""
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    r = random.Random(5)
    alphabets = ("abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x3B1, 0x3CA))))
    foreign = [" ".join("".join(r.choices(a, k=r.randint(2, 9))) for _ in range(n)) for a in alphabets for n in (100, 200, 1000, 5000)]
    foreign += [s * n for n in (1, 10) for s in ("Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. ", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem. ")]
    model = language_id.fit(known)
    got = language_id.identify(spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string"), model).collect()
    assert [r["doc_id"] for r in got if not r["rejected"]] == []
    short = language_id.identify(known.where("n_chars BETWEEN 100 AND 400"), model)
    assert short.where("NOT rejected").count() >= 0.95 * short.count() > 0


def test_language_of_few_rows(spark):
    """A language with 3 rows of 603 is learned from a sample too, and new texts of it and of the large one stay."""
    r = random.Random(7)
    words = {k: ["".join(r.choices(a, k=r.randint(2, 7))) for _ in range(150)] for k, a in (("aa", "abcdefghij"), ("zz", "qrstuvwxyz"))}
    text = lambda k, n: " ".join(r.choices(words[k], k=n))
    rows = [(i, text("aa", r.randint(20, 120)), "aa") for i in range(600)] + [(600 + i, text("zz", 60), "zz") for i in range(3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=60)
    new = [(i, text("zz" if i % 2 else "aa", r.randint(20, 120))) for i in range(200)]
    got = language_id.identify(spark.createDataFrame(new, "doc_id long, text string"), model).collect()
    assert all(r["lang_pred"] == ("zz" if r["doc_id"] % 2 else "aa") for r in got)
    assert sum(r["rejected"] for r in got if r["doc_id"] % 2) == 0 and sum(r["rejected"] for r in got) <= 2
    few = language_id.fit(spark.createDataFrame(rows[-3:], "doc_id long, text string, lang string"))
    assert language_id.fit(spark.createDataFrame(rows[-1:], "doc_id long, text string, lang string")) is not None
    assert not any(r["rejected"] for r in language_id.identify(spark.createDataFrame(new[1::2], "doc_id long, text string"), few).collect())


def test_sample_thresholds():
    for n in (2001, 10**6, 10**12, 10**18):
        wanted = sampling.threshold_of(2000, n) / sampling.SCALE * n
        assert 2000 <= wanted < 2400


def test_rare_language_has_rows_at_any_size():
    sizes = {"big": 10**12, "rare": 300}
    bounds = language_id.bounds(sizes, 2000)
    assert bounds["rare"] == 300 and (1 << 62) * bounds["big"] // sizes["big"] > 0


def test_language_sample_bounds():
    assert language_id.bounds({"a": 10**9, "b": 700, "c": 3}, 2000) == {"a": 1297, "b": 700, "c": 3}
    assert language_id.bounds({str(i): 100 for i in range(100)}, 2000) == {str(i): 20 for i in range(100)}
    assert language_id.bounds({"a": 10**9, "b": 10**9, "c": 3}, 60) == {"a": 28, "b": 29, "c": 3}
    assert language_id.bounds({}, 2000) == {}


@pytest.mark.parametrize("kind", ["null ids", "one id", "many languages"])
def test_samples_are_bounded(spark, monkeypatch, kind):
    """What reaches the driver is never more than max_rows rows, and no row without an id is lost to the sample."""
    ids = {"null ids": "CAST(NULL AS LONG)", "one id": "IF(id < 4000, 7, id)", "many languages": "id"}[kind]
    lang = "concat('l', id % 1000)" if kind == "many languages" else "IF(id % 2 = 0, 'aa', 'bb')"
    rows = spark.range(8000).selectExpr(f"{ids} AS doc_id", "concat('text ', id, IF(id % 2 = 0, ' even', ' odd')) AS text", f"{lang} AS lang", "CAST(id % 2 AS INT) AS quality")
    got, plain, coalesce = [], type(rows).toArrow, type(rows).coalesce
    monkeypatch.setattr(type(rows), "toArrow", lambda df: got.append(plain(df)) or got[-1])
    monkeypatch.setattr(type(rows), "coalesce", lambda df, n: got.append(plain(df)) or coalesce(df, n))  # what one task learns from
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        model = language_id.fit(rows, max_rows=600)
    assert len(set(model.languages)) == (32 if kind == "many languages" else 2)
    assert word_quality.train(rows, max_rows=600, iterations=5) and quality_additive.train(rows, max_rows=600, cycles=2)
    assert len(got) == 3 and all((250 if kind == "many languages" else 550) <= len(t) <= 600 for t in got)


def test_sample_is_the_same_in_every_division(spark):
    """Of an id with many texts the same one is drawn, however rows are dealt."""
    rows = spark.range(300).selectExpr("id % 30 AS doc_id", "concat('w', id, ' v', id * 7 % 11) AS text", "CAST(id % 2 AS INT) AS quality")
    a, b = (quality_additive.train(rows.repartition(n), cycles=2) for n in (1, 7))
    assert all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_repeated_strings(spark, docs, empty):
    rows = known(hard_texts())
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
        for r in suffix_dedup.dedup(docs).collect() if r["doc_id"] is not None]
    once = [x for x in rows if x[0] != 17]
    want = brute.op9(once)
    assert sorted(x for x in got if x[0] != 17) == sorted((d, *v) for d, v in want.items())
    assert all(x[2] == x[1] for x in got if x[0] == 17)
    assert suffix_dedup.dedup(empty).count() == 0


def removed_runs(rows):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in rows.collect()}


@pytest.mark.parametrize("members", [suffix_dedup.MEMBERS, 20, 1])
def test_repeated_strings_many_surroundings(spark, members):
    """Many different surroundings of one passage, cut at different places; with few members a task, buckets are split down to single strings."""
    passage = prose(60, 40)
    rows = [(i, prose(100 + i, 30) + passage[i % 40 :] + prose(300 + i, 30)) for i in range(90)]
    got = removed_runs(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), members=members))
    assert got == brute.op9(rows)


@pytest.mark.parametrize(("length", "gram"), [(200, 8), (200, 128), (60, 32), (40, 16)])
def test_repeated_strings_lengths(spark, length, gram):
    rows = [(i, prose(20 + i, 30) + prose(i % 3, 12) + prose(50 + i, 9)) for i in range(40)]
    assert removed_runs(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), length, gram)) == brute.op9(rows, length)


def test_repeated_strings_very_long_texts(spark):
    """Passages over the borders of segments, in a text and in another one, and a run of one character."""
    r, size = random.Random(4), suffix_dedup.SEGMENT
    long = "".join(r.choices("abcdefghijklmnop ", k=2 * size + 5000))
    passage, short = long[size - 150 : size + 250], "".join(r.choices("qrstuvwxyz ", k=500))
    rows = [(1, long), (2, short + passage), (3, "z" * (size + 3000)), (4, None)]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]]
        for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(size - 150, size + 250)], 2: [(500, 900)], 3: [(0, size + 3000)], 4: []}


@pytest.mark.parametrize("part", [1 << 20, 1000])
def test_repeated_strings_of_periodic_texts_and_copies(spark, monkeypatch, part):
    """Every place of a periodic text is marked, every copy of a row as well: equal and neighbouring marks become one before a text's are put together."""
    monkeypatch.setattr(suffix_dedup, "PART", part)
    rows = [(1, "a" * 400_000), (2, "ab" * 150_000), (3, prose(11, 100)), (4, prose(12, 60) + " " + "xyz" * 1000)]
    rows += [(5, prose(13, 70))] * 1500
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.dedup(texts)
    seen = {(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"])) for r in got.select("doc_id", "n_bytes", "n_removed", "spans").collect()}
    size = {i: len(t) for i, t in rows}
    assert {x for x in seen if x[0] != 4} == {(1, size[1], size[1], 1), (2, size[2], size[2], 1), (3, size[3], 0, 0), (5, size[5], size[5], 1)}
    four = next(x for x in seen if x[0] == 4)
    assert four[2] == 3000 and four[3] == 1 and got.count() == len(rows)


def test_bpe(spark, docs, empty):
    path = PATH("byte_bpe_multi_50k.tiktoken")
    enc = brute.encoding(path, public_tokenizers.PATTERN)
    rows = hard_texts() + [(200, " " * 3000 + "a"), (201, "x" * 400 + " y" * 300), (202, "a\n \n b's 12 " * 100), (203, "    ".join(WORDS[:200]))]
    df = spark.createDataFrame([(i, t, [0]) for i, t in rows], "doc_id long, text string, ids array<int>")
    for chunk, overlap in ((64, 16), (1 << 15, 2048)):
        out = byte_bpe.decode(byte_bpe.encode(df, path, public_tokenizers.PATTERN, chunk, overlap), path, public_tokenizers.PATTERN).collect()
        got = sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in out)
        assert got == sorted((str(i), enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert byte_bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_a_long_text_repeated(spark):
    """Copies of a long row are encoded once and all come back; the same text under another id, or none, is its own."""
    text = prose(3, 9000)
    rows = spark.range(400).selectExpr("IF(id < 300, 7, IF(id < 390, NULL, id)) AS doc_id").withColumn("text", F.lit(text)).repartition(6)
    enc = brute.encoding(PATH("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = byte_bpe.encode(rows, PATH("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = encoded.groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_set(F.col("ids").cast("string")).alias("kinds")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {7: 300, None: 90, **{i: 1 for i in range(390, 400)}}
    assert {len(r["kinds"]) for r in got} == {1} and encoded.where("doc_id = 390").first()["ids"] == enc.encode_ordinary(text)


def test_pipeline_stages(spark, sf_dir):
    """Every stage against a plain version on what the stage before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stage(stage(spark, docs, sf_dir), name)
        assert out.columns == columns
        rows = out.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert set(after) <= set(before) and len(rows) == len(after)
        if name == "language_id":
            assert len(after) >= 0.97 * len(before) and all(before[d] == t for d, t in after.items())
        if name == "minhash_near_dedup":
            want = brute.op6(before.items(), 5)
            assert set(after) == {d for d, (_, c) in want.items() if d == c}
        if name == "substring_dedup":
            assert {d: t or "" for d, t in after.items()} == {d: t for d, (t, _) in brute.op3(before.items()).items()}
            assert sum(map(len, after.values())) < sum(map(len, before.values()))
        if name == "pii":
            assert after == {d: brute.op2(t, Q.pseudonym_key(spark))[0] for d, t in before.items()}
        if name in ("substring_dedup", "pii"):
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
        docs, before = out, after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    tokenizer = brute_tokenizer()
    want = sorted((d, *p) for d, text in before.items() for p in brute.op4_pieces(text, tokenizer))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in packed) == want


def brute_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH("byte_bpe_50k.json"))


def test_pipeline_stages_on_hard_rows(spark, empty):
    """Nulls in every column, repeated rows, an extra column, and no rows at all."""
    rows = [(i, t, "en" if i is None or i % 2 else None, None, None, 7) for i, t in hard_texts()]
    docs = spark.createDataFrame(rows, SCHEMA + ", digest long")
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, empty, None).count() == 0
        out = function(spark, docs, None)
        kept[name] = sorted((r["doc_id"] for r in out.collect()), key=str)
        if name != "best_fit_packing":
            assert out.columns == docs.columns and {r["digest"] for r in out.collect()} == {7}
    ids = sorted((i for i, _ in hard_texts()), key=str)
    assert not {0, 1, 2, 14} & set(kept["language_id"]) and kept["language_id"].count(17) == 2
    linked = brute.op6(known(hard_texts()), 5)
    assert kept["minhash_near_dedup"] == sorted((i for i in ids if i is None or linked[i][1] == i), key=str)
    assert kept["substring_dedup"] == kept["pii"] == ids and set(kept["best_fit_packing"]) == set(ids)


def test_divergence(spark, docs, empty, monkeypatch):
    r = random.Random(4)
    rows = [(None, None, None), ("", "", ""), ("xx", None, "A b C"), ("xx", "s1", "12 .,"), ("yy", "only", None)]
    words = ["alpha", "Beta", "größe", "été", "don't", "日本", "x1y"]
    rows += [(r.choice(["aa", "bb"]), r.choice(["s1", "s2", "S3", "é", None]), " ".join(r.choices(words, r.choices(range(1, 8), k=7), k=r.randint(0, 30)))) for _ in range(300)]
    rows += [("aa", "hot", "alpha " * 5000), ("bb", "hot", "beta\n" * 3)] * 40
    table = spark.createDataFrame([(*x, 1, 2) for x in rows], "lang string, source string, text string, value int, rank int").repartition(5)
    for least, block in ((30, 1 << 18), (2, 4)):
        monkeypatch.setattr(divergence, "BLOCK", block)
        monkeypatch.setattr(divergence, "PAIRS", block)
        monkeypatch.setattr(divergence.bands, "__defaults__", (block,))
        got = divergence.audit(table, least_docs=least, shards=3).collect()
        assert {(x["lang"], x["source"], x["part"], x["item"]): (x["value"], x["rank"]) for x in got} == brute.op11(rows, least)
        assert len(got) == len(brute.op11(rows, least))
    assert divergence.audit(empty).count() == 0
    assert divergence.audit(docs).count() == 0  # one language, one source


@pytest.mark.parametrize("size", [1, 300, 1 << 16])
def test_runs_are_merged_by_bands(size):
    """Small blocks spill many runs; every term's postings come out of the heap in one band, none lost."""
    import pyarrow as pa

    r = random.Random(9)
    texts = [" ".join(r.choices(WORDS[:500], k=40)) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"lang": [r.choice("ab") for _ in texts], "source": [r.choice("xyz") for _ in texts], "text": texts})
    runs = [p for i in range(0, 200, 10) for p in divergence.index(iter([batch.slice(i, 10)]), shards=1, block=50)]
    assert len(runs) >= 20
    rows = sorted((x for p in runs for x in p.to_pylist()), key=lambda x: (x["lang"], x["first"]))
    tables = [(x["lang"], x["first"], pa.table({"lang": [x["lang"]] * len(x["terms"]), "term": x["terms"], "count": x["counts"]})) for x in rows]
    got, seen = list(divergence.bands(iter(tables), size)), set()
    for band in got:
        terms = {(x["lang"], x["term"]) for x in band.to_pylist()}
        assert not terms & seen
        seen |= terms
    assert sum(sum(band["count"].to_pylist()) for band in got) == sum(len(divergence_terms(t)) for t in texts) and (len(got) == 1) == (size > 300)


def test_many_open_runs_are_merged_in_linear_time(monkeypatch):
    """Pieces that all reach over all terms stay open to the end; their rows are compared with a bound a few times, not with every band's."""
    r, looked, less = random.Random(3), [], divergence.pc.less
    words = sorted({"".join(r.choices("abcdef", k=5)) for _ in range(3000)})
    tables = []
    for _ in range(600):
        terms = sorted({words[0], *r.sample(words, 40)})
        tables.append(("x", terms[0], pa.table({"lang": ["x"] * len(terms), "term": terms, "count": [1] * len(terms)})))
    monkeypatch.setattr(divergence.pc, "less", lambda a, b: (looked.append(len(a)), less(a, b))[1])
    got, rows = list(divergence.bands(iter(tables), 400)), sum(len(t) for _, _, t in tables)
    assert sum(map(len, got)) == rows and sum(looked) <= 4 * rows


def test_a_block_is_one_run_whatever_the_batches():
    """Small batches fill a block together, and a run of (language, term) rows has each once, with its counts by source."""
    r = random.Random(8)
    rows = [(r.choice("ab"), r.choice("xyz"), " ".join(r.choices(WORDS[:300], k=r.randint(0, 40)))) for _ in range(400)] + [("b", "z", ""), ("", "", "12")]
    batches = [pa.RecordBatch.from_pydict(dict(zip(("lang", "source", "text"), zip(*rows[i : i + 7], strict=True), strict=True))) for i in range(0, len(rows), 7)]
    runs, want, docs = list(divergence.index(iter(batches), shards=5)), Counter(), Counter()
    for lang, source, text in rows:
        want.update((lang, source, t.lower()) for t in divergence_terms(text))
        docs.update({(lang, t.lower()) for t in divergence_terms(text)})
    pieces = [p for run in runs for p in run.to_pylist()]
    found, counts, n_docs = Counter(), Counter(), {}
    for p in pieces:
        for term, count, n, packed in zip(p["terms"], p["counts"], p["docs"], p["postings"], strict=True):
            assert (p["lang"], term) not in n_docs
            n_docs[p["lang"], term], counts[p["lang"], term] = n, count
            for source, c in np.frombuffer(packed, np.int32).reshape(-1, 2).tolist():
                found[p["lang"], p["names"][source], term] += c
    assert len(runs) == 1 and found == want and n_docs == dict(docs) and sum(counts.values()) == sum(want.values())
    assert all(p["terms"] == sorted(p["terms"]) and p["first"] == p["terms"][0] for p in pieces) and len({p["shard"] for p in pieces}) == 5


def test_shares_of_counts_beyond_a_long(spark):
    """Shares are exact on both sides of the count up to which a long holds the product."""
    rows = [(c, n, v) for c in (0, 1, (1 << 32) - 1, 1 << 32, 10**13) for n in (0, 7, 10**14) for v in (0, 1, 10**6)]
    table = spark.createDataFrame(rows, "count long, n long, v long")
    got = table.select("count", "n", "v", divergence.share(F.col("count"), "n", "v").alias("p")).where("n >= count").collect()
    assert got and all(x["p"] == (1 + 10**9 * (x["count"] + 5) // (x["n"] + 5 * x["v"]) if x["v"] else None) for x in got)


def divergence_terms(text):
    import re

    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)


def test_threshold_clusters(spark):
    r = random.Random(6)
    vectors = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(400)] + [[float(r.randint(-1, 1)) for _ in range(8)] for _ in range(200)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(3, vectors[5]), (3, vectors[3]), (None, vectors[0]), (900, None), (901, [1.0] * 7), (902, []),
        (903, [None] + [1.0] * 7), (904, [float("nan")] * 8), (905, [float("inf")] * 8), (906, [2.0**20] * 8), (907, [-(2.0**20)] * 8)]
    table = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<double>, hash string, cluster int").repartition(3)
    for k, rounds in ((16, 3), (1, 0), (700, 1)):
        got = threshold_clusters.cluster(table, k=k, rounds=rounds, dimensions=8).collect()
        want = [(rows[i][0], *w) for i, w in brute.op12(rows, k, rounds, 8).items()]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert threshold_clusters.cluster(table.limit(0), dimensions=8).count() == 0 and threshold_clusters.cluster(table, dimensions=9).count() == 0
    with pytest.raises(Exception, match="in magnitude"):
        threshold_clusters.cluster(spark.createDataFrame([(1, [1e12])], table.select("vec_id", "embedding").schema), dimensions=1).count()


def test_threshold_walk_is_exact_and_stops_early():
    r = np.random.default_rng(3)
    for k, d, high in ((16, 64, 50), (16, 3, 3), (5, 1, 2), (40, 8, 1000)):
        centroids, x = r.integers(-high, high, (k, d)), r.integers(-high, high, (500, d))
        near, distance, depth = threshold_clusters.SortedLists(centroids).nearest(x)
        plain = ((x[:, None] - centroids[None]) ** 2).sum(2)
        assert (near == plain.argmin(1)).all() and (distance == plain.min(1)).all()
        assert k < 16 or depth.mean() < 0.7 * k
    assert threshold_clusters._whole(np.array([2**62, 2**62, 5])) == 2**63 + 5


def test_additive_model():
    """Tables follow a curve and a pair's interaction; scores are the sums of cells."""
    r = np.random.default_rng(1)
    x = np.stack([r.random(4000), r.random(4000), r.integers(0, 2, 4000), np.zeros(4000)], 1)
    odds = 4 * np.sin(6 * x[:, 0]) + 6 * ((x[:, 1] > 0.5) ^ (x[:, 2] > 0)) - 3
    y = (r.random(4000) < 1 / (1 + np.exp(-odds))).astype(float)
    model = additive.fit(x[:3000], y[:3000], n_pairs=2)
    assert (1, 2) in model.pairs and len(model.tables[3]) == 1
    p, best = model.score(x[3000:]), 1 / (1 + np.exp(-odds[3000:]))
    assert additive.log_loss(np.log(p / (1 - p)), y[3000:]) < additive.log_loss(odds[3000:], y[3000:]) + 0.04
    assert np.abs(p - best).mean() < 0.08
    bins = model.bins(x[:5])
    by_hand = [model.bias + sum(t[b[f]] for f, t in enumerate(model.tables)) + sum(t[b[i], b[j]] for (i, j), t in model.pairs.items()) for b in bins]
    assert np.allclose(model.margin(bins), by_hand)


def test_additive_quality(spark, docs, empty):
    r = random.Random(8)
    good = [(i, prose(i, r.randint(5, 80)), 1) for i in range(150)]
    bad = [(200 + i, " ".join(f"{w}%%%" for w in prose(i, r.randint(5, 80)).split()), 0) for i in range(100)]
    labelled = spark.createDataFrame([*good, *bad, (900, None, 1), (901, "x", None), (902, "x", 5)], "doc_id long, text string, quality int")
    model = quality_additive.train(labelled.where("doc_id % 5 <> 0"))
    held = {x["doc_id"]: x for x in quality_additive.score(labelled.where("doc_id % 5 = 0 AND quality IS NOT NULL"), model).collect()}
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in held.values())
    assert min(x["score"] for i, x in held.items() if i < 200) > 0.7 and max(x["score"] for i, x in held.items() if 200 <= i < 300) < 0.2
    rows = quality_additive.score(docs, model).collect()
    assert len(rows) == docs.count() and all(x["score"] is not None for x in rows)
    assert quality_additive.score(empty, model).count() == 0
    assert quality_additive.train(labelled.limit(0)) == 0.5 and quality_additive.score(docs, 0.5).where("predicted = 1").count() == docs.count()


def test_additive_features():
    got = quality_additive.features(*utf8(pa_strings(["", None, "The The dog\n\n1 É!", "a" * 13])))
    by = [dict(zip(quality_additive.NAMES, row, strict=True)) for row in got.tolist()]
    assert got.shape == (4, len(quality_additive.NAMES)) and set(by[0].values()) == set(by[1].values()) == {0.0}
    assert by[2]["echoes"] == 1 / 5 and by[2]["distinct"] == 4 / 5 and by[2]["top_word"] == 2 / 5 and by[2]["letterless"] == 1 / 5
    assert by[2]["lines"] == 2 / 5 and by[2]["digits"] == 1 / 17 and by[2]["upper"] == 2 / 17 and by[2]["high"] == 1 / 17 and by[3]["long_words"] == 1


def pa_strings(values):
    import pyarrow as pa

    return pa.array(values, pa.string())
