"""Every query of the catalogue against its SQL on a small table."""

import decimal
import math

import pytest

import __spark_entry__ as entry
from termloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, (bool, int, decimal.Decimal)):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_gate_train_reaches_the_least_loss(spark, sf_dir):
    """The fitted gate's loss against that of Newton steps on the same features."""
    import numpy as np

    from termloom.operators import gate
    from termloom.plans.fixtures import fixtures

    samples = fixtures(spark, sf_dir).samples()
    rows = gate.gate_transform(samples, gate.gate_fit(samples)).select("features", "label").collect()
    x, y = np.array([[*r["features"], 1.0] for r in rows]), np.array([r["label"] for r in rows], float)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + 1e-7 * np.eye(len(w)), x.T @ (y - p))
    p = np.clip(1 / (1 + np.exp(-x @ w)), 1e-9, 1 - 1e-9)
    loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    got = catalog.queries()["gate_train"](spark, sf_dir).first()
    assert abs(got["loss"] - loss) < 2e-3 and got["loss"] < got["constant_loss"]


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_selection_is_greedy(spark, sf_dir):
    """The n-grams taken at one threshold, against a plain greedy run over all of an article's."""
    from termloom.operators.recognize import select_retrieved
    from termloom.plans.fixtures import fixtures

    f = fixtures(spark, sf_dir)
    grams, hits = f.ngrams(), {r["text"]: r["score"] for r in f.hits().collect()}
    got = {(r["pmc_id"], r["start"], r["length"]) for r in select_retrieved(grams, f.hits(), [0.4]).collect()}
    by = {}
    for r in grams.collect():
        if hits.get(r["text"], 0) >= 0.4:
            by.setdefault(r["pmc_id"], []).append((-hits[r["text"]], r["start"], -r["length"]))
    want = set()
    for article, rows in by.items():
        taken = []
        for _, start, shorter in sorted(rows):
            if all(start >= z or start - shorter <= a for a, z in taken):
                taken.append((start, start - shorter))
                want.add((article, start, -shorter))
    assert got == want


def test_hits_use_all_vectors(spark, sf_dir):
    """Texts of one length and first letter have different vectors, and all vectors are asked."""
    from termloom.plans.fixtures import fixtures

    f = fixtures(spark, sf_dir)
    rows = f.hits().collect()
    by = {}
    for r in rows:
        by.setdefault((len(r["text"]), r["text"][0]), set()).add((r["name"], r["score"]))
    assert max(len(v) for v in by.values()) > 1
    assert len(rows) == f.ngrams().select("text").distinct().count()
    assert {(r["name"], r["score"]) for r in rows} == {(r["name"], r["score"]) for r in f.top1().collect()}


def test_prompts_have_the_whole_context(spark, sf_dir):
    """The registered prompts show 120 characters on either side of a mention."""
    from termloom.operators import associate as A
    from termloom.plans.fixtures import fixtures

    f = fixtures(spark, sf_dir)
    want = {
        "prompt_window": A.prompt_window(A.section_lookup(f.pred(), f.segments()), f.patients(), f.texts(), 120),
        "prompt_whole": A.prompt_whole(f.pred(), f.patients(), f.texts(), 120),
    }
    for name, df in want.items():
        rows = sorted(tuple(r) for r in catalog.queries()[name](spark, sf_dir).collect())
        assert rows and rows == sorted(tuple(r) for r in df.collect())


def test_gate_is_fitted_to_the_end(spark, sf_dir):
    """The registered gate's gradient is nothing at the weights it has."""
    import numpy as np

    from termloom.operators import gate
    from termloom.plans.fixtures import fixtures

    samples = fixtures(spark, sf_dir).samples()
    state = gate.gate_fit(samples)
    weights, bias = gate.gate_train(samples, state)
    w = np.array([*weights, bias])
    total, _, first, _ = gate.newton_sums(gate.gate_transform(samples, state), w, 1.0)
    assert np.abs(first / total + 1e-6 * w).max() < 1e-8
