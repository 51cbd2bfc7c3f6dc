"""The kept index against plain sums, after builds and deltas; scan scores against plain sums."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lintel.operators import impact_index, index
from lintel.operators.impact_index import ImpactIndex

DOC = "doc long, terms array<string>"


def corpus(rng, n, at=0):
    words = [f"w{i}" for i in range(40)] + ["common"] * 8
    return {at + i: [rng.choice(words) if rng.random() < 0.8 else f"rare{rng.randrange(200)}" for _ in range(rng.choice([0, 1, 5, 20, 80]))] for i in range(n)}


def plain_top(docs, queries, k):
    n, total = len(docs), sum(map(len, docs.values()))
    counts = {d: Counter(t) for d, t in docs.items()}
    df = Counter(t for c in counts.values() for t in c)
    out = []
    for q, terms in queries.items():
        scored = []
        for d, c in counts.items():
            met = [t for t in terms if t in c]
            if met:
                s = sum((1 + math.log(terms[t])) * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(docs[d]) / (total / n))) for t in met)
                scored.append((-round(s, 6), d))
        out += [(q, d, -s, r) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def close(got, expected):
    assert [(q, d, r) for q, d, _, r in got] == [(q, d, r) for q, d, _, r in expected]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, expected))


def asked(spark, queries):
    return spark.createDataFrame([(q, t, n) for q, c in queries.items() for t, n in c.items()], "query long, term string, tf long")


def queries(rng, docs):
    some = rng.sample(sorted(docs), 6)
    found = {i: Counter((docs[d] + ["common", "nowhere"])[:30]) for i, d in enumerate(some)}
    return found | {9: Counter(["common", "common", "rare3"]), 10: Counter(["nowhere"])}


@pytest.fixture
def small(monkeypatch):
    """Few parts and small chunks, so that terms have several; probes too few to find every threshold."""
    monkeypatch.setattr(impact_index, "PARTS", 3)
    monkeypatch.setattr(impact_index, "CHUNK", 8)
    monkeypatch.setattr(impact_index, "PROBE_POSTINGS", 10)


def test_index_after_deltas_equals_a_rebuild(spark, small, tmp_path):
    rng = random.Random(5)
    docs = corpus(rng, 90)
    kept = ImpactIndex.build(spark.createDataFrame(list(docs.items()), DOC), f"{tmp_path}/kept")
    deltas = [corpus(rng, 40, at=70), {d: None for d in range(0, 60, 7)} | {500: None}, {3: ["common"] * 60, 4: [], 7: ["back", "again"], 600: ["w1"] * 300}]
    for delta in deltas:
        before = spark.read.parquet(f"{kept.path}/blocks").count()
        kept.apply(spark.createDataFrame(list(delta.items()), DOC))
        docs = {d: t for d, t in (docs | delta).items() if t is not None}
        written = spark.read.parquet(f"{kept.path}/blocks").count() - before
        assert written <= sum(len(set(t or [])) for t in delta.values())  # work grows with the delta
    fresh = ImpactIndex.build(spark.createDataFrame(list(docs.items()), DOC), f"{tmp_path}/fresh")
    assert kept.stats() == pytest.approx(fresh.stats())
    for read in (lambda i: i.frequencies(), lambda i: i.documents().select("doc", "len", F.array_sort("terms").alias("terms"))):
        assert sorted(map(str, read(kept).collect())) == sorted(map(str, read(fresh).collect()))
    q = queries(rng, docs)
    expected = plain_top(docs, q, 4)
    for one in (kept, fresh, ImpactIndex(spark, kept.path)):
        close(sorted(tuple(r) for r in one.top(asked(spark, q), 4).collect()), expected)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.95])
def test_bounds_lose_nothing(spark, small, monkeypatch, share):
    monkeypatch.setattr(impact_index, "SHARE", share)
    rng = random.Random(int(share * 10))
    docs = corpus(rng, 120)
    kept = ImpactIndex.build(spark.createDataFrame(list(docs.items()), DOC))
    q = queries(rng, docs)
    close(sorted(tuple(r) for r in kept.top(asked(spark, q), 3).collect()), plain_top(docs, q, 3))
    left = kept.plan(kept.weighted(asked(spark, q)), 3).agg(F.count_if("out")).first()[0]
    assert (left > 0) == (share > 0)


def test_a_delta_that_died_counts_for_nothing(spark, small, tmp_path):
    docs = {1: ["a", "b"], 2: ["a"]}
    kept = ImpactIndex.build(spark.createDataFrame(list(docs.items()), DOC), f"{tmp_path}/kept")
    delta = spark.createDataFrame([(2, None), (3, ["a", "c"])], DOC)
    real = ImpactIndex._write

    def dies(self, df, name, *rest):
        if name == "levels":
            raise RuntimeError("killed")
        return real(self, df, name, *rest)

    ImpactIndex._write = dies
    try:
        with pytest.raises(RuntimeError):
            kept.apply(delta)
    finally:
        ImpactIndex._write = real
    again = ImpactIndex(spark, kept.path)
    assert {(r["term"], r["df"]) for r in again.frequencies().collect()} == {("a", 2), ("b", 1)}
    again.apply(delta)
    assert {(r["term"], r["df"]) for r in again.frequencies().collect()} == {("a", 2), ("b", 1), ("c", 1)}
    assert again.stats() == (2, 2.0)


def test_an_empty_index(spark, small):
    kept = ImpactIndex.build(spark.createDataFrame([], DOC))
    assert kept.top(asked(spark, {1: Counter(["a"])}), 3).collect() == []
    kept.apply(spark.createDataFrame([(1, ["a"])], DOC))
    assert [tuple(r)[:2] for r in kept.top(asked(spark, {1: Counter(["a"])}), 3).collect()] == [(1, 1)]


@pytest.mark.parametrize("blocks", [False, True])
def test_scan_scores_equal_plain_sums(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(index, "ASKED_ROWS", 5)
    rng = random.Random(1)
    docs = {d: t for d, t in corpus(rng, 50).items()}
    q = queries(rng, docs)
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc long, text string")
    terms = F.filter(F.split("text", " "), lambda t: t != "")
    got = {(r["query"], r["doc"]): r for r in index.scan_scores(asked(spark, q), df, terms, ("tfidf", "bm25", "overlap")).collect()}
    top = {(query, doc): s for query, doc, s, _ in plain_top(docs, q, 1000)}
    assert set(got) == set(top) and all(abs(got[p]["bm25"] - s) < 2e-6 for p, s in top.items())
    n, df_ = len(docs), Counter(t for ts in docs.values() for t in set(ts))
    weight = lambda c: {t: (1 + math.log(m)) * (math.log((n + 1) / (df_[t] + 1)) + 1) for t, m in c.items() if df_[t]}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    for (query, doc), r in got.items():
        a, b, c = weight(q[query]), weight(Counter(docs[doc])), Counter(docs[doc])
        assert r["tfidf"] == pytest.approx(sum(a[t] * b[t] for t in a if t in b) / norm(a) / norm(b))
        common = sum(min(m, c[t]) for t, m in q[query].items())
        assert r["overlap"] == pytest.approx(min(1.0, 0.62 * common / sum(q[query].values()) + 0.38 * common / len(docs[doc])))
    only = index.scan_scores(asked(spark, q), df, terms, ("overlap",)).collect()
    assert {(r["query"], r["doc"]): round(r["overlap"], 9) for r in only} == {p: round(r["overlap"], 9) for p, r in got.items()}
