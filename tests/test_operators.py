import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lintel.functions import terms
from lintel.operators import index, matching, ranking, relational, review


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "")], "doc_id int, text string")
    posts = index.postings(docs, "doc_id", F.filter(F.split("text", " "), lambda t: t != ""))
    asked = index.postings(spark.createDataFrame([(9, "a a z")], "doc_id int, text string"), "doc_id", F.split("text", " "), "query")
    got = index.bm25_scores(asked, posts, index.collection(docs, posts)).collect()
    avg, idf = 5 / 3, math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert [(r["query"], r["doc"]) for r in got] == [(9, 1)]
    assert got[0]["score"] == pytest.approx((1 + math.log(2)) * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg)))


def test_fusion_prefers_the_scoped_score(spark):
    rows = spark.createDataFrame([(1, 0, "scoped", 7, 0.4), (1, 1, "global", 7, 0.9), (1, 1, "global", 8, 0.5)], "query int, list_id int, source string, doc int, score double")
    got = {r["doc"]: r for r in ranking.fuse(rows).collect()}
    assert got[7]["score"] == 0.4 and got[8]["score"] == 0.5
    focused = rows.unionByName(rows.sparkSession.createDataFrame([(1, 2, "focused", 7, 0.6)], rows.schema))
    assert {r["doc"]: r["score"] for r in ranking.fuse(focused).collect()} == {7: 0.6, 8: 0.5}  # only a focused score competes with a scoped one
    assert sorted(r["rank"] for r in got.values()) == [1, 2]


def test_unverified_rows_need_a_verdict(spark):
    c = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, False), (1, 3, True)], "query int, idx int, must_verify boolean")
    v = spark.createDataFrame([(1, 1, "unrelated"), (1, 3, "partial")], "query int, idx int, relation string")
    assert [(r["idx"], r["rank"]) for r in ranking.apply_verdicts(c, v).orderBy("rank").collect()] == [(2, 1), (3, 2)]


def test_cursor_is_bound_to_filters():
    c = relational.encode_cursor(("2024", 3), {"q": "x"})
    assert relational.decode_cursor(c, {"q": "x"}) == ("2024", 3)
    with pytest.raises(ValueError):
        relational.decode_cursor(c, {"q": "y"})


def test_keyset_pages_have_no_gap(spark):
    rows = spark.range(125).select("id", (F.col("id") % 10).alias("at"))
    seen, after = [], None
    for size in (50, 50, 25):
        page = relational.keyset_page(rows, "at", "id", 50, after).collect()
        assert (len(page) > 50) == (size == 50)
        seen += [(r["at"], r["id"]) for r in page[:50]]
        after = seen[-1]
    assert seen == sorted(seen, reverse=True) and len(set(seen)) == 125


def test_page_beyond_the_end_keeps_the_total(spark):
    got = relational.page_with_total(spark.range(3), ["id"], 10, 5).collect()
    assert [(r["total"], r["id"]) for r in got] == [(3, None)]


def test_spread_sample(spark):
    rows = spark.range(10)
    assert [r["id"] for r in relational.spread_sample(rows, [], ["id"], 4).orderBy("id").collect()] == [0, 3, 6, 9]
    assert [r["id"] for r in relational.spread_sample(rows, [], ["id"], 1).collect()] == [5]
    assert relational.spread_sample(rows, [], ["id"], 20).count() == 10


def test_multiset_diff(spark):
    b = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "y", 3)], "k int, f string, o int")
    a = spark.createDataFrame([(1, "x", 1), (1, "z", 2)], "k int, f string, o int")
    got = {(r["f"], r["n"]): r["change"] for r in relational.multiset_diff(b, a, ["k"], "f", "o").collect()}
    assert got == {("x", 1): "kept", ("x", 2): "removed", ("y", 1): "removed", ("z", 1): "added"}


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, o int")
    assert {r["k"]: r["v"] for r in relational.upsert(old, new, ["k"], "o").collect()} == {1: "a", 2: "d", 3: "e"}
    assert {r["k"]: r["v"] for r in relational.upsert(old, new, ["k"], "o", overwrite=False).collect()}[2] == "b"


def test_spread_sample_by_keys_with_ties(spark):
    rows = spark.createDataFrame([(k, i // 7, i) for k in ("a", "b") for i in range(300 if k == "a" else 5)], "k string, x int, id int")
    got = relational.spread_sample(rows, ["k"], ["x", "id"], 12, buckets=8)
    for k, n in (("a", 300), ("b", 5)):
        want = {round(j * (n - 1) / 11) for j in range(12)} if n > 12 else set(range(n))
        assert {r["id"] for r in got.where(F.col("k") == k).collect()} == want


def test_stratified_sample_is_topped_up(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 90, "x").otherwise("y").alias("c"))
    got = relational.stratified_sample(rows, "c", {"x": 12, "y": 23}, ["id"], 50)
    assert got.count() == 50 and got.where("c = 'y'").count() == 10 and got.distinct().count() == 50


def test_samples_and_places_use_one_set_of_cuts(spark, monkeypatch):
    """Approximate quantiles made twice may differ: here they differ whenever they are made."""
    drawn = F.udf(lambda n: [float(x) for x in sorted(random.sample(range(300), 7))], "array<double>")
    monkeypatch.setattr(F, "percentile_approx", lambda column, *_: drawn(F.count(column)))
    rows = spark.range(300).select("id", F.lit("a").alias("k"), F.lit("x").alias("text"))
    want = {round(j * 299 / 39) for j in range(40)}
    assert {r["id"] for r in relational.spread_sample(rows, ["k"], ["id"], 40).collect()} == want
    got = relational.stratified_sample(rows, "k", {"a": 12}, ["id"], 50)
    assert got.distinct().count() == got.count() == 50
    assert all(r["n"] == r["id"] + 1 for r in relational.placed(rows, ["k"], F.col("id"), [], "n", within=True).collect())


def test_table_rows_meet_by_classes(spark):
    """Repeated keys, nulls and empty lists; pairs of rows are neither deduplicated nor moved after they were made."""
    rng = random.Random(19)
    some = lambda names: rng.choice([None, [], [rng.choice(names) for _ in range(rng.randrange(1, 4))]])
    clauses, held = ([(rng.randrange(40), some("abcd"), some(["x", "y", None])) for _ in range(90)] for _ in range(2))
    shape = "{} int, standards array<string>, grades array<string>"
    got = review.matching_table_rows(spark.createDataFrame(clauses, shape.format("c")), spark.createDataFrame(held, shape.format("r")), "c", "r")
    shared = lambda a, b: (set(a or []) & set(b or [])) - {None}
    assert sorted(map(tuple, got.collect())) == sorted({(c, r) for c, s, g in clauses for r, t, h in held if shared(s, t) and shared(g, h)})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("Project") and plan.splitlines()[1].startswith("+- Join Inner")


def test_routes_of_a_catalogue_that_looks_small(spark, tmp_path):
    """Ties by code, then by document; the catalogue does not pass through the driver."""
    rows = [(i, f"C{i % 3}", "steel bolt" if i % 2 else "copper pipe") for i in range(40)]
    spark.createDataFrame(rows, "doc long, code string, text string").write.parquet(f"{tmp_path}/codes")
    codes = spark.read.parquet(f"{tmp_path}/codes")
    posts = index.postings(codes, "doc", F.split("text", " "))
    asked = index.postings(spark.createDataFrame([(1, "steel"), (2, "copper bolt"), (3, "wood")], "id long, text string"), "id", F.split("text", " "), "query")
    ask = lambda **more: index.catalogue_routes(asked, posts, codes.select("doc", "code"), index.collection(codes, posts), **more)
    listed = lambda word: sorted((c, i) for i, c, t in rows if word in t)
    got = ask().orderBy("query", "rank").collect()
    assert [(r["query"], r["code"], r["doc"]) for r in got if r["query"] == 1] == [(1, *x) for x in listed("steel")[:5]]
    assert [(r["code"], r["doc"]) for r in got if r["query"] == 2] == sorted(listed("copper") + listed("bolt"))[:5] and len(got) == 10
    got = ask(prefixes=["C2"]).where("query = 1").orderBy("rank").collect()
    assert [r["doc"] for r in got] == [i for c, i in listed("steel") if c == "C2"][:5]
    plan = ask()._jdf.queryExecution().sparkPlan().toString()
    assert any("SortMergeJoin [doc" in line for line in plan.splitlines())


def test_shares_of_concepts(spark):
    """Pairs of classes are counted, pairs of rows only joined."""
    texts = ["통줄눈 및 소석회", "통줄눈", "하루 쌓기 소석회", "없음", None, "수평"]
    queries = spark.createDataFrame([(i, texts[i % 6], i % 5 > 0) for i in range(30)], "query int, text string, masonry boolean")
    sections = spark.createDataFrame([(i, "413402" if i % 4 else "414000", "t", texts[i % 6]) for i in range(48)], "doc int, code string, title string, content string")
    sides = lambda t, side: {i for i, c in enumerate(terms.MASONRY_CONCEPTS) if re.search(c[side], re.sub(r"\s+", "", t or ""))}
    expected = {}
    for q in queries.collect():
        for d in sections.collect():
            asked, held = sides(q["text"], 0), sides(d["content"], 1)
            if q["masonry"] and d["code"].startswith(terms.MASONRY_PREFIX) and asked & held:
                expected[q["query"], d["doc"]] = len(asked & held) / len(asked)
    got = matching.concept_hits(queries, sections)
    assert {(r["query"], r["doc"]): r["share"] for r in got.collect()} == pytest.approx(expected) and got.count() == len(expected) > 50
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert plan[0].startswith("Project") and plan[1].startswith("+- Join Inner")


def test_rolled_digest_does_not_depend_on_partitions(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("v"), "id").alias("row"))
    digests = {relational.rolled_digest(df, "key", ["row"]).first()[0] for df in (rows, rows.repartition(7), rows.orderBy(F.rand()))}
    assert len(digests) == 1 and relational.rolled_digest(rows.where("key <> '3'"), "key", ["row"]).first()[0] not in digests


def test_query_blocks_give_the_same_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 13}" for j in range(1, 9))) for i in range(40)], "id int, text string")
    terms = F.split("text", " ")
    posts, asked = index.postings(docs, "id", terms), index.postings(docs.where("id < 6"), "id", terms, "query")
    stats = index.collection(docs, posts)
    scores = lambda: {(r["query"], r["doc"]): (round(r["tfidf"], 9), round(r["bm25"], 9), round(r["overlap"], 9)) for r in index.pair_scores(index.asked_terms(asked, posts, stats), index.term_index(posts, stats)).collect()}
    whole = scores()
    monkeypatch.setattr(index, "ASKED_ROWS", 10)
    assert scores() == whole


def test_places_equal_a_plain_sort(spark):
    import random

    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice([None, 1.5, 2.0, float(rng.randrange(40))]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(5)
    key = lambda r: (r[1] is not None, r[1] or 0, -r[2])
    got = {r["i"]: r["n"] for r in relational.placed(df, ["k"], F.col("v"), [F.desc("i")], "n", within=True, buckets=8).collect()}
    assert got == {r[2]: n for k in "ab" for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=key), 1)}
    got = {r["i"]: r["n"] for r in relational.placed(df, ["k"], F.col("v"), [F.desc("i")], "n", buckets=8).collect()}
    assert got == {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0], *key(r))), 1)}


def test_release_drops_what_queries_made(spark):
    import os

    from lintel import session

    session.release(spark)
    kept = session.staged(spark.range(5), "one")
    held = session.bucketed(spark.range(9).withColumnRenamed("id", "k"), "k", "two")
    assert "Exchange" not in held.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    folders = [f.removeprefix("file:").rpartition("/")[0] for f in (*kept.inputFiles(), *held.inputFiles())]
    assert all(os.path.isdir(f.removeprefix("//")) for f in folders)
    assert session.release(spark) == 3 and session.release(spark) == 0
    assert not any(os.path.isdir(f.removeprefix("//")) for f in folders)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lintel_")]


def test_tasks_hold_a_bounded_number_of_rows(spark):
    from lintel.plans.registry import dealt

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt(spark.range(1000), "id", 10).rdd.getNumPartitions() == 100
    assert dealt(spark.range(5), "id", 10).rdd.getNumPartitions() == least
    assert dealt(spark.range(1000), "id", 10).count() == 1000
