"""What a task holds stays bounded, whatever the size of the tables."""

from lintel.operators import impact_index, review
from lintel.plans import phrased, registry, retrieval
from lintel.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_names_of_parts_are_dealt_before_they_are_cut(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(retrieval, "DEALT_NAMES", 5)
    spark.createDataFrame([(i, f"steel bolt {i}", "promo") for i in range(60)], "p_partkey long, p_name string, p_type string").selectExpr("*", "'b' AS p_brand").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, "copper")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    assert retrieval._grams(spark, str(tmp_path))[1].rdd.getNumPartitions() >= 12
    assert retrieval.stable_score(spark, str(tmp_path)).rdd.getNumPartitions() >= 12


def test_projects_are_dealt_for_query_texts(spark, monkeypatch, tmp_path):
    spark.range(400).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(phrased, "dealt", lambda df, key, rows=50: registry.dealt(df, key, 50))
    got = QUERIES["R16_all_query_texts"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 8 and got.count() == 400


def test_no_text_is_sorted_or_grouped_for_batches(spark):
    plan = QUERIES["E08_batches"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    making = [line for line in plan.splitlines() if "repeat(x" in line]
    assert len(making) == 1 and plan.index("Window") < plan.index("Exchange")
    assert plan.index("repeat(x") < plan.index("Window")  # above the window, so made of rows that are in order
    assert plan.count("Exchange") == 1  # one shuffle, of keys


def test_topics_that_many_ask_for_are_cut(spark, monkeypatch):
    rows = [(c, 0 if c % 2 else 1 + c % 7, (c * 5 + j * 3) % 23) for c in range(120) for j in range(3)]
    lines = spark.createDataFrame(rows, "clause long, topic long, code long")
    expected = set()
    for c in {r[0] for r in rows}:
        topics, cited = {t for o, t, _ in rows if o == c}, {s for o, _, s in rows if o == c}
        expected |= {(c, i + 1, s) for i, s in enumerate(sorted({s for o, t, s in rows if o != c and t in topics} - cited)[:3])}
    for bound in (10, 1000):
        monkeypatch.setattr(review, "DEALT", bound)
        got = review.related_references(lines, lines, 3)
        assert {tuple(r) for r in got.collect()} == expected
        if bound == 10:  # half of all clauses ask for one topic
            assert "cuts" in got._jdf.queryExecution().optimizedPlan().toString() and got.rdd.getNumPartitions() >= 36


def test_a_segment_is_dealt_by_its_documents_and_postings(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(impact_index, "PARTS", 2)
    monkeypatch.setattr(impact_index, "DEALT", 10, raising=False)
    monkeypatch.setattr(impact_index, "DEALT_POSTINGS", 20, raising=False)
    docs = spark.createDataFrame([(d, ["a", f"b{d % 9}", f"c{d}"]) for d in range(90)], "doc long, terms array<string>").coalesce(1)
    written = {}
    monkeypatch.setattr(impact_index.ImpactIndex, "_write", lambda self, df, name, number, real=impact_index.ImpactIndex._write: (written.update({name: df._jdf.queryExecution().optimizedPlan().toString()}), real(self, df, name, number)))
    kept = impact_index.ImpactIndex.build(docs, f"{tmp_path}/kept")
    assert "RepartitionByExpression [doc" in written["forward"] and ", 9" in written["forward"]  # 90 documents in tasks of 10
    assert "RepartitionByExpression [term" in written["blocks"] and ", 14" in written["blocks"]  # 270 postings in tasks of 20
    assert {(r["term"], r["df"]) for r in kept.frequencies().where("df > 1").collect()} == {("a", 90)} | {(f"b{i}", 10) for i in range(9)}
