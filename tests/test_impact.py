"""Impact of a revision: rows of both sides move once."""

from __future__ import annotations

from lintel.operators import impact

TEXTS = "clause long, pos int, id string, code string, number string, title string, content string, warnings array<string>, rank int, score double, classification string, reasons array<string>, version string, updated string, name string"


def side(spark, rows):
    """rows: clause, pos, id, content, rank."""
    full = [(c, p, i, "41 34 02", " 1.1", "Ｔitle", text, ["b ", " a"], rank, 0.5, "high", ["r"], "1", "u", "n") for c, p, i, text, rank in rows]
    return spark.createDataFrame(full, TEXTS)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(clause")


def test_both_sides_move_once(spark):
    before = side(spark, [(1, 1, "x", "brick  wall", 1), (1, 2, "y", "brick wall", 2), (1, 3, "z", "tile", 3), (2, 1, "w", "mortar", 1), (None, 1, "v", "tile", 1)])
    after = side(spark, [(1, 1, None, " Brick\twall ", 1), (1, 2, None, "paint", 2), (2, 1, None, "mortar", 5), (None, 1, None, "tile", 1)]).drop("id")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        given = impact.assignments(before, after)
        assert shuffles(given) == 1
        clauses = spark.createDataFrame([(1, "keep", "x"), (2, None, "gone"), (3, "keep", None)], "clause long, decision string, selected string")
        planned = impact.plan(before, after, clauses)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert shuffles(impact.plan(before, after, clauses)) == 2  # both sides, and the clauses that ask
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {(r["clause"], r["pos"]): r for r in given.collect()}
    assert {k: (r["preserved_id"], r["reused"], r["metadata_changed"]) for k, r in got.items()} == {(1, 1): ("x", True, False), (1, 2): (None, False, False), (2, 1): ("w", True, True), (None, 1): (None, False, False)}
    assert got[1, 1]["assigned_id"] == "x" and len(got[1, 2]["assigned_id"]) == 36 and len(got[1, 1]["fp"]) == 64
    rows = {r["clause"]: r for r in planned.collect()}
    assert {k: (r["material_changed"], r["metadata_changed"], r["review_required"], r["selected"], r["selection_removed"]) for k, r in rows.items()} == {1: (True, False, True, "x", False), 2: (False, True, False, None, True), 3: (False, False, False, None, False)}
    assert rows[1]["reasons"] == ["candidate_meaning_changed", "candidate_added", "candidate_removed"] and rows[2]["reasons"] == ["candidate_metadata_changed", "selected_candidate_removed"]
