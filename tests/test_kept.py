"""Inherited references, prefix joins and verified copies against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lintel.operators import backup, segments
from lintel.operators.intervals import longest_prefixes


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_values_come_down_over_blocks(spark, monkeypatch, span):
    rng = random.Random(span)
    rows = [(rng.choice("ab") if rng.random() < 0.95 else None, p, rng.choice([None, None, "x", "y"])) for p in range(120)]
    df = spark.createDataFrame(rows, "d string, p long, v string").repartition(4)
    last, expected = {}, {}
    for d, p, v in rows:
        last[d] = v or last.get(d)
        expected[p] = last[d]
    got = {r["p"]: r["o"] for r in segments.filled_down(df.where("d IS NOT NULL"), ["d"], "p", "v", "o", span).collect()}
    assert got == {p: expected[p] for d, p, _ in rows if d is not None}
    seen, before = defaultdict(set), {}
    for d, p, v in rows:
        before[p] = sorted(seen[d])
        seen[d] |= {v} - {None}
    got = {r["p"]: r["o"] for r in segments.values_before(df.where("d IS NOT NULL"), ["d"], "p", "v", "o", span).collect()}
    assert got == {p: before[p] for d, p, _ in rows if d is not None}


def test_references_are_inherited_by_material(spark):
    rows = [
        ("d", 1, 1, None, "samples", "m", None), ("d", 2, 1, 4, None, "m", None), ("d", 3, 2, 5, None, "m", "KS 2"), ("d", 4, 2, 5, None, "m", "KS 1"), ("d", 5, 2, 5, None, "n", "KS 9"),
        ("d", 6, 1, 4, None, "m", None), ("d", 7, 2, 4, None, "m", None), ("e", 8, 1, None, "samples", "m", None), ("e", 9, 1, 4, None, "m", None), ("d", 10, 1, None, "other", "m", None), ("d", 11, 1, 4, None, "m", None),
    ]
    got = segments.inherited_references(spark.createDataFrame(rows, "document string, place long, `table` int, cells int, heading string, material string, codes string"))
    assert {r["place"]: r["notation"] for r in got.where("notation IS NOT NULL").collect()} == {3: "KS 2", 4: "KS 1", 5: "KS 9", 6: "KS 1; KS 2"}


def test_cuts_are_searched_in_two_steps(spark):
    """As many cuts as bisection finds, with repeated cuts and lists shorter and longer than a step; no value meets every cut."""
    from bisect import bisect_left, bisect_right

    from lintel.operators import intervals

    for n in (0, 1, 15, 16, 17, 255):
        cuts = sorted(i * 7 % 40 for i in range(n))
        counts = [intervals._counted(cuts, lambda c: c < F.col("id")).alias("below"), intervals._counted(cuts, lambda c: c <= F.col("id")).alias("upto")]
        got = [(r["below"], r["upto"]) for r in spark.range(42).select("id", *counts).orderBy("id").collect()]
        assert got == [(bisect_left(cuts, x), bisect_right(cuts, x)) for x in range(42)]


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_longest_prefixes_equal_all_pairs(spark, buckets):
    rng = random.Random(buckets)
    codes = [rng.choice(["", "a", "ab", "abcdefgh", "abcdefghi", "b", "é", "éa", "zz", None]) if rng.random() < 0.7 else "hot" for _ in range(200)]
    asked = sorted({(q, rng.choice(["", "a", "ab", "abc", "abcdefgh", "é", "h", "hot", "hott", "z"])) for q in range(5) for _ in range(3)})
    rows = spark.createDataFrame(list(enumerate(codes)), "id int, code string").repartition(3)
    got = sorted((r["query"], r["id"], r["prefix"]) for r in longest_prefixes(rows, "code", spark.createDataFrame(asked, "query int, prefix string"), buckets).collect())
    expected = []
    for q in range(5):
        for i, code in enumerate(codes):
            fit = [p for x, p in asked if x == q and code is not None and code.startswith(p)]
            if fit:
                expected.append((q, i, max(fit, key=len)))
    assert got == sorted(expected)


def test_a_code_of_many_rows_is_spread(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "0505").otherwise(F.lpad((F.col("id") % 9973).cast("string"), 4, "0")).alias("code"))
    asked = spark.createDataFrame([(1, "05"), (2, "0505")], "query int, prefix string")
    from lintel.operators import intervals

    cut = longest_prefixes(rows, "code", asked, 64)
    assert cut.groupBy("query").count().orderBy("query").collect()[1]["count"] >= 10_000
    spread = intervals.longest_prefixes(rows, "code", asked.where("query = 2"), 64)
    assert spread.select("id").distinct().count() == spread.count()  # in one bucket each


def test_differing_ranges_are_found_and_little_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(backup, "SPAN", 8)
    monkeypatch.setattr(backup, "FANOUT", 4)
    monkeypatch.setattr(backup, "LEAVES_A_PART", 4)
    good = spark.range(3000).select("id", F.when(F.col("id") % 5 != 0, F.concat(F.lit("v"), "id")).alias("v"))
    hurt = good.where("id <> 17").withColumn("v", F.when(F.col("id") == 1234, "other").when(F.col("id") == 2000, None).when(F.col("id") == 2001, "").otherwise(F.col("v")))
    hurt = hurt.unionByName(spark.createDataFrame([(90_000, "new"), (-3, None)], "id long, v string"))
    for name, rows in (("good", good), ("hurt", hurt), ("same", good.repartition(7))):
        backup.write_copy(rows, "id", f"{tmp_path}/{name}")
    got = {r["id"]: r["change"] for r in backup.differences(spark, f"{tmp_path}/hurt", f"{tmp_path}/good", "id").collect()}
    assert got == {17: "added", 1234: "changed", 2001: "changed", 90_000: "removed", -3: "removed"}  # 2000 was null before
    trees = [backup.read_tree(spark, f"{tmp_path}/{n}") for n in ("hurt", "good", "same")]
    assert backup.changed_ranges(trees[0], trees[1]).count() <= 5
    assert backup.changed_ranges(trees[1], trees[2]).count() == 0
    back = backup.restored(spark, f"{tmp_path}/hurt", f"{tmp_path}/good", "id")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, good.collect()), key=str)


def test_retention_by_age_and_count(spark):
    rows = [("a", i, f"2024-01-{i:02d}") for i in range(1, 11)] + [("b", 1, "2023-01-01")]
    copies = spark.createDataFrame(rows, "owner string, id int, made string").withColumn("made", F.to_timestamp("made"))
    gone = backup.pruned(copies, ["owner"], 3, 5, F.to_timestamp(F.lit("2024-01-10")))
    assert sorted((r["owner"], r["id"]) for r in gone.collect()) == [("a", i) for i in range(1, 5)]


@pytest.mark.parametrize("block", [512, 4])
def test_places_equal_a_plain_search(spark, monkeypatch, block):
    from lintel.operators import places

    monkeypatch.setattr(places, "BLOCK", block)
    rng = random.Random(block)
    sources, clauses, texts = [], [], {}
    for doc in range(4):
        words = [f"sentence number {rng.randrange(10**6)} of {doc}" for _ in range(30)] + ["the same words again"] * 3 + ["twice said here"] * 2 + ["tiny", "absent sentence 77", ""]
        rng.shuffle(words)
        there = [w for w in words if "absent" not in w]
        there = there[10:14] + there[:10] + there[14:] + (["twice said here"] if doc == 2 else [])
        sources.append((doc, ". ".join(there).upper()))
        clauses += [(doc, i, w) for i, w in enumerate(words)]
        texts[doc] = "".join(c for c in ". ".join(there).lower() if c.isalnum())
    got = {(r["doc"], r["ord"]): (r["start"], r["status"]) for r in places.find_places(spark.createDataFrame(sources, "doc int, text string"), spark.createDataFrame(clauses, "doc int, ord int, text string")).collect()}
    assert len(got) == len(clauses)
    for doc in range(4):
        said = {i: "".join(c for c in w.lower() if c.isalnum()) for d, i, w in clauses if d == doc}
        at = {i: [p for p in range(len(texts[doc])) if texts[doc].startswith(w, p)] if len(w) >= 8 else [] for i, w in said.items()}
        unique = {i: p[0] for i, p in at.items() if len(p) == 1}
        mine = {i: got[doc, i] for i in said}
        assert all(mine[i] == (None, "absent") for i, p in at.items() if not p)
        assert all(mine[i][0] == p and mine[i][1] in ("exact", "moved") for i, p in unique.items())
        line = [(i, mine[i][0]) for i in sorted(unique) if mine[i][1] == "exact"]
        assert all(a[1] < b[1] for a, b in zip(line, line[1:]))
        order = [unique[i] for i in sorted(unique)]
        if block == 512:
            best = [1] * len(order)
            for i in range(len(order)):
                best[i] += max((best[j] for j in range(i) if order[j] < order[i]), default=0)
            assert len(line) == max(best)
        groups = defaultdict(lambda: (set(), set()))
        for i, p in at.items():
            if len(p) > 1:
                low, high = max((s for j, s in line if j < i), default=-1), min((s for j, s in line if j > i), default=1 << 62)
                fit = {s for s in p if low < s and s + len(said[i]) <= high}
                if fit:
                    groups[low, said[i]][0].add(i)
                    groups[low, said[i]][1].update(fit)
        expected = {i: (s, "repeated") for asked, there in groups.values() if len(asked) == len(there) for i, s in zip(sorted(asked), sorted(there))}
        assert {i: mine[i] for i, p in at.items() if len(p) > 1} == {i: expected.get(i, (None, "ambiguous")) for i, p in at.items() if len(p) > 1}
    assert {s for _, s in got.values()} >= {"exact", "moved", "repeated", "ambiguous", "absent"}


def test_places_of_no_rows(spark):
    from lintel.operators import places

    none = spark.createDataFrame([], "doc int, text string")
    assert places.find_places(none, spark.createDataFrame([(1, 1, "some words here")], "doc int, ord int, text string")).collect()[0]["status"] == "absent"
    assert places.find_places(none, spark.createDataFrame([], "doc int, ord int, text string")).collect() == []
