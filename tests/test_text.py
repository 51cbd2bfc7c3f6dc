from pyspark.sql import functions as F

from lintel.functions import identity, quantities, text


def one(spark, expression, **columns):
    schema = ", ".join(f"{k} string" for k in columns)
    return spark.createDataFrame([tuple(columns.values())], schema).select(expression.alias("x")).first()["x"]


def test_clean_space_knows_unicode_spaces(spark):
    assert one(spark, text.clean_space(F.col("a")), a=" a \n b ") == "a b"
    assert one(spark, text.clean_space(F.col("a")), a=None) == ""


def test_references_are_canonical(spark):
    assert one(spark, text.normalize_references(F.col("a")), a="ksd-3503 (KS F 4009)") == "KS D 3503 (KS F 4009)"


def test_equivalents_are_appended_once(spark):
    got = one(spark, text.expand_terms(F.col("a")), a="줄눈 파기 작업")
    assert got == "줄눈 파기 작업 줄파기 줄눈파기 줄눈 파기"


def test_ngrams_of_short_keys(spark):
    assert one(spark, text.char_ngrams(F.col("a")), a="abc") == ["ab", "bc", "abc"]
    assert one(spark, text.char_ngrams(F.col("a")), a="a") == []


def test_html_entities(spark):
    assert one(spark, text.strip_html(F.col("a")), a="<p>a &eacute;</p><img src=x>b&amp;") == "a é b&"


def test_quantities_are_sorted_and_distinct(spark):
    got = one(spark, quantities.quantities(F.col("a")), a="1,000 ㎜, 1000mm, 20 ℃")
    assert [(q["number"], q["unit"]) for q in got] == [("20", "℃"), ("1000", "mm")]


def test_differences_are_one_sided(spark):
    got = one(spark, quantities.differences(F.col("a"), F.col("b")), a="벽돌 폭 1 m", b="벽돌 폭 1000 mm, 길이 30 mm")
    assert got["warnings"] == []
    got = one(spark, quantities.differences(F.col("b"), F.col("a")), a="벽돌 폭 1 m", b="벽돌 폭 1000 mm, 길이 30 mm")
    assert got["categories"] == ["quantity"]


def test_grade_suffixes(spark):
    assert one(spark, quantities.grades(F.col("a")), a="SM275A, B, -TMC") == ["SM275A", "SM275B"]


def test_uuid5_matches_the_standard_library(spark):
    from uuid import NAMESPACE_DNS, uuid5

    for name in ("x", "시방서", ""):
        assert one(spark, identity.uuid5(str(NAMESPACE_DNS), F.col("a")), a=name) == str(uuid5(NAMESPACE_DNS, name))


def test_semantic_fingerprint_ignores_spacing_case_and_width(spark):
    rows = spark.createDataFrame([("KCS 41-34", "1", "제목", "a  b", ["w", "v"]), ("kcs4134", " 1 ", "제목 ", "Ａ b", ["v", "w ", "w", " "])], "c string, n string, t string, x string, w array<string>")
    assert rows.select(identity.semantic_fingerprint(*map(F.col, "cntxw")).alias("f")).distinct().count() == 1
    other = rows.limit(1).withColumn("n", F.lit("2")).unionByName(rows.limit(1).withColumn("x", F.lit("ab"))).unionByName(rows.limit(1))
    assert other.select(identity.semantic_fingerprint(*map(F.col, "cntxw")).alias("f")).distinct().count() == 3


def test_texts_are_compacted_once(spark):
    """Groups of equivalent terms bind the compacted text, so its expression does not stand once for each term, and texts of one file are dealt out."""
    from lintel.plans import texts as P

    rows = spark.createDataFrame([("몰탈을 충진 한다",), ("plain",), ("",), (None,)], "t string")
    plan = rows.select(text.matched_groups(F.col("t")).alias("g"), text.normalize_key(F.col("t")).alias("k"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("\\s+") <= 6
    got = plan.collect()
    assert got[0]["g"] == [0, 4] and got[0]["k"] == "몰탈을충진한다몰탈모르타르모르터사춤충진충전"
    assert [tuple(r) for r in got[1:]] == [([], "plain"), ([], ""), ([], "")]
    assert P._docs(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
