from pyspark.sql import functions as F

from lintel.operators import coverage
from lintel.plans.sources import word_file
from lintel.sources import documents as S


def test_word_file_headings_and_context():
    body = "<w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>A</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>B</w:t></w:r></w:p><w:p><w:r><w:t>x</w:t></w:r></w:p><w:p/>"
    rows = S.word_clauses(word_file(body))
    assert [(r[1], r[2], r[4], r[5]) for r in rows] == [("heading", 0, "A", ""), ("heading", 1, "B", "A"), ("paragraph", None, "x", "A > B")]


def test_spans_stop_at_their_end():
    rows = S.table_rows("<table><tr><td rowspan=2>a<td>b</tr><tr><td>c</tr><tr><td>d<td>e</tr></table>")
    assert [r[2] for r in rows] == [["a", "b"], ["a", "c"], ["d", "e"]]


def test_chunks_keep_every_character():
    text = "One sentence. " * 50 + "x" * 300 + " \n"
    parts = S.split_chunks(text, 100)
    assert max(map(len, parts)) <= 100 and "".join(parts) == text and all(p.endswith(".") for p in parts[:5])
    assert S.split_chunks(None, 10) == [""]


def test_texts_are_cut_in_small_batches(spark):
    """Thousands of long texts are not handed to Python at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    rows = spark.range(20).selectExpr("id AS clause", "1 AS n", "'r' AS ref", "repeat('x', 30000) AS text")
    got = coverage.planned_calls(rows.drop("ref"), rows)
    assert int(spark.conf.get(name)) <= 4 << 20
    assert {(r["calls"], r["allowed"]) for r in got.collect()} == {(1, True)}


def test_chunk_lengths_are_those_of_the_chunks(spark):
    """The arithmetic and the patterns cut as the plain program does, whatever breaks and characters a text has; and no Python takes part."""
    texts = ["", "x" * 999, "x" * 50 + ". " + "x" * 70, "ab c\n\td. " * 40, "가나다、라 마。" * 30, "x😀" * 200, "😀.x " * 100, "\n" * 45, "x" * 16 + "." + "x" * 20]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    for most in (1, 2, 7, 32):
        got = rows.select("i", S.chunk_lengths(F.col("t"), most).alias("n"))
        assert "Eval" not in got._jdf.queryExecution().toString()
        assert {r["i"]: r["n"] for r in got.collect()} == {i: [len(p) for p in S.split_chunks(t, most)] for i, t in enumerate([*texts, None])}


def test_planned_calls_keep_texts_out_of_python(spark):
    """They are only measured, which took most of the time of a table of them."""
    rows = spark.range(3).selectExpr("id AS clause", "1 AS n", "'r' AS ref", "repeat('x', 100000) AS text")
    got = coverage.planned_calls(rows.drop("ref"), rows)
    assert "Eval" not in got._jdf.queryExecution().toString()
    assert {(r["calls"], r["allowed"]) for r in got.collect()} == {(3, True)}


def test_spans_fill_rectangles():
    rows = S.table_rows("<table><tr><td rowspan=3 colspan=2>a<td>b</tr><tr><td rowspan=9>c<td>d</tr><tr></tr></table>")
    assert [r[2] for r in rows] == [["a", "a", "b"], ["a", "a", "c", "d"], ["a", "a", "c"]]


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "KCS_413402.json").write_text('[{"code":"413402","version":"9","list":[]},{"code":"413402","version":"10","updateDate":"x","list":[{"label":"1","title":"t","contents":"c"}]}]')
    rows = S.latest_versions(S.read_corpus(spark, str(tmp_path)))
    assert [(r["code"], r["version"]) for r in rows.collect()] == [("413402", "10")]
    assert S.sections(rows).count() == 1
