"""Queries of the readers and of the queues."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from lintel.functions import text as X
from lintel.plans.registry import query, table
from lintel.session import scratch
from lintel.sources import documents as S
from lintel.sources import standards as D
from lintel.streaming import queues as Q

_BODY = "<w:p><w:pPr><w:outlineLvl w:val='0'/></w:pPr><w:r><w:t>1. 일반사항</w:t></w:r></w:p><w:p><w:r><w:t>(1) 두께 10 mm 이상</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>강종</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>SM275A</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"


_NAMES = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main' xmlns:mc='http://schemas.openxmlformats.org/markup-compatibility/2006'"


def word_file(body: str, **parts: str) -> bytes:
    """A minimal Word file, with more parts (numbering, styles) if they are given."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_NAMES}><w:body>{body}</w:body></w:document>")
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", f"<w:{name} {_NAMES}>{xml}</w:{name}>")
    return out.getvalue()


_LISTS = "<w:abstractNum w:abstractNumId='7'><w:lvl w:ilvl='0'><w:start w:val='2'/><w:numFmt w:val='decimal'/><w:lvlText w:val='%1.'/></w:lvl><w:lvl w:ilvl='1'><w:numFmt w:val='lowerLetter'/><w:lvlText w:val='%1-%2)'/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId='8'><w:lvl w:ilvl='0'><w:numFmt w:val='bullet'/></w:lvl></w:abstractNum><w:num w:numId='1'><w:abstractNumId w:val='7'/></w:num><w:num w:numId='2'><w:abstractNumId w:val='8'/></w:num>"


def _numbered(text: str, number: int, level: int, more: str = "") -> str:
    return f"<w:p><w:pPr><w:numPr><w:ilvl w:val='{level}'/><w:numId w:val='{number}'/></w:numPr></w:pPr><w:r><w:t>{text}</w:t></w:r>{more}</w:p>"


def _box(text: str) -> str:
    return f"<w:txbxContent><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:txbxContent>"


@query("S07_numbers_and_boxes", "SELECT * FROM (VALUES (0, '2.', 'one'), (1, '2-a)', 'sub'), (2, '', 'in a box'), (3, '2-b)', 'sub'), (4, '3.', 'two'), (5, '3-a)', 'sub'), (6, '•', 'dot'), (7, '', 'old box'), (8, '4.', 'by style')) AS t(source_order, label, text)")
def numbers_and_boxes(spark, sf_dir):
    """Labels of lists, and text boxes behind the paragraph that holds them, each once."""
    twice = f"<mc:AlternateContent><mc:Choice>{_box('in a box')}</mc:Choice><mc:Fallback>{_box('in a box')}</mc:Fallback></mc:AlternateContent>"
    old = f"<mc:AlternateContent><mc:Choice/><mc:Fallback>{_box('old box')}</mc:Fallback></mc:AlternateContent>"
    styled = "<w:p><w:pPr><w:pStyle w:val='S'/></w:pPr><w:r><w:t>by style</w:t></w:r></w:p>"
    body = _numbered("one", 1, 0) + _numbered("sub", 1, 1, twice) + _numbered("sub", 1, 1) + _numbered("two", 1, 0) + _numbered("sub", 1, 1) + _numbered("dot", 2, 0, old) + styled
    styles = "<w:style w:styleId='S'><w:pPr><w:numPr><w:numId w:val='1'/></w:numPr></w:pPr></w:style>"
    files = spark.createDataFrame([("a.docx", bytearray(word_file(body, numbering=_LISTS, styles=styles)))], "path string, content binary")
    return S.read_word(files).select("source_order", "label", "text")


@query("S07_word_scan", "SELECT * FROM (VALUES ('a.docx', 0, 'heading', '1.', '1. 일반사항', ''), ('a.docx', 1, 'paragraph', '(1)', '(1) 두께 10 mm 이상', '1. 일반사항'), ('a.docx', 2, 'table', '', '강종 | SM275A', '1. 일반사항'), ('b.docx', 0, 'unreadable', '', '', '')) AS t(path, source_order, source_type, label, text, context)")
def word_scan(spark, sf_dir):
    files = spark.createDataFrame([("a.docx", bytearray(word_file(_BODY))), ("b.docx", bytearray(b"no zip"))], "path string, content binary")
    text = F.when(F.col("source_type") == "unreadable", "").otherwise(F.col("text"))
    return S.read_word(files).select("path", "source_order", "source_type", "label", text.alias("text"), "context")


_OUTLINE = "<w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>1. A &amp; B</w:t></w:r></w:p><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t xml:space='preserve'>  two</w:t></w:r></w:p><w:p><w:pPr><w:outlineLvl w:val='2'/></w:pPr><w:r><w:t>C</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p><w:pPr><w:pStyle w:val='제목2'/></w:pPr><w:r><w:t>가. D</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p>"


@query("S08_word_outline", "SELECT * FROM (VALUES ('a', 1, 'heading', 1, '1.', '1. A & B', ''), ('a', 2, 'paragraph', NULL, '', 'one two', '1. A & B'), ('a', 3, 'heading', 3, '', 'C', '1. A & B > '), ('a', 4, 'table', NULL, '표-4', 'x | y', '1. A & B >  > C'), ('a', 5, 'heading', 2, '가.', '가. D', '1. A & B'), ('a', 6, 'paragraph', NULL, '', 'text', '1. A & B > 가. D')) AS t(path, source_order, source_type, outline_level, label, content, context)")
def word_outline(spark, sf_dir):
    files = spark.createDataFrame([("a", bytearray(word_file(_OUTLINE))), ("b", bytearray(b"no zip"))], "path string, content binary")
    return D.word_outline(files)


_PAGE = "<table><tr><th>표준명(한글)</th><td> 벽돌 &amp; 블록</td></tr><tr><th> 최종개정확인일 </th><td>{0}</td></tr></table><button onclick=\"lookup('KSL1','07')\">x</button><button class=b onclick=\"open3('KSL1', '{1}','STD')\">y</button>"


@query("S17_editions", "SELECT * FROM (VALUES (0, '벽돌 & 블록', '07', '2026-01-02', 'machine'), (1, '벽돌 & 블록', '07', '2026-01-02', 'viewer_only'), (2, '벽돌 & 블록', '07', 'n/a', 'unknown'), (3, '', '', '', 'unknown')) AS t(n, name, revision, edition_date, status)")
def editions(spark, sf_dir):
    pages = [_PAGE.format("2026-01-02", "07"), _PAGE.format("2026-01-02", "06"), _PAGE.format("n/a", "07"), "<p>none</p>"]
    rows = spark.createDataFrame([("KS L 1", h) for h in pages], "standard string, html string").withColumn("n", F.lit(None).cast("int"))
    parts = [D.edition(rows.where(F.col("html") == h)).withColumn("n", F.lit(i)) for i, h in enumerate(pages)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).select("n", "name", "revision", "edition_date", "status")


_MACHINE = '{{"info":{{"tmprKsNo":"KSL1","reformNo":"{0}","activeYn":"Y","formType":"STD","operationDate":"2026. 1. 2."}},"content":[{{"NUMBERING":"1","TITLE_NUMBERING":"<b>1 범위</b>","CONTENT":"<p>벽돌</p><script>x</script>"}},{{"NUMBERING":"1.1","TITLE_NUMBERING":"1.1 치수","CONTENT":"<table><tr><td>a</td><td>b</td></tr></table><div class=\\"jb-serach-text\\">광고</div>"}},{{"NUMBERING":"2","TITLE_NUMBERING":"2 시험","CONTENT":"강도"}},{{"NUMBERING":"표 1","TITLE_NUMBERING":"","CONTENT":"z"}},{{"NUMBERING":"3","TITLE_NUMBERING":"3 빈","CONTENT":" "}}]}}'


@query("S17_machine_sections", "SELECT * FROM (VALUES ('1', '1 범위 벽돌', '1 범위'), ('1.1', '1.1 치수 a | b |', '1 범위 > 1.1 치수'), ('2', '2 시험 강도', '2 시험')) AS t(section, text, title_path)")
def machine_sections(spark, sf_dir):
    files = [("KS L 1", "07", "2026-01-02", _MACHINE.format("07")), ("KS L 1", "07", "2026-01-02", _MACHINE.format("06")), ("KS L 1", "07", "2026-01-03", _MACHINE.format("07"))]
    return D.machine_sections(spark.createDataFrame(files, "standard string, revision string, edition_date string, value string")).select("section", "text", "title_path")


@query("K07_atomic_json", "SELECT CAST(count(*) AS BIGINT) AS n, sum(n_regionkey) AS keys FROM nation")
def atomic_json(spark, sf_dir):
    """A snapshot's totals written twice, the second in place of the first, and read back."""
    path = f"{scratch(spark, 'json')}/snapshot.json"
    row = table(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("n"), F.sum("n_regionkey").alias("keys")).first()
    for payload in ({"n": -1, "keys": 0}, row.asDict()):
        D.write_json(spark, path, payload)
    return spark.read.schema("n long, keys long").json(path, multiLine=True)


@query("S13_table_scan", "SELECT * FROM (VALUES (1, 0, 0, 'KS|A|B'), (1, 0, 1, 'D 3503|SM275|x y'), (1, 0, 2, 'D 3503|SS275|z'), (1, 0, 3, 'E|E|w')) AS t(id, \"table\", \"row\", cells)")
def table_scan(spark, sf_dir):
    html = "<table><tr><th>KS<th>A<th>B</tr><tr><td rowspan=2>D 3503</td><td>SM275</td><td>x\n y</td></tr><tr><td>SS275<td>z</tr><tr><td colspan=2>E</td><td>w</td></tr></table>"
    rows = S.read_tables(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id", "html")
    return rows.select("id", "table", "row", F.array_join("cells", "|").alias("cells"))


_JSON = '[{"code":"413402","version":"2020","updateDate":"a","name":"n","list":[{"label":"1","title":"t","contents":"x"},{"label":"1","title":"t","contents":"x"},{"label":"2","title":"","contents":" "}]},{"code":"413402","version":"2023","updateDate":"b","name":"m","list":[{"label":"1","title":"u","contents":"y"}]},{"code":"999999","version":"2030","list":[]}]'


@query("S02_corpus_versions", "SELECT '413402' AS code, '2023' AS version, '1' AS label, 'y' AS content")
def corpus_versions(spark, sf_dir):
    files = spark.createDataFrame([("413402", _JSON)], "file_code string, value string")
    return S.sections(S.latest_versions(S.versions(files))).select("code", "version", "label", "content")


_VERSIONS = {
    "KCS_413402.json": [{"codeType": "KCS", "code": "413402", "version": "2020", "updateDate": "a", "name": "n", "list": []}, {"codeType": "KCS", "code": "413402", "version": "2023", "updateDate": "b", "name": "벽돌", "list": [{"label": "1", "title": "재료", "contents": "벽돌은 KS L 4201에 따른 벽돌을 사용한다."}, {"label": "2", "title": "재료", "contents": "상기 기준에 따른다."}, {"label": "3", "title": "쌓기", "contents": "다음 표에 따른다."}, {"label": "4", "title": "표", "contents": "줄눈 두께는 10 mm를 표준으로 하여야 한다."}, {"label": "5", "title": "", "contents": " "}]}],
    "KCS_999999.json": [{"codeType": "KCS", "code": "000000", "version": "1", "list": [{"label": "1", "title": "t", "contents": "x"}]}],
    "other.json": [{"code": "1"}],
}


def _corpus(spark):
    folder = scratch(spark, "corpus")
    for name, payload in _VERSIONS.items():
        D.write_json(spark, f"{folder}/{name}", payload)
    return S.sections(S.latest_versions(S.read_corpus(spark, f"{folder}/*.json")))


@query("S01_corpus_folder", "SELECT * FROM (VALUES ('413402', '2023', '1', '재료'), ('413402', '2023', '2', '재료'), ('413402', '2023', '3', '쌓기'), ('413402', '2023', '4', '표')) AS t(code, version, label, title)")
def corpus_folder(spark, sf_dir):
    """A folder of corpus files: the code must be its file's, the version the last, the section not empty."""
    return _corpus(spark).select("code", "version", "label", "title")


@query("S05_section_context", "SELECT * FROM (VALUES ('1', '', '다음 표에 따른다.'), ('2', '벽돌은 KS L 4201에 따른 벽돌을 사용한다.', '다음 표에 따른다.'), ('3', '', '줄눈 두께는 10 mm를 표준으로 하여야 한다.'), ('4', '', '')) AS t(label, back, ahead)")
def section_context(spark, sf_dir):
    """What a section that refers back means, and what follows one: text, not a title, that does not itself refer back."""
    text = F.col("content")
    own = (X.normalize_key(text) != X.normalize_key(F.col("title"))) & ~X.refers_back(text)
    return S.with_context(_corpus(spark), X.refers_back(text), own).select("label", F.coalesce("back", F.lit("")).alias("back"), F.coalesce("ahead", F.lit("")).alias("ahead"))


@query("X02_first_by_stream", "SELECT DISTINCT user_id, event_type FROM events")
def first_by_stream(spark, sf_dir):
    """Keys that a stream enqueues: a repeated key adds nothing."""
    base = scratch(spark, "first")
    keys = Q.first_per_key(Q.event_stream(spark, sf_dir).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "event_type"], "ts", "36500 days")
    keys.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "event_type")


@query("X01_status_windows", "SELECT event_type AS status, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def status_windows(spark, sf_dir):
    """Statuses by the hour, as the stream updates them; the last update of a window counts."""
    base = scratch(spark, "windows")
    counts = Q.status_counts(Q.event_stream(spark, sf_dir).select(F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts")), "ts")
    Q.run_queue(counts.select("status", F.col("window.start").alias("hour"), "n"), f"{base}/out", f"{base}/state", lambda df: df, ["hour", "status"], mode="update").awaitTermination()
    rows = spark.read.parquet(f"{base}/out").groupBy("status", "hour").agg(F.max("n").alias("n"))
    return rows.select("status", F.col("hour").cast("timestamp_ntz").alias("hour"), "n")


@query("T40_chunks", "SELECT doc_id, sha256(coalesce(text, '')) AS joined, true AS short, length(coalesce(text, '')) <= 2000 AS one FROM documents")
def chunks(spark, sf_dir):
    """Pieces of every document: together they are the text, and none is too long."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", S.chunks(F.col("text"), 2000).alias("p"))
    return pieces.select("doc_id", F.sha2(F.array_join("p", ""), 256).alias("joined"), F.forall("p", lambda x: F.length(x) <= 2000).alias("short"), (F.size("p") == 1).alias("one"))


@query("T40_cuts", "SELECT * FROM (VALUES (0, 'ab, cde |fgh'), (1, 'abcdefgh|ij'), (2, 'abcdef |gh.ijk'), (3, 'a；bcde；|fg'), (4, ''), (5, 'a.bcdefg|hi')) AS t(n, pieces)")
def cuts(spark, sf_dir):
    texts = ["ab, cde fgh", "abcdefghij", "abcdef gh.ijk", "a；bcde；fg", None, "a.bcdefghi"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    return rows.select("n", F.array_join(S.chunks(F.col("t"), 8), "|").alias("pieces"))


@query("T41_segments", "SELECT * FROM (VALUES (1, 1, '가나다.', false), (1, 2, '라마바 사', false), (1, 3, '아자차카타파하 ', true), (1, 4, '거너더', true), (2, 1, '(1) x;', false), (2, 2, 'y', false)) AS t(id, n, segment, was_split)")
def segments(spark, sf_dir):
    rows = spark.createDataFrame([(1, "가나다.라마바\u00a0사\n아자차카타파하 거너더"), (2, " (1)  x; y "), (3, None)], "id int, t string")
    return S.source_segments(rows, "id", "t", 10)


@query("T42_greedy_batches", "SELECT * FROM (VALUES (0, '0,0,1,1,2'), (1, '0,0,0'), (2, '')) AS t(n, batches)")
def greedy_batches(spark, sf_dir):
    data = spark.createDataFrame([(0, [5, 4, 3, 7, 9]), (1, [1, 1, 1]), (2, [])], "n int, lengths array<long>")
    return data.select("n", F.array_join(S.greedy_batches(F.col("lengths"), 3, 10).cast("array<string>"), ",").alias("batches"))


@query("X01_stream", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark, sf_dir):
    """The events file as a stream that is worked off in order, a folder a batch; the statuses of what came out."""
    base = scratch(spark, "x01")
    Q.run_queue(Q.event_stream(spark, sf_dir), f"{base}/out", f"{base}/state", lambda df: df.select("event_id", "event_type"), ["ts", "event_id"]).awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("X01_latest_by_stream", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_by_stream(spark, sf_dir):
    """The last event of each user, kept by a stream."""
    base = scratch(spark, "latest")
    Q.keep_latest(Q.event_stream(spark, sf_dir).select("user_id", "event_id"), f"{base}/out", f"{base}/state", ["user_id"], "event_id").awaitTermination()
    return Q.kept(spark, f"{base}/out")


@query("X03_illegal_steps", "SELECT * FROM (VALUES ('a', 3), ('b', 2)) AS t(entity, seq)")
def illegal_steps(spark, sf_dir):
    events = spark.createDataFrame([("a", 1, "queued"), ("a", 2, "running"), ("a", 3, "queued"), ("b", 1, "queued"), ("b", 2, "completed"), ("c", 1, "queued")], "entity string, seq int, status string")
    return Q.illegal(events, "upload").select("entity", "seq")
