"""Text operators over the driver's tables, and over literal clauses where those hold no such text.

The SQL of literal cases states the rows that are expected, so that it does not depend on a second regular-expression dialect."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel.functions import identity as D
from lintel.functions import quantities as N
from lintel.functions import terms as T
from lintel.functions import text as X
from lintel.plans.registry import dealt, query, table

CLEAN = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x0B\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{3000}}]+', ' ', 'g'))"


def _docs(spark, sf_dir):
    """One file may be one task, so texts are dealt out before anything is made of them."""
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("T01_clean_space", f"SELECT doc_id, sha256({CLEAN.format('text')}) AS cleaned, length({CLEAN.format('text')}) AS n FROM documents")
def clean_space(spark, sf_dir):
    c = X.clean_space(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(c, 256).alias("cleaned"), F.length(c).cast("long").alias("n"))


def _sql_group(compact: str, g: list[str]) -> str:
    return " OR ".join(f"contains({compact}, '{''.join(t.split()).lower()}')" for t in g)


_COMPACT = r"lower(regexp_replace(coalesce(text, ''), '\s+', '', 'g'))"
_EXPANDED = "trim(text || ' ' || concat_ws(' '" + "".join(f", CASE WHEN {_sql_group('compact', g)} THEN '{' '.join(g)}' END" for g in T.EQUIVALENT_TERMS) + "))"


@query("T03_expand_terms", f"SELECT doc_id, sha256({CLEAN.format(_EXPANDED)}) AS expanded FROM (SELECT doc_id, text, {_COMPACT} AS compact FROM documents)")
def expand_terms(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.expand_terms(F.col("text")), 256).alias("expanded"))


@query("T04_normalize_key", f"SELECT doc_id, sha256(regexp_replace(lower({_EXPANDED}), '[^0-9a-z가-힣]', '', 'g')) AS key FROM (SELECT doc_id, text, {_COMPACT} AS compact FROM documents)")
def normalize_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.normalize_key(F.col("text")), 256).alias("key"))


@query("T15_matched_groups", f"SELECT doc_id, concat_ws(','{''.join(f', CASE WHEN {_sql_group(_COMPACT, g)} THEN {chr(39)}{i}{chr(39)} END' for i, g in enumerate(T.EQUIVALENT_TERMS))}) AS groups FROM documents")
def matched_groups(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(X.matched_groups(F.col("text")).cast("array<string>"), ",").alias("groups"))


_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<img\b[^>]*>', ' ', 'gis'), 'data:image/[^;]+;base64,[A-Za-z0-9+/=]+', ' ', 'gi'), '<br\s*/?>|</(?:p|div|tr|li|td|th)>', ' ', 'gi'), '<[^>]+>', ' ', 'gs')"
#: The references that the given pages hold, the ampersand last.
_DECODED = f"regexp_replace(replace(replace(replace({_STRIPPED}, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '\"'), '&amp;?', '&', 'g')"


@query("T05_strip_html", f"SELECT page_id, sha256({CLEAN.format(_DECODED)}) AS stripped, length({CLEAN.format(_DECODED)}) AS n FROM pages")
def strip_html(spark, sf_dir):
    text = X.strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text, 256).alias("stripped"), F.length(text).cast("long").alias("n"))


_BASIC = r"regexp_replace(regexp_replace(html, '<br\s*/?>|</(?:p|div|li|tr|td|th|h[1-6])>', ' ', 'gi'), '<[^>]+>', ' ', 'g')"


@query("T06_strip_html_basic", f"SELECT page_id, sha256({CLEAN.format('s')}) AS stripped FROM (SELECT page_id, replace(replace(replace(replace({_BASIC}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS s FROM pages)")
def strip_html_basic(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.strip_html_basic(F.col("html")), 256).alias("stripped"))


@query("T07_format_code", "SELECT p_partkey, CASE WHEN length(d) >= 6 THEN 'KCS ' || substr(d, 1, 2) || ' ' || substr(d, 3, 2) || ' ' || substr(d, 5) WHEN length(d) = 4 THEN 'KCS ' || substr(d, 1, 2) || ' ' || substr(d, 3, 2) ELSE 'KCS ' || d END AS code FROM (SELECT p_partkey, CAST(p_partkey * 317 AS VARCHAR) AS d FROM part)")
def format_code(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.format_code((F.col("p_partkey") * 317).cast("string")).alias("code"))


@query("T08_code_digits", "SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits FROM part")
def code_digits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.digits(F.col("p_brand")).alias("digits"))


@query("T09_version_key", "SELECT p_brand, max(CAST(regexp_replace(p_name, '[^0-9]', '', 'g') || p_size AS BIGINT)) AS version FROM part GROUP BY p_brand")
def version_key(spark, sf_dir):
    key = X.version_key(F.concat(F.col("p_name"), F.col("p_size").cast("string")), F.col("p_type"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max(key)["version"].cast("long").alias("version"))


_KEY = "regexp_replace(lower(text), '[^0-9a-z]', '', 'g')"


@query("T10_char_ngrams", f"SELECT n, count(*) AS grams, count(DISTINCT g) AS kinds FROM (SELECT n, unnest(list_transform(range(1, length(k) - n + 2), lambda i: substr(k, i, n))) AS g FROM (SELECT {_KEY} AS k FROM documents), (SELECT unnest([2, 3, 4]) AS n)) GROUP BY n")
def char_ngrams(spark, sf_dir):
    return _gram_counts(_docs(spark, sf_dir))


def _gram_counts(docs):
    key = F.regexp_replace(F.lower(F.col("text")), "[^0-9a-z]", "")
    rows = docs.repartition("doc_id").select(F.explode(X.char_ngrams(key)).alias("g"))
    kinds = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return kinds.groupBy(F.length("g").alias("n")).agg(F.sum("n").alias("grams"), F.count(F.lit(1)).alias("kinds"))


_TOKENS = r"regexp_extract_all(lower(text), '[A-Za-z가-힣]{2,}|\d+(?:\.\d+)?')"


@query("T11_word_tokens", f"SELECT doc_id, len(t) AS n, sha256(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def word_tokens(spark, sf_dir):
    t = X.word_tokens(F.col("text"), expand=False)
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("tokens"))


@query("T12_token_set", f"SELECT doc_id, len(list_distinct({_TOKENS})) AS kinds FROM documents")
def token_set(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(X.token_set(F.col("text"))).cast("long").alias("kinds"))


@query("T13_search_text", "SELECT doc_id, sha256(source || ' ' || lang || ' ' || substr(text, 1, 20) || ' ' || substr(text, 1, 20) || ' ' || text) AS search FROM documents")
def search_text(spark, sf_dir):
    s = X.section_search_text(F.col("source"), F.col("lang"), F.substring("text", 1, 20), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(s, 256).alias("search"))


@query("T43_literal_contains", "SELECT doc_id FROM documents WHERE contains(text, '%%') OR contains(text, 'a_b')")
def literal_contains(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.col("text").contains("%%") | F.col("text").contains("a_b")).select("doc_id")


@query("T44_safe_cells", r"SELECT doc_id, sha256(CASE WHEN regexp_matches(text, '^\s*[=+\-@]') THEN '''' || text ELSE text END) AS cell, trim(regexp_replace(substr(text, 1, 40), '[\\/:*?""<>|\x00-\x1f]', '_', 'g')) AS file FROM documents".replace('""', '"'))
def safe_cells(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.safe_cell(F.col("text")), 256).alias("cell"), X.safe_filename(F.substring("text", 1, 40)).alias("file"))


@query("T45_score_bands", "SELECT band, count(*) AS n FROM (SELECT CASE WHEN l_discount IS NULL THEN 'none' WHEN l_quantity / 50 >= 0.45 THEN 'high' WHEN l_quantity / 50 >= 0.35 THEN 'medium' ELSE 'low' END AS band FROM lineitem) GROUP BY band")
def score_bands(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(X.score_band(F.col("l_quantity") / 50).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("T38_fingerprint", "SELECT n_nationkey, sha256('{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}') AS fingerprint FROM nation")
def fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", D.fingerprint({"key": F.col("n_nationkey"), "name": F.col("n_name"), "region": F.col("n_regionkey")}).alias("fingerprint"))


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query("T39_name_ids", f"SELECT n_nationkey, {_UUID} AS id FROM (SELECT n_nationkey, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(n_name)) AS h FROM nation)")
def name_ids(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", D.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.col("n_name")).alias("id"))


_LINES = r"list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda x: " + CLEAN.format("x") + ")"
_SENTENCES = r"list_filter(list_transform(flatten(list_transform(" + _LINES + r", lambda x: string_split(regexp_replace(regexp_replace(x, '([.!?。;；])\s+', '\1' || chr(10), 'g'), '([.!?。;；])([가-힣A-Za-z(\[])', '\1' || chr(10) || '\2', 'g'), chr(10)))), lambda x: trim(x)), lambda x: x <> '')"


@query("T41_sentences", f"SELECT doc_id, len(s) AS n, sha256(array_to_string(s, chr(10))) AS segments FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def sentence_segments(spark, sf_dir):
    s = X.sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n"), F.sha2(F.array_join(s, "\n"), 256).alias("segments"))


@query("T47_table_cells", "SELECT doc_id, len(string_split(text, ' | ')) AS cells, trim(string_split(text, ' | ')[1]) AS first FROM documents WHERE contains(text, ' | ')")
def table_cells(spark, sf_dir):
    cells = X.table_cells(F.col("text"))
    return _docs(spark, sf_dir).where(F.col("text").contains(" | ")).select("doc_id", F.size(cells).cast("long").alias("cells"), cells[0].alias("first"))


# literal cases: (name, columns of the input, inputs, expression, expected)
def _literal(name: str, inputs: list[tuple], expression, expected: list) -> None:
    quote = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(v)})" for i, v in enumerate(expected))

    @query(name, f"SELECT * FROM (VALUES {rows}) AS t(n, result)")
    def run(spark, sf_dir):
        names = ["a", "b", "c", "d"][: len(inputs[0])]
        data = spark.createDataFrame([(i, *x) for i, x in enumerate(inputs)], "n int, " + ", ".join(f"{c} string" for c in names))
        return data.select("n", expression(*[F.col(c) for c in names]).alias("result"))


_text = lambda c: F.array_join(c, "|")
_pairs = lambda c: _text(F.transform(c, lambda q: F.concat_ws(" ", q["number"], q["unit"])))
_literal("T02_references", [("강판은 KSD-3503, ks d 3515 및 KS F 4009에 따른다",), ("XKSD 3503 KS D 12",), (None,)], X.normalize_references, ["강판은 KS D 3503, KS D 3515 및 KS F 4009에 따른다", "XKSD 3503 KS D 12", ""])
_literal("T14_referenced_codes", [("KCS 41 34 02 및 kcs-14-31-10, KCS413402",), ("KCS 4134",), (None,)], lambda a: _text(X.referenced_codes(a)), ["413402|143110", "", ""])
_literal("T16_keyword_prefixes", [("조적 및 미장 공사",), ("철골세우기",), ("일반",)], lambda a: _text(X.keyword_prefixes(a)), ["4134|4146", "4131|1431", ""])
_literal("T17_reference_words", [("상기 기준에 따른다",), ("다음 표에 따른다",), ("독립 요구사항",), ("표 3과 같이 한다",)], lambda a: F.concat_ws(",", F.when(X.refers_back(a), "back"), F.when(X.refers_ahead(a), "ahead"), F.when(X.clause_refers_back(a), "clause-back"), F.when(X.clause_refers_ahead(a), "clause-ahead")), ["back,clause-back", "ahead,clause-ahead", "", "ahead,clause-ahead"])
_literal("T18_quantities", [("두께 1,000 ㎜ 이상, 온도 20 ℃, 강도 24.50 MPa",), ("폭 1.0m 및 1 m, -5°C",), ("3.1 개 요",), (None,)], lambda a: _pairs(N.quantities(a)), ["20 ℃|24.5 MPa|1000 mm", "-5 ℃|1 m", "3.1 개", ""])
_literal("T19_canonical_quantities", [("1 m",), ("1,000 mm",), ("2.5 kN",), ("3 회",)], lambda a: _text(F.transform(N.quantities(a), lambda q: F.concat_ws("=", N.canonical(q)["family"], F.regexp_replace(N.canonical(q)["value"].cast("string"), r"\.?0+$", "")))), ["length=1000", "length=1000", "force=2500", "회=3"])
_literal("T20_leading_quantity", [("1.5 m 이상",), ("3.1 개 요",), ("13.1 일반사항",), ("2회 이상",), ("5 개",), ("폭 3 m",)], N.starts_with_quantity, [True, False, False, True, True, False])
_literal("T21_topic_tokens", [("콘크리트의 강도는 시험으로부터 한다",), ("Steel 강판을 사용",), ("가 나",)], lambda a: _text(N.topic_tokens(a)), ["콘크리트|강도|시험", "steel|강판", ""])
_literal("T22_topic_overlap", [("콘크리트 강도", "고강도콘크리트 타설"), ("벽돌 쌓기", "타일 붙임"), ("강판을", "강판은")], N.topic_overlap, [True, False, True])
_literal("T23_normative_words", [("두께 3 mm 이상 5 mm 이하로 하여야 한다",), ("사용을 금지한다. 이상적인",), ("의무가 없다",)], lambda a: _text(F.concat(N.distinct_matches(T.LIMIT, a), N.distinct_matches(T.PROHIBITION, a), N.distinct_matches(T.OBLIGATION, a))), ["이상|이하|하여야 한다", "금지", ""])
_literal("T24_differences", [("벽돌 줄눈 두께는 10 mm 이상으로 한다", "벽돌 줄눈 두께는 8 mm 이하로 한다"), ("벽돌 폭 1 m", "벽돌 폭 1000 mm와 20 mm"), ("타일 10 회", "도장 20 회"), ("벽돌 사용을 금지하며 반드시 확인", "벽돌 확인"), (None, None)], lambda a, b: _text(N.differences(a, b)["categories"]), ["quantity|limit", "", "", "prohibition|obligation", ""])
_literal("T25_tolerance_warnings", [("폭 1 m 이상", "폭 1000 mm 이상"), ("폭 1 m 이상", "폭 1 m")], lambda a, b: F.size(N.warnings_by_tolerance(a, b)).cast("string"), ["0", "1"])
_literal("T26_own_requirement", [("벽돌", "벽돌 쌓기"), ("모르타르 배합비 1", "3으로 한다"), ("제목…", "본문"), ("", "본문")], X.own_requirement, ["벽돌 쌓기", "모르타르 배합비 1 : 3으로 한다", "제목 본문", "본문"])
_literal("T27_commercial_only", [("공사비 정산", "시공 방법"), ("비용은 시공하여야 한다", "시공"), ("대금 지급", "단가")], lambda a, b: F.concat_ws(",", X.commercial_only(a).cast("string"), X.clearly_unrelated(a, b).cast("string")), ["true,true", "false,false", "true,false"])
_literal("T28_masonry_conflict", [("내화 벽돌", "점토벽돌"), ("벽돌", "점토벽돌"), ("ALC 블록", "콘크리트블록"), ("블록", "벽돌"), ("벽돌 블록", "점토벽돌")], X.masonry_conflict, [True, False, True, True, False])
_literal("T29_mortar_mismatch", [("내화 모르타르", "단열 몰탈"), ("내화 몰탈", "내화모르터"), ("모르타르", "단열 몰탈")], X.named_mortar_mismatch, [True, False, False])
_literal("T30_evidence_present", [("[현재 요구사항] 두께 10 mm", "줄눈 두께10mm 이상"), ("두께", "두께"), ("없는 인용", "본문")], X.evidence_present, [True, False, False])
_literal("T31_verification_body", [("[원문 상위 문맥] 조적\n[현재 요구사항] 쌓기",), ("그냥 본문",), ("[KCS 상위 문맥] x",)], X.verification_body, ["쌓기", "그냥 본문", "[KCS 상위 문맥] x"])
_literal("T32_grades", [("SM275A, B, C, -TMC 및 SS275",), ("SM 355B",), ("XSM275A SM275 A1",), ("ＳＭ２７５Ａ，Ｂ",)], lambda a: _text(N.grades(a)), ["SM275A|SM275B|SM275C|SS275", "SM355B", "SM275", "SM275A|SM275B"])
_literal("T32_table_standards", [("KS D 3503, ksd3515",), ("KS D 350",), ("ＫＳ　Ｄ　３５０３",)], lambda a: _text(N.product_standards(a)), ["KS D 3503|KS D 3515", "", "KS D 3503"])
_literal("T35_unsupported_numbers", [("두께 10.5 및 20", "10.5 이상"), ("없음", "x")], lambda a, b: _text(N.unsupported_numbers(a, F.array(b))), ["20", ""])
_literal("T48_label_split", [("1.2.3 재료",), ("(3) 시공",), ("가. 일반",), ("본문",)], lambda a: F.concat_ws("|", X.split_label(a)["label"], X.split_label(a)["title"]), ["1.2.3|재료", "(3)|시공", "가.|일반", "|본문"])
_literal("E29_first_discipline", [("타일 및 조적",), ("방수",), ("x",)], lambda a: _text(X.first_discipline_prefixes(a)), ["4134", "4140", ""])
_literal("I04_semantic_fingerprint", [("KCS 41-34", "（１） 벽돌", "본문 Ａ"), ("kcs4134", "(1)  벽돌", "본문  a"), ("kcs4135", "(1) 벽돌", "본문 a")], lambda a, b, c: (D.semantic_fingerprint(a, F.lit("1"), b, c, F.array(F.lit("경고"), F.lit(" 경고 "))) == D.semantic_fingerprint(F.lit("KCS4134"), F.lit(" 1 "), F.lit("(1) 벽돌"), F.lit("본문 A"), F.array(F.lit("경고")))), [True, True, False])
