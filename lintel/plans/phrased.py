"""The rules on Korean texts over tables: sentences are phrased from an order's key, and DuckDB says from the key alone what must come out.

The SQL parses nothing: it knows what was said. So a query holds its function against millions of numbers, units, codes and their spellings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lintel.functions import identity as D
from lintel.functions import links as L
from lintel.functions import quantities as N
from lintel.functions import terms as T
from lintel.functions import text as X
from lintel.operators import coverage as C
from lintel.operators import review as V
from lintel.operators import screening as G
from lintel.plans.registry import dealt, query, table
from lintel.sources.documents import greedy_batches


def _pick(values: list[str], n: str) -> str:
    """One of some words by a number, in Spark's SQL."""
    return f"element_at(array({', '.join(repr(v) for v in values)}), CAST(({n}) % {len(values)} AS INT) + 1)"


def _cases(values: list, n: str) -> str:
    """One of some results by a number, in DuckDB's SQL; the first stands for number 0."""
    quote = lambda v: str(v).upper() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN ({n}) % {len(values)} = {i} THEN {quote(v)}" for i, v in enumerate(values)) + " END"


def _phrased(name: str, said: list[str], rule: Callable[..., Column], known: str) -> None:
    """`said` are expressions of o_orderkey, called k, that phrase the texts of a rule; `known` is the result, by k."""

    @query(name, f"SELECT k, {known} AS result FROM (SELECT o_orderkey AS k FROM orders)")
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select("k", *[F.expr(s).alias(f"t{i}") for i, s in enumerate(said)])
        return rows.select("k", rule(*[F.col(f"t{i}") for i in range(len(said))]).alias("result"))


_text = lambda c: F.array_join(c, "|")
_pairs = lambda c: _text(F.transform(c, lambda q: F.concat_ws(" ", q["number"], q["unit"])))
_n = "CAST(1000 + k % 9000 AS STRING)"
_n_sql = "CAST(1000 + k % 9000 AS VARCHAR)"

_phrased("T02_all_references", [f"concat('강판은 ', CASE k % 3 WHEN 0 THEN 'KSD-' WHEN 1 THEN 'ks d ' ELSE 'KS D ' END, {_n}, ', 봉강은 KS D ', {_n}, '에 따른다')"], X.normalize_references, f"'강판은 KS D ' || {_n_sql} || ', 봉강은 KS D ' || {_n_sql} || '에 따른다'")

_code = "lpad(CAST(k * 7 % 100 AS STRING), 2, '0'), {0}, lpad(CAST(k % 89 AS STRING), 2, '0'), {0}, lpad(CAST(k % 53 AS STRING), 2, '0')"
_phrased(
    "T14_all_referenced_codes", [f"CASE k % 3 WHEN 0 THEN concat('KCS ', {_code.format(chr(39) + ' ' + chr(39))}, ' 및 본문') WHEN 1 THEN concat('본문 kcs-', {_code.format(chr(39) + '-' + chr(39))}) ELSE concat('KCS ', lpad(CAST(k % 100 AS STRING), 2, '0')) END"],
    lambda a: _text(X.referenced_codes(a)), "CASE WHEN k % 3 = 2 THEN '' ELSE lpad(CAST(k * 7 % 100 AS VARCHAR), 2, '0') || lpad(CAST(k % 89 AS VARCHAR), 2, '0') || lpad(CAST(k % 53 AS VARCHAR), 2, '0') END",
)

_trades = ["조적 및 미장 공사", "철골세우기", "일반"]
_phrased("T16_all_keyword_prefixes", [f"concat({_pick(_trades, 'k')}, ' 제', CAST(k AS STRING))"], lambda a: _text(X.keyword_prefixes(a)), _cases(["4134|4146", "4131|1431", ""], "k"))
_phrased("E29_all_first_discipline", [f"concat({_pick(['타일 및 조적', '방수', 'x'], 'floor(k / 5)')}, ' ', CAST(k AS STRING))"], lambda a: _text(X.first_discipline_prefixes(a)), _cases(["4134", "4140", ""], "k // 5"))

_words = ["상기 기준에 따른다", "다음 표에 따른다", "독립 요구사항", "표 {0}과 같이 한다"]
_phrased(
    "T17_all_reference_words", [f"replace({_pick(_words, 'k')}, '{{0}}', CAST(k % 40 + 1 AS STRING))"],
    lambda a: F.concat_ws(",", F.when(X.refers_back(a), "back"), F.when(X.refers_ahead(a), "ahead"), F.when(X.clause_refers_back(a), "clause-back"), F.when(X.clause_refers_ahead(a), "clause-ahead")),
    _cases(["back,clause-back", "ahead,clause-ahead", "", "ahead,clause-ahead"], "k"),
)

# thousands with a comma, hundredths with a trailing zero
_mm = "concat(CAST(1 + k % 9 AS STRING), ',', lpad(CAST(k % 1000 AS STRING), 3, '0'))"
_mpa = "concat(CAST(20 + k % 50 AS STRING), '.', CAST(1 + k % 9 AS STRING), '0')"
_phrased(
    "T18_all_quantities", [f"concat('두께 ', {_mm}, ' ㎜ 이상, 강도 ', {_mpa}, ' MPa')"], lambda a: _text(F.array_sort(F.transform(N.quantities(a), lambda q: F.concat_ws(" ", q["unit"], q["number"])))),
    "'MPa ' || (20 + k % 50) || '.' || (1 + k % 9) || '|mm ' || (1000 * (1 + k % 9) + k % 1000)",
)
_phrased(
    "T19_all_canonical_quantities", ["concat('길이 ', CAST(1 + k % 700 AS STRING), CASE k % 3 WHEN 0 THEN ' m' WHEN 1 THEN ' mm' ELSE ' kN' END)"],
    lambda a: _text(F.transform(N.quantities(a), lambda q: F.concat_ws("=", N.canonical(q)["family"], N.canonical(q)["value"].cast("decimal(38,0)").cast("string")))),
    "CASE k % 3 WHEN 0 THEN 'length=' || 1000 * (1 + k % 700) WHEN 1 THEN 'length=' || (1 + k % 700) ELSE 'force=' || 1000 * (1 + k % 700) END",
)
_phrased("T20_all_leading_quantities", ["CASE k % 4 WHEN 0 THEN concat(CAST(1 + k % 90 AS STRING), '.5 m 이상') WHEN 1 THEN concat(CAST(1 + k % 9 AS STRING), '.1 개 요') WHEN 2 THEN concat(CAST(2 + k % 9 AS STRING), '회 이상') ELSE concat('폭 ', CAST(k % 50 AS STRING), ' m') END"], N.starts_with_quantity, _cases([True, False, True, False], "k"))
_particles = ["의", "는", "을", "으로부터"]
_phrased("T21_all_topic_tokens", [f"concat({_pick(['콘크리트', '강판', '모르타르'], 'k')}, {_pick(_particles[:1], 'k')}, ' 강도는 시험으로부터 한다')"], lambda a: _text(N.topic_tokens(a)), _cases(["콘크리트|강도|시험", "강판|강도|시험", "모르타르|강도|시험"], "k"))
_sides = ["콘크리트 강도", "벽돌 쌓기", "강판을", "타일 붙임"]
_phrased("T22_all_topic_overlap", [_pick(_sides, "k"), _pick(["고강도콘크리트 타설", "타일 붙임", "강판은", "벽돌 치수"], "floor(k / 4)")], N.topic_overlap, "(k % 4 = 0 AND k // 4 % 4 = 0) OR (k % 4 = 2 AND k // 4 % 4 = 2) OR (k % 4 = 1 AND k // 4 % 4 = 3) OR (k % 4 = 3 AND k // 4 % 4 = 1)")
_phrased(
    "T23_all_normative_words", ["concat('두께 ', CAST(k % 90 AS STRING), ' mm', CASE WHEN k % 2 = 0 THEN ' 이상' ELSE '' END, CASE WHEN k % 3 = 0 THEN ' 이하' ELSE '' END, CASE WHEN k % 5 = 0 THEN '로 하여야 한다' ELSE '' END, CASE WHEN k % 7 = 0 THEN '. 사용을 금지한다' ELSE '' END)"],
    lambda a: _text(F.concat(N.distinct_matches(T.LIMIT, a), N.distinct_matches(T.PROHIBITION, a), N.distinct_matches(T.OBLIGATION, a))),
    "array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN '이상' END, CASE WHEN k % 3 = 0 THEN '이하' END, CASE WHEN k % 7 = 0 THEN '금지' END, CASE WHEN k % 5 = 0 THEN '하여야 한다' END], lambda x: x IS NOT NULL), '|')",
)
_thick = "concat('벽돌 줄눈 두께는 ', CAST(8 + k % 5 AS STRING), ' mm', {0}, '으로 한다')"
_phrased(
    "T24_all_differences", [_thick.format("' 이상'"), _thick.format("CASE WHEN k % 2 = 0 THEN ' 이상' ELSE ' 이하' END").replace("k % 5", "floor(k / 5) % 5")], lambda a, b: _text(N.differences(a, b)["categories"]),
    "array_to_string(list_filter([CASE WHEN k % 5 <> k // 5 % 5 THEN 'quantity' END, CASE WHEN k % 2 = 1 THEN 'limit' END], lambda x: x IS NOT NULL), '|')",
)
_phrased("T25_all_tolerance_warnings", ["concat('폭 ', CAST(1 + k % 30 AS STRING), ' m 이상')", "concat('폭 ', CASE WHEN k % 2 = 0 THEN concat(CAST(1000 * (1 + k % 30) AS STRING), ' mm') ELSE concat(CAST(1 + k % 30 AS STRING), ' m') END, CASE WHEN k % 3 = 0 THEN ' 이상' ELSE '' END)"], lambda a, b: F.size(N.warnings_by_tolerance(a, b)), "CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS INT)")
_phrased(
    "T26_all_own_requirements", [f"CASE k % 4 WHEN 0 THEN '벽돌' WHEN 1 THEN concat('모르타르 배합비 ', CAST(1 + k % 3 AS STRING)) WHEN 2 THEN concat('제목 ', {_n}, '…') ELSE '' END", "CASE k % 4 WHEN 0 THEN concat('벽돌 쌓기 ', CAST(k AS STRING)) WHEN 1 THEN concat(CAST(2 + k % 5 AS STRING), '으로 한다') ELSE concat('본문 ', CAST(k AS STRING)) END"],
    X.own_requirement, f"CASE k % 4 WHEN 0 THEN '벽돌 쌓기 ' || k WHEN 1 THEN '모르타르 배합비 ' || (1 + k % 3) || ' : ' || (2 + k % 5) || '으로 한다' WHEN 2 THEN '제목 ' || {_n_sql} || ' 본문 ' || k ELSE '본문 ' || k END",
)
_phrased("T27_all_commercial_only", [f"concat({_pick(['공사비 정산', '비용은 시공하여야 한다', '대금 지급'], 'k')}, ' ', CAST(k AS STRING))", _pick(["시공 방법", "단가"], "floor(k / 3)")], lambda a, b: F.concat_ws(",", X.commercial_only(a).cast("string"), X.clearly_unrelated(a, b).cast("string")), "CASE WHEN k % 3 = 1 THEN 'false,false' WHEN k // 3 % 2 = 0 THEN 'true,true' ELSE 'true,false' END")
_units = ["내화 벽돌", "벽돌", "ALC 블록", "블록", "점토벽돌", "타일"]
_conflicts = [[False, False, True, True, True, False], [False, False, True, True, False, False], [True, True, False, False, True, False], [True, True, False, False, True, False], [True, False, True, True, False, False], [False] * 6]
_phrased("T28_all_masonry_conflicts", [f"concat({_pick(_units, 'k')}, ' ', CAST(k AS STRING))", _pick(_units, "floor(k / 6)")], X.masonry_conflict, _cases([_conflicts[i % 6][i // 6] for i in range(36)], "k"))
_mortars = ["내화 모르타르", "단열 몰탈", "모르타르", "내화모르터"]
_phrased("T29_all_mortar_mismatches", [_pick(_mortars, "k"), f"concat({_pick(_mortars, 'floor(k / 4)')}, ' ', CAST(k AS STRING))"], X.named_mortar_mismatch, "(k % 4 IN (0, 3) AND k // 4 % 4 = 1) OR (k % 4 = 1 AND k // 4 % 4 IN (0, 3))")
_phrased("T30_all_evidence_present", [f"concat('[현재 요구사항] 줄눈 두께 ', {_n}, ' mm')", f"concat('벽돌의 줄눈두께', CASE WHEN k % 2 = 0 THEN {_n} ELSE 'x' END, 'mm 이상')"], X.evidence_present, "k % 2 = 0")
_phrased("T31_all_verification_bodies", ["concat(CASE k % 3 WHEN 0 THEN '[원문 상위 문맥] 조적\\n[현재 요구사항] ' WHEN 1 THEN '' ELSE '[KCS 상위 문맥] ' END, '쌓기 ', CAST(k AS STRING))"], X.verification_body, "CASE WHEN k % 3 = 2 THEN '[KCS 상위 문맥] ' ELSE '' END || '쌓기 ' || k")
_phrased("T32_all_grades", [f"concat('SM', CAST(200 + k % 300 AS STRING), 'A, B', CASE WHEN k % 2 = 0 THEN ', C' ELSE '' END, ' 및 ＳＳ', CAST(500 + k % 300 AS STRING))"], lambda a: _text(N.grades(a)), "'SM' || (200 + k % 300) || 'A|SM' || (200 + k % 300) || 'B|' || CASE WHEN k % 2 = 0 THEN 'SM' || (200 + k % 300) || 'C|' ELSE '' END || 'SS' || (500 + k % 300)")
_phrased("T32_all_table_standards", [f"concat(CASE k % 3 WHEN 0 THEN 'KS D ' WHEN 1 THEN 'ksd' ELSE 'ＫＳ　Ｄ　' END, {_n}, CASE WHEN k % 2 = 0 THEN ', KS D 350' ELSE '' END)"], lambda a: _text(N.product_standards(a)), f"'KS D ' || {_n_sql}")
_phrased("T35_all_unsupported_numbers", ["concat('두께 ', CAST(10 + k % 80 AS STRING), '.5 및 ', CAST(100 + k % 90 AS STRING))", "concat(CAST(10 + k % 80 AS STRING), '.5 이상', CASE WHEN k % 2 = 0 THEN concat(', ', CAST(100 + k % 90 AS STRING)) ELSE '' END)"], lambda a, b: _text(N.unsupported_numbers(a, F.array(b))), "CASE WHEN k % 2 = 0 THEN '' ELSE CAST(100 + k % 90 AS VARCHAR) END")
_phrased(
    "T48_all_label_splits", ["concat(CASE k % 4 WHEN 0 THEN concat(CAST(1 + k % 9 AS STRING), '.', CAST(1 + k % 7 AS STRING), '.', CAST(1 + k % 5 AS STRING), ' ') WHEN 1 THEN concat('(', CAST(1 + k % 30 AS STRING), ') ') WHEN 2 THEN '가. ' ELSE '' END, '본문')"],
    lambda a: F.concat_ws("|", X.split_label(a)["label"], X.split_label(a)["title"]), "CASE k % 4 WHEN 0 THEN (1 + k % 9) || '.' || (1 + k % 7) || '.' || (1 + k % 5) WHEN 1 THEN '(' || (1 + k % 30) || ')' WHEN 2 THEN '가.' ELSE '' END || '|본문'",
)
_phrased(
    "I04_all_semantic_fingerprints", [f"concat(CASE WHEN k % 2 = 0 THEN 'KCS 41-34' ELSE 'kcs4134' END, CAST(k % 10 AS STRING))", "concat(CASE WHEN k % 3 = 0 THEN '（１） 벽돌 ' ELSE '(1)  벽돌 ' END, CAST(k AS STRING))", "concat(CASE WHEN k % 5 = 0 THEN '본문 Ａ' ELSE '본문  a' END, CASE WHEN k % 7 = 0 THEN 'b' ELSE '' END)", "concat('kcs 4134', CAST(k % 10 AS STRING))", "concat('(1) 벽돌 ', CAST(k AS STRING))"],
    lambda a, b, c, d, e: D.semantic_fingerprint(a, F.lit("1"), b, c, F.array(F.lit("경고"), F.lit(" 경고 "))) == D.semantic_fingerprint(d, F.lit(" 1 "), e, F.lit("본문 A"), F.array(F.lit("경고"))), "k % 7 <> 0",
)


# rules on rows that several texts, or texts and tables, take part in
_phrased(
    "E05_all_table_fields", [f"CASE WHEN k % 2 = 0 THEN concat('강판 SS', CAST(200 + k % 300 AS STRING), ' KS D ', {_n}, ' 두께 ', CAST(1 + k % 40 AS STRING), ' mm 이하') ELSE '형강 SM355A, B' END", f"CASE WHEN k % 2 = 0 THEN '표 1' ELSE concat('표 > KS D ', {_n}, ' 강재 > [표 열] 강종') END"],
    lambda a, b: F.concat(*[x for c in ("standards", "grades", "thickness", "products") for x in (F.array_join(V.table_fields(a, b)[c], "|"), F.lit("/"))]),
    f"'KS D ' || {_n_sql} || CASE WHEN k % 2 = 0 THEN '/SS' || (200 + k % 300) || '/' || (1 + k % 40) || ' mm 이하/강판/' ELSE '/SM355A|SM355B//형강/' END",
)
_abc = ["CAST(1000 + k % 3000 AS {0})", "CAST(4000 + k % 3000 AS {0})", "CAST(7000 + k % 2000 AS {0})"]
_a, _b, _c = (x.format("STRING") for x in _abc)
_phrased(
    "T33_all_omitted_prefixes", [f"CASE WHEN k % 2 = 0 THEN concat('KS L ', {_a}, ', ', {_b}, ' 및 KS L ISO ', {_c}) ELSE concat('KS L ISO ', {_a}, '-1~6, ', {_b}) END"],
    lambda a: F.concat(F.array_join(L.standard_references(a)["codes"], "|"), F.lit("/"), L.standard_references(a)["ambiguous"].cast("string")),
    "CASE WHEN k % 2 = 0 THEN 'KS L ' || (1000 + k % 3000) || '|KS L ' || (4000 + k % 3000) || '|KS L ISO ' || (7000 + k % 2000) || '/false' ELSE 'KS L ISO ' || (1000 + k % 3000) || '|KS L ISO ' || (4000 + k % 3000) || '/true' END",
)
_phrased(
    "T34_all_standard_links", [f"concat('내화벽돌 조적용 내화몰탈은 KS L ', CASE WHEN k % 2 = 0 THEN '3202' ELSE {_b} END, '에 따른다. ', CAST(k AS STRING))", f"concat('내화벽돌 쌓기에 사용하는 모르타르는 ', CASE floor(k / 2) % 3 WHEN 0 THEN '한국산업표준' WHEN 1 THEN 'KS L 3202' ELSE concat('KS L ', {_b}) END, '에 적합한 것을 사용한다.')"],
    lambda a, b: _text(F.transform(L.standard_links(a, b), lambda x: F.concat_ws(" ", x["standard"], x["reference_type"]))),
    "CASE WHEN k % 2 = 1 THEN '' ELSE CASE k // 2 % 3 WHEN 0 THEN 'KS L 3202 indirect' WHEN 1 THEN 'KS L 3202 explicit' ELSE '' END END",
)
_phrased(
    "T36_all_test_fields", ["CASE WHEN k % 4 = 3 THEN 'paragraph' ELSE 'table' END", f"CASE k % 3 WHEN 0 THEN concat('벽돌 | 압축강도 시험 | ', CAST(1 + k % 9 AS STRING), '회 | ') WHEN 1 THEN concat('벽돌 | 흡수율 | KS L ', {_n}, ' | 매회 | ', CAST(1 + k % 60 AS STRING), '%  이하') ELSE 'a | b' END", f"concat('KS F ', {_n})"],
    lambda a, b, c: F.coalesce(F.array_join(F.transform(V.test_fields(a, b, c), lambda x: F.concat_ws("=", x["field"], x["source"])), ";"), F.lit("")),
    "CASE WHEN k % 4 = 3 OR k % 3 = 2 THEN '' WHEN k % 3 = 0 THEN 'tests=압축강도 시험;frequency=' || (1 + k % 9) || '회' ELSE 'tests=흡수율;frequency=매회;conditions=' || (1 + k % 60) || '% 이하' END",
)
_phrased("T37_all_standards_analysis", [f"concat('KS D ', {_n}, ' 및 astm a', CAST(30 + k % 9 AS STRING))", f"concat('KSD', {_n}, ' 적용', CASE WHEN k % 2 = 0 THEN concat(', ASTM A', CAST(30 + k % 9 AS STRING)) ELSE '' END)"], lambda a, b: F.concat(_text(V.all_references(a)), F.lit("/"), _text(V.missing_references(V.all_references(a), b))), f"'KS D ' || {_n_sql} || '|ASTM A' || (30 + k % 9) || '/' || CASE WHEN k % 2 = 0 THEN '' ELSE 'ASTM A' || (30 + k % 9) END")
_phrased("E09_all_valid_analyses", [_pick(["equivalent", "conflict", "same", "unrelated"], "k"), "k % 13", "CASE WHEN k % 5 = 0 THEN ' ' ELSE concat('근거 ', CAST(k AS STRING)) END"], lambda a, b, c: G.valid_analysis(a, b / 10.0, c), "k % 4 <> 2 AND k % 13 <= 10 AND k % 5 <> 0")
_phrased("E10_all_duplicate_json_keys", ["CASE k % 3 WHEN 0 THEN concat('{\"a\":', CAST(k AS STRING), ',\"b\":{\"a\":2}}') WHEN 1 THEN concat('{\"a\":1,\"a\":', CAST(k AS STRING), '}') ELSE 'no json' END"], V.unique_json_keys, _cases([True, False, False], "k"))
_phrased(
    "E11_all_contents_entries", ["CASE k % 3 WHEN 0 THEN concat(CAST(1 + k % 8 AS STRING), '.', CAST(1 + k % 7 AS STRING), ' 재료 ..... ', CAST(k % 300 AS STRING)) WHEN 1 THEN concat(CAST(1 + k % 8 AS STRING), '. 검사\\t', CAST(k % 300 AS STRING)) ELSE concat(' ', CAST(1 + k % 8 AS STRING), '. 시공 ') END"],
    lambda a: F.concat_ws("|", V.contents_entry(a)["label"], V.contents_entry(a)["title"], a.rlike(V.PAGE_LOCATOR).cast("string")),
    "CASE k % 3 WHEN 0 THEN (1 + k % 8) || '.' || (1 + k % 7) || '|재료|true' WHEN 1 THEN (1 + k % 8) || '|검사|true' ELSE (1 + k % 8) || '|시공|false' END",
)
_phrased(
    "E31_all_reasons_of_decisions", [_pick(["delete", "keep", "keep", "keep", "hold", "drop"], "k"), _pick(["fully_covered_by_kcs", "fully_covered_by_kcs", "partial_overlap_residual", "partial_overlap_residual", "kcs_conflict", "x"], "k"), "concat('a', CAST(k AS STRING))", "CASE k % 6 WHEN 2 THEN concat('b', CAST(k AS STRING)) WHEN 3 THEN concat(' a', CAST(k AS STRING), ' ') ELSE '' END"],
    C.valid_decision, _cases([True, False, True, False, True, False], "k"),
)
_phrased("C03_all_guards", ["CASE WHEN k % 7 = 0 THEN 'not_covered' ELSE 'covered' END", "concat('줄눈 두께 ', CAST(10 * (1 + k % 20) AS STRING), ' mm')", "concat('줄눈 두께 ', CAST(1 + k % 20 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS STRING), ' cm')"], C.guarded, "CASE WHEN k % 7 = 0 THEN 'not_covered' WHEN k % 3 = 0 THEN 'uncertain' ELSE 'covered' END")


def _said(spark, sf_dir, **columns: str):
    """o_orderkey, as id, with columns phrased from it."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select(F.col("k").alias("id"), *[F.expr(e).alias(c) for c, e in columns.items()])


@query("R16_all_query_texts", """SELECT k AS id, CASE k % 4 WHEN 0 THEN '벽돌 쌓기 ' || k WHEN 1 THEN '상기 기준에 따른다 벽돌 쌓기 ' || (k - 1) WHEN 2 THEN '다음 표에 따른다 표 내용 ' || (k + 1) ELSE '표 내용 ' || k END || ' 조적' AS query
FROM (SELECT o_orderkey AS k FROM orders)""")
def query_texts(spark, sf_dir):
    """Clauses in groups of four; the second refers back and the third ahead."""
    words = "CASE k % 4 WHEN 0 THEN concat('벽돌 쌓기 ', CAST(k AS STRING)) WHEN 1 THEN '상기 기준에 따른다' WHEN 2 THEN '다음 표에 따른다' ELSE concat('표 내용 ', CAST(k AS STRING)) END"
    rows = _said(spark, sf_dir, project="floor(k / 4)", source_order="k % 4 + 1", title="''", content=words, source_type="CASE WHEN k % 4 = 3 THEN 'table' ELSE 'paragraph' END", context="'조적'")
    # a task holds its neighbours' texts, so projects are dealt out
    return V.query_texts(dealt(rows, "project"), ["project"]).select("id", "query")


@query("R19_all_table_checks", """WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS id, 'products' AS field, 'unconfirmed' AS status FROM o UNION ALL SELECT k, 'thickness', 'unconfirmed' FROM o
UNION ALL SELECT k, 'standards', CASE WHEN k % 3 = 0 THEN 'unconfirmed' ELSE 'found' END FROM o UNION ALL SELECT k, 'grades', CASE WHEN k % 2 = 0 THEN 'found' ELSE 'unconfirmed' END FROM o""")
def all_table_checks(spark, sf_dir):
    rows = _said(spark, sf_dir, standards=f"array(concat('KS D ', {_n}))", grades="array('SS275', concat('SS', CAST(k % 90 AS STRING)))", known_standards=f"array('KS D 1', CASE WHEN k % 3 = 0 THEN 'KS D 2' ELSE concat('KS D ', {_n}) END)", known_grades="array('SS275', CASE WHEN k % 2 = 0 THEN concat('SS', CAST(k % 90 AS STRING)) ELSE 'SM1' END)")
    return V.table_checks(rows, "id")


@query("J19_all_exact_table_rows", "SELECT o_orderkey AS clause, p_partkey AS row FROM orders JOIN part ON (o_orderkey % 500 = p_partkey % 500 OR o_orderkey % 500 + 1000 = p_partkey % 500 + 1000) AND o_orderkey % 7 = p_partkey % 7")
def all_exact_table_rows(spark, sf_dir):
    """Clauses and table rows that share a standard and a grade."""
    left = _said(spark, sf_dir, standards="array(concat('KS D ', CAST(k % 500 AS STRING)), concat('KS F ', CAST(k % 500 + 1000 AS STRING)))", grades="array(concat('SS', CAST(k % 7 AS STRING)))").withColumnRenamed("id", "clause")
    k = F.col("p_partkey")
    right = table(spark, sf_dir, "part").select(k.alias("row"), F.array(F.concat(F.lit("KS D "), (k % 500).cast("string")), F.concat(F.lit("KS F "), (k % 500 + 1000).cast("string"))).alias("standards"), F.array(F.concat(F.lit("SS"), (k % 7).cast("string"))).alias("grades"))
    return V.matching_table_rows(left, right, "clause", "row")


@query("R09_all_synonyms", "SELECT s_suppkey AS q, n_nationkey AS d FROM supplier JOIN nation ON s_suppkey % 3 = n_nationkey % 3 WHERE s_suppkey % 3 < 2")
def all_synonyms(spark, sf_dir):
    """Suppliers' questions and nations' texts that name the same thing in other words."""
    groups = lambda df, i, words: df.select(F.col(i[0]).alias(i[1]), F.explode(X.matched_groups(F.element_at(F.array(*map(F.lit, words)), (F.col(i[0]) % 3).cast("int") + 1))).alias("g"))
    asked = groups(table(spark, sf_dir, "supplier"), ("s_suppkey", "q"), ["몰탈 바르기", "shop drawing", "타일"])
    return asked.join(groups(table(spark, sf_dir, "nation"), ("n_nationkey", "d"), ["모르타르 배합", "시공상세도 제출", "도장"]), "g").select("q", "d").distinct()


_LINES = ["1. 일반", "1.2 재료", "(1) 벽돌", "가. 점토", "(2) 타일", "2. 시공", "2.1 준비", "2.1.3 청소", "2.2 쌓기"]
_LABELS = ["1/일반", "1.2/일반 > 재료", "1.2(1)/일반 > 재료", "1.2(1)-가./일반 > 재료", "1.2(2)/일반 > 재료", "2/시공", "2.1/시공 > 준비", "2.1.3/시공 > 준비 > 청소", "2.2/시공 > 쌓기"]


@query("S10_all_contextual_labels", f"SELECT k AS id, {_cases(_LABELS, 'k')} AS result FROM (SELECT o_orderkey AS k FROM orders)")
def all_contextual_labels(spark, sf_dir):
    """Outlines of nine lines each."""
    rows = _said(spark, sf_dir, doc="floor(k / 9)", n="k % 9", text=_pick(_LINES, "k"))
    return V.contextual_labels(rows, "doc", "n", "text").select("id", F.concat_ws("/", "full_label", "section_path").alias("result"))


@query("E07_all_cached_comparisons", f"SELECT k AS id, {_cases(['fresh', 'stale', 'reusable', 'pending', 'pending'], 'k')} AS state FROM (SELECT o_orderkey AS k FROM orders)")
def all_cached_comparisons(spark, sf_dir):
    """Comparisons that are kept, of which some are of today, some of the same body, some of another source; every fifth row has none."""
    rows = _said(spark, sf_dir, row="k", source_hash="concat('s', CAST(k AS STRING))", body_hash="'b'")
    held = _said(spark, sf_dir, row="k", source_hash="concat(CASE WHEN k % 5 = 3 THEN 'old' ELSE 's' END, CAST(k AS STRING))", version="'v2'", body_hash="CASE WHEN k % 5 IN (0, 1) THEN 'x' ELSE 'b' END", model="'m'", checked="CASE WHEN k % 5 IN (0, 3) THEN '2026-01-02T01' ELSE '2026-01-01T01' END").where("id % 5 < 4").drop("id")
    return G.cached(rows.drop("id"), held, "v2", "m", "2026-01-02").select(F.col("row").alias("id"), "state")


_TALK = ["제목", "벽돌의 하루 쌓기 높이는 담당원이 승인한 시공계획에 정한 값을 표준으로 하며 필요한 때에는 시험으로 확인하고 기록을 남겨 둔다", "짧은 문장", "줄눈의 폭과 깊이는 상기 조건을 만족하도록 하고 담당원이 승인한 시공계획에 정한 값을 표준으로 하며 시험으로 확인한 뒤 기록한다", "", "나중 제목", "모르타르는 표 3과 같이 배합하고 담당원이 승인한 시공계획에 정한 값을 표준으로 하며 필요한 때에는 시험으로 확인하고 기록한다"]


@query("E28_all_neighbour_contexts", f"""WITH r AS (SELECT o_orderkey AS k, o_orderkey // 7 AS project, o_orderkey % 7 IN (0, 5) AS heading, trim({_cases(_TALK, 'o_orderkey')} || CASE WHEN o_orderkey % 7 = 4 THEN '' ELSE ' ' || o_orderkey END) AS said FROM orders),
n AS (SELECT *, last_value(CASE WHEN NOT heading THEN ' ' || said END IGNORE NULLS) OVER (PARTITION BY project ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 first_value(CASE WHEN NOT heading THEN ' ' || said END IGNORE NULLS) OVER (PARTITION BY project ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS behind FROM r)
SELECT k AS id, CASE WHEN k % 7 = 1 THEN '조적' ELSE concat_ws(' ', '조적', before, behind) END AS source_context FROM n""")
def all_neighbour_contexts(spark, sf_dir):
    """Projects of seven clauses: two headings, a long one that stands alone, short ones and long ones that refer to others."""
    content = f"concat({_pick(_TALK, 'k')}, CASE WHEN k % 7 = 4 THEN '' ELSE concat(' ', CAST(k AS STRING)) END)"
    rows = _said(spark, sf_dir, project="floor(k / 7)", place="k", title="''", content=content, source_type="CASE WHEN k % 7 IN (0, 5) THEN 'heading' ELSE 'paragraph' END", heading_context="'조적'")
    return V.neighbour_context(rows, ["project"], "place").select("id", "source_context")


def _greedy_sql(name: str, source: str, count: int, chars: int) -> str:
    """CTEs that give each row of `source` (clause, k from 1, size) its batch, one after the other."""
    full = f"(r.n >= {count} OR r.held + s.size > {chars})"
    return f"""{name}_r AS (SELECT clause, k, 0 AS batch, 1 AS n, size AS held FROM {source} WHERE k = 1 UNION ALL
SELECT s.clause, s.k, r.batch + CAST({full} AS INT), CASE WHEN {full} THEN 1 ELSE r.n + 1 END, CASE WHEN {full} THEN s.size ELSE r.held + s.size END FROM {name}_r r JOIN {source} s ON s.clause = r.clause AND s.k = r.k + 1),
{name} AS (SELECT clause, max(batch) + 1 AS batches FROM {name}_r GROUP BY clause)"""


@query("C04_planned_calls", f"""WITH RECURSIVE o AS (SELECT o_custkey AS clause, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey, 300 + o_orderkey * 7 % 1700 AS chars, 1 + o_orderkey * 1013 % 30000 AS held FROM orders),
seg AS (SELECT clause, n AS k, length('S' || n) + chars + 3 AS size FROM o),
parts AS (SELECT clause, n, i, (held + 7999) // 8000 AS of, least(8000, held - 8000 * (i - 1)) AS chars, CAST(o_orderkey AS VARCHAR) AS ref FROM (SELECT *, unnest(range(1, (held + 7999) // 8000 + 1)) AS i FROM o)),
can AS (SELECT clause, row_number() OVER (PARTITION BY clause ORDER BY n, i) AS k, length(ref) + CASE WHEN of = 1 THEN 0 ELSE length(' · 부분 ' || i || '/' || of) END + chars + 12 AS size FROM parts),
{_greedy_sql('b', 'seg', 24, 8000)}, {_greedy_sql('p', 'can', 1 << 30, 48000)}
SELECT b.clause, CAST(b.batches * p.batches AS BIGINT) AS calls, b.batches * p.batches <= 64 AS allowed FROM b JOIN p ON p.clause = b.clause""")
def planned_calls(spark, sf_dir):
    """Customers as clauses: their orders' texts are the source segments, and longer ones the candidates."""
    key = F.col("o_orderkey")
    # texts are made and measured where a clause's orders lie, so few keys that become long texts are dealt out first
    orders = dealt(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey")
    rows = orders.select(F.col("o_custkey").alias("clause"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(key)).alias("n"), key.alias("key"))
    long = lambda n: F.repeat(F.lit("x"), n.cast("int"))
    segments = rows.select("clause", "n", long(300 + F.col("key") * 7 % 1700).alias("text"))
    candidates = rows.select("clause", "n", F.col("key").cast("string").alias("ref"), long(1 + F.col("key") * 1013 % 30000).alias("text"))
    return C.planned_calls(segments, candidates)


@query("T42_all_greedy_batches", f"WITH RECURSIVE seg AS (SELECT o_custkey AS clause, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, 100 + o_orderkey * 31 % 3000 AS size FROM orders), {_greedy_sql('b', 'seg', 5, 8000)} SELECT clause, k, batch FROM b_r")
def all_greedy_batches(spark, sf_dir):
    """Orders of a customer put into batches of at most five and 8,000 characters."""
    sizes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("clause")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (100 + F.col("o_orderkey") * 31 % 3000).alias("size")))).alias("rows"))
    batches = sizes.select("clause", F.posexplode(greedy_batches(F.transform("rows", lambda r: r["size"]), 5, 8000)).alias("k", "batch"))
    return batches.select("clause", (F.col("k") + 1).cast("long").alias("k"), "batch")
