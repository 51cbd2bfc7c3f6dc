"""DuckDB SQL of the relational queries."""

from __future__ import annotations

from lintel.plans.star import W3

SQL = {
    "F01_optional_filters": f"{W3} SELECT id, title, filename FROM projects WHERE contains(lower(title), 'build')",
    "F02_status_filters": f"{W3} SELECT p.id, count(c.id) AS open_clauses FROM projects p LEFT JOIN clauses c ON c.project_id = p.id AND c.decision <> 'F' WHERE p.state = 'active' AND p.revision <> 2 GROUP BY p.id",
    "F03_literal_prefix": f"{W3} SELECT id, filename FROM projects WHERE substr(filename, 1, 13) = 'Customer#0000' AND substr(filename, 14, 1) <> '_'",
    "F04_review_filter": f"{W3} SELECT id, decision FROM clauses WHERE decision IN ('O', 'P') AND (price > 100000 OR reason LIKE '1-%')",
    "F05_token_or_like": "SELECT doc_id FROM documents WHERE lang = 'en' AND (lower(text) LIKE '%idiot%' OR lower(text) LIKE '%license%' OR source LIKE 'src1%')",
    "F06_eligibility_flags": f"{W3} SELECT clause_id, rank, (relation = 'R') AS blocked, (score < 0.25) AS low, (section_id % 97 = 0) AS explicit FROM candidates WHERE section_id % 97 = 0 OR (relation <> 'R' AND score >= 0.25)",
    "F07_case_defaults": f"{W3} SELECT id, CASE WHEN decision = 'F' THEN 'keep' WHEN decision = 'O' THEN 'hold' ELSE 'delete' END AS verdict, coalesce(nullif(reason, '3-MEDIUM'), 'none') AS reason FROM clauses",
    "F08_public_fields": f"{W3} SELECT p.id, p.title, p.title || ':' || CAST(p.discipline AS VARCHAR) AS label FROM projects p",
    "F09_violations": f"{W3} SELECT id, concat_ws(',', CASE WHEN decision = 'P' AND reason = '5-LOW' THEN 'reason' END, CASE WHEN price < 2000 THEN 'residual' END, CASE WHEN decision = 'O' AND price > 400000 THEN 'unsafe' END) AS violations FROM clauses WHERE (decision = 'P' AND reason = '5-LOW') OR price < 2000 OR (decision = 'O' AND price > 400000)",
    "F10_client_filters": f"{W3} SELECT decision, reason, count(*) AS n FROM clauses WHERE reason NOT IN ('4-NOT SPECIFIED') GROUP BY decision, reason",
    "J01_left_join": f"{W3} SELECT p.id, count(c.id) AS clauses FROM projects p LEFT JOIN clauses c ON c.project_id = p.id GROUP BY p.id",
    "J02_left_join_anti": f"{W3} SELECT c.id, count(k.rank) AS visible, max(k.score) AS best FROM clauses c LEFT JOIN (SELECT * FROM candidates k WHERE NOT EXISTS (SELECT 1 FROM candidates x WHERE x.clause_id = k.clause_id AND x.rank = k.rank AND x.relation = 'R' AND x.confidence >= 0.05)) k ON k.clause_id = c.id GROUP BY c.id",
    "J03_left_analysis": f"{W3} SELECT k.clause_id, k.rank, a.n AS analyses FROM candidates k LEFT JOIN (SELECT clause_id, rank, count(*) AS n FROM candidates WHERE relation = 'A' GROUP BY clause_id, rank) a ON a.clause_id = k.clause_id AND a.rank = k.rank WHERE k.rank <= 3",
    "J04_inner_and_left": f"{W3} SELECT c.id, k.rank, coalesce(s.s_name, 'none') AS analyst FROM clauses c JOIN candidates k ON k.clause_id = c.id LEFT JOIN supplier s ON s.s_suppkey = k.code AND s.s_acctbal > 0 WHERE c.decision = 'P'",
    "J05_existence_flags": f"{W3}, flags AS (SELECT c.project_id, CASE WHEN EXISTS (SELECT 1 FROM candidates k WHERE k.clause_id = c.id AND k.relation = 'N') THEN 1 ELSE 0 END AS pending FROM clauses c) SELECT project_id, count(*) AS clauses, CAST(sum(pending) AS BIGINT) AS pending FROM flags GROUP BY project_id",
    "J06_semi": f"{W3} SELECT id, title FROM projects p WHERE EXISTS (SELECT 1 FROM clauses c JOIN candidates k ON k.clause_id = c.id WHERE c.project_id = p.id AND k.relation = 'R' AND c.decision = 'P')",
    "J07_semi_three": f"{W3} SELECT c.id FROM clauses c WHERE EXISTS (SELECT 1 FROM projects p JOIN nation n ON n.n_nationkey = p.discipline WHERE p.id = c.project_id AND p.revision = n.n_regionkey % 3)",
    "J08_unsafe_delete": f"{W3} SELECT c.id FROM clauses c WHERE c.decision = 'F' AND (NOT EXISTS (SELECT 1 FROM candidates k WHERE k.clause_id = c.id AND k.rank = 2) OR EXISTS (SELECT 1 FROM candidates k WHERE k.clause_id = c.id AND k.score < 0.04))",
    "J09_lateral_explode": "SELECT vec_id, count(*) AS dims, CAST(sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id",
    "J10_page_with_total": f"{W3} SELECT t.total, g.id, g.price FROM (SELECT count(*) AS total FROM clauses WHERE decision = 'P') t LEFT JOIN (SELECT id, price FROM clauses WHERE decision = 'P' ORDER BY price DESC, id LIMIT 20 OFFSET 40) g ON 1 = 1",
    "J11_latest_row_join": f"{W3}, last AS (SELECT * FROM (SELECT project_id, id, decision, row_number() OVER (PARTITION BY project_id ORDER BY reviewed_at DESC, id DESC) AS n FROM clauses) WHERE n = 1) SELECT p.id, l.id AS last_clause, l.decision FROM projects p LEFT JOIN last l ON l.project_id = p.id",
    "J12_composite_left": f"{W3}, stats AS (SELECT project_id, id % 3 AS revision, count(*) AS impacts FROM clauses GROUP BY project_id, id % 3) SELECT p.id, coalesce(s.impacts, 0) AS impacts FROM projects p LEFT JOIN stats s ON s.project_id = p.id AND s.revision = p.revision",
    "J13_theta_anti": f"{W3} SELECT p.id, p.discipline FROM projects p WHERE NOT EXISTS (SELECT 1 FROM projects q WHERE q.title = p.title AND q.discipline = p.discipline AND (q.balance > p.balance OR (q.balance = p.balance AND q.id > p.id)))",
    "J14_case_key": f"{W3} SELECT c.id, k.rank, k.section_id FROM clauses c LEFT JOIN candidates k ON k.clause_id = c.id AND k.rank = CASE WHEN c.decision = 'F' THEN 1 WHEN c.decision = 'O' THEN 2 ELSE 3 END",
    "J15_chain_left": f"{W3} SELECT r.r_name, n.n_name, count(p.id) AS projects FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN projects p ON p.discipline = n.n_nationkey AND p.state = 'active' GROUP BY r.r_name, n.n_name",
    "J17_prefix_join": "SELECT n.n_name, count(*) AS parts FROM nation n JOIN part p ON substr(lower(p.p_name), 1, 1) = substr(lower(n.n_name), 1, 1) AND p.p_size < n.n_nationkey + 10 GROUP BY n.n_name",
    "J18_group_overlap": f"{W3} SELECT clause_id, section_id, (SELECT count(DISTINCT b.clause_id) FROM candidates b WHERE b.section_id = a.section_id AND b.clause_id <> a.clause_id) AS partners FROM (SELECT DISTINCT clause_id, section_id FROM candidates) a",
    "J19_two_overlaps": f"{W3} SELECT DISTINCT a.clause_id AS a, b.clause_id AS b FROM candidates a JOIN candidates b ON a.section_id = b.section_id AND a.code = b.code AND a.clause_id < b.clause_id",
    "J20_positional": f"{W3}, v AS (SELECT clause_id, rank, CASE WHEN relation = 'A' THEN 'related' WHEN relation = 'N' THEN 'partial' ELSE 'unrelated' END AS verdict FROM candidates) SELECT k.clause_id, k.rank, coalesce(v.verdict, 'uncertain') AS verdict FROM candidates k LEFT JOIN v ON v.clause_id = k.clause_id AND v.rank = k.rank + 1",
    "J21_multiset_diff": f"""{W3}, b AS (SELECT clause_id, relation AS fp, row_number() OVER (PARTITION BY clause_id, relation ORDER BY rank) AS n FROM candidates WHERE rank <= 3),
a AS (SELECT clause_id, relation AS fp, row_number() OVER (PARTITION BY clause_id, relation ORDER BY rank) AS n FROM candidates WHERE rank >= 2 AND rank <= 4)
SELECT coalesce(b.clause_id, a.clause_id) AS clause_id, coalesce(b.fp, a.fp) AS fp, CAST(coalesce(b.n, a.n) AS INT) AS n, CASE WHEN b.clause_id IS NULL THEN 'added' WHEN a.clause_id IS NULL THEN 'removed' ELSE 'kept' END AS change
FROM b FULL JOIN a ON b.clause_id = a.clause_id AND b.fp = a.fp AND b.n = a.n""",
    "J22_nearest_previous": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_user FROM conversations",
    "J23_seen_earlier": f"{W3} SELECT k.clause_id, k.rank, CAST(count(DISTINCT e.code) AS BIGINT) AS earlier_codes FROM candidates k LEFT JOIN candidates e ON e.clause_id = k.clause_id AND e.rank < k.rank GROUP BY k.clause_id, k.rank",
    "J24_anti_existing": f"{W3} SELECT k.clause_id, k.rank FROM candidates k WHERE k.relation = 'A' AND NOT EXISTS (SELECT 1 FROM candidates x WHERE x.clause_id = k.clause_id AND x.relation = 'N' AND x.code = k.code)",
    "J25_orphans": f"{W3} SELECT 'clause' AS kind, count(*) AS n FROM clauses c WHERE NOT EXISTS (SELECT 1 FROM projects p WHERE p.id = c.project_id AND p.state = 'active') UNION ALL SELECT 'candidate', count(*) FROM candidates k WHERE NOT EXISTS (SELECT 1 FROM clauses c WHERE c.id = k.clause_id)",
    "A01_conditional_counts": f"{W3} SELECT project_id, count(*) AS total, CAST(sum(CASE WHEN decision = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS keep, CAST(sum(CASE WHEN decision = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS hold, CAST(sum(CASE WHEN decision = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS removed FROM clauses GROUP BY project_id",
    "A02_count_after_left": f"{W3} SELECT p.id, count(*) AS row_count, count(c.id) AS clauses FROM projects p LEFT JOIN clauses c ON c.project_id = p.id AND c.decision = 'P' GROUP BY p.id",
    "A03_best_and_count": f"{W3} SELECT clause_id, max(score) AS best, count(rank) AS n FROM candidates GROUP BY clause_id",
    "A04_count_distinct": f"{W3} SELECT code, count(DISTINCT clause_id) AS clauses, count(DISTINCT CASE WHEN relation = 'R' THEN section_id END) AS rejected FROM candidates GROUP BY code",
    "A05_scalar_counts": f"{W3} SELECT p.id, (SELECT count(*) FROM clauses c WHERE c.project_id = p.id AND c.price > 200000) AS large FROM projects p",
    "A06_next_revision": f"{W3} SELECT p.id, coalesce(max(c.id % 7), 0) + 1 AS next_revision FROM projects p LEFT JOIN clauses c ON c.project_id = p.id GROUP BY p.id",
    "A09_job_rollup": "SELECT user_id, count(*) AS items, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed, CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN min(event_type) = max(event_type) THEN 'uniform' ELSE 'mixed' END AS state, round(avg(value), 8) AS progress, min(event_id) FILTER (event_type <> 'click') AS first_other, arg_min(event_type, event_id) FILTER (event_type <> 'click') AS first_status FROM events GROUP BY user_id",
    "A10_ir_metrics": f"""{W3}, hits AS (SELECT c.id, min(CASE WHEN k.relation = 'A' THEN k.rank END) AS hit FROM clauses c LEFT JOIN candidates k ON k.clause_id = c.id AND k.rank <= 3 GROUP BY c.id)
SELECT count(*) AS evaluated, CAST(sum(CASE WHEN hit = 1 THEN 1 ELSE 0 END) AS BIGINT) AS rank1, CAST(sum(CASE WHEN hit IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS found, round(CAST(sum(CASE WHEN hit IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0), 4) AS recall3, round(sum(CASE WHEN hit IS NULL THEN 0.0 ELSE CAST(1.0 AS DOUBLE) / hit END) / nullif(count(*), 0), 4) AS mrr FROM hits""",
    "A11_group_breakdown": f"{W3}, domain AS (SELECT 'F' AS decision UNION ALL SELECT 'O' UNION ALL SELECT 'P' UNION ALL SELECT 'X') SELECT d.decision, count(c.id) AS n, CAST(coalesce(sum(CASE WHEN c.price > 100000 THEN 1 ELSE 0 END), 0) AS BIGINT) AS large FROM domain d LEFT JOIN clauses c ON c.decision = d.decision GROUP BY d.decision",
    "A12_error_signals": f"{W3} SELECT CAST(sum(CASE WHEN relation = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS rejected, CAST(sum(CASE WHEN score < 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS weak, round(CAST(sum(CASE WHEN relation = 'R' OR score < 0.1 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0), 4) AS rate FROM candidates",
    "A13_coverage_progress": f"{W3} SELECT project_id, count(CASE WHEN id % 3 = 1 THEN 1 END) AS current_version, count(*) AS total FROM clauses GROUP BY project_id",
    "A14_status_lattice": f"""{W3}, seg AS (SELECT clause_id, rank, CASE relation WHEN 'A' THEN 'covered' WHEN 'N' THEN 'uncertain' ELSE 'missing' END AS status, confidence FROM candidates)
SELECT clause_id, CASE WHEN max(CASE WHEN status = 'missing' AND confidence > 0.08 THEN 1 ELSE 0 END) = 1 THEN 'conflict' WHEN max(CASE WHEN status = 'uncertain' THEN 1 ELSE 0 END) = 1 THEN 'uncertain' WHEN min(CASE WHEN status = 'covered' THEN 1 ELSE 0 END) = 1 THEN 'fully_covered' WHEN max(CASE WHEN status = 'covered' THEN 1 ELSE 0 END) = 1 THEN 'partially_covered' ELSE 'not_covered' END AS status, min(confidence) AS confidence FROM seg GROUP BY clause_id""",
    "A15_batch_status": f"{W3} SELECT code, CASE WHEN min(CASE WHEN relation = 'A' THEN 1 ELSE 0 END) = 1 THEN 'full' WHEN max(CASE WHEN relation = 'A' THEN 1 ELSE 0 END) = 1 THEN 'partial' ELSE 'none' END AS status FROM candidates GROUP BY code",
    "A16_ordered_concat": f"{W3} SELECT clause_id, string_agg(relation, '' ORDER BY rank, relation) AS relations FROM candidates GROUP BY clause_id",
    "A17_revision_hash": "SELECT sha256(string_agg(d, '' ORDER BY b)) AS revision FROM (SELECT substr(md5(r), 1, 4) AS b, sha256(string_agg(r, chr(10) ORDER BY r)) AS d FROM (SELECT CAST(n_nationkey AS VARCHAR) || '|' || n_name || '|' || CAST(n_regionkey AS VARCHAR) AS r FROM nation) GROUP BY 1)",
    "A18_raw_integrity": "SELECT sha256(string_agg(d, '' ORDER BY b)) AS digest FROM (SELECT substr(md5(CAST(page_id AS VARCHAR)), 1, 4) AS b, sha256(string_agg(r, chr(10) ORDER BY r)) AS d FROM (SELECT page_id, CAST(page_id AS VARCHAR) || ':' || sha256(html) AS r FROM pages) GROUP BY 1)",
    "A19_impact_counts": f"{W3} SELECT count(*) AS impacts, CAST(sum(CASE WHEN decision = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS matched, CAST(sum(CASE WHEN price > 150000 THEN 1 ELSE 0 END) AS BIGINT) AS material, CAST(sum(CASE WHEN decision = 'F' AND price > 150000 THEN 1 ELSE 0 END) AS BIGINT) AS review_required FROM clauses",
    "A20_retention": f"{W3}, top AS (SELECT clause_id, min(CASE WHEN rank = 1 THEN section_id END) AS first, count(*) AS n FROM candidates WHERE rank <= 3 GROUP BY clause_id), ref AS (SELECT clause_id, max(section_id) AS expected FROM candidates GROUP BY clause_id) SELECT count(*) AS cases, CAST(sum(CASE WHEN top.first = ref.expected THEN 1 ELSE 0 END) AS BIGINT) AS top1, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM candidates k WHERE k.clause_id = ref.clause_id AND k.rank <= 3 AND k.section_id = ref.expected) THEN 1 ELSE 0 END) AS BIGINT) AS top3 FROM ref JOIN top ON top.clause_id = ref.clause_id",
    "A21_counter": f"{W3} SELECT relation, count(*) AS n FROM candidates GROUP BY relation",
    "W01_latest_of_title": f"{W3} SELECT id, title, CAST(row_number() OVER (PARTITION BY title ORDER BY balance DESC, id DESC) AS INT) AS n FROM projects",
    "W02_count_of_title": f"{W3} SELECT id, count(*) OVER (PARTITION BY title, discipline) AS same FROM projects",
    "W03_latest_submission": f"{W3} SELECT project_id, id FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY price DESC, id DESC) AS n FROM clauses) WHERE n = 1",
    "W04_latest_rematch": f"{W3} SELECT project_id, id FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY reviewed_at DESC, id DESC) AS n FROM clauses) WHERE n = 1",
    "W05_lag_lead_context": "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations",
    "W06_top3_visible": f"{W3} SELECT clause_id, rank, CAST(n AS INT) AS shown FROM (SELECT clause_id, rank, row_number() OVER (PARTITION BY clause_id ORDER BY rank) AS n FROM candidates WHERE NOT (relation = 'R' AND confidence >= 0.05)) WHERE n <= 3",
    "W07_rerank": f"{W3} SELECT clause_id, rank AS old_rank, CAST(row_number() OVER (PARTITION BY clause_id ORDER BY rank) AS INT) AS rank FROM candidates WHERE relation <> 'R'",
    "W08_last_substantive": "SELECT conv_id, turn, last_value(CASE WHEN length(text) > 200 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS substantive, last_value(CASE WHEN length(text) > 200 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_role FROM conversations",
    "W10_first_of_key": f"{W3} SELECT code, clause_id, rank FROM (SELECT code, clause_id, rank, row_number() OVER (PARTITION BY code ORDER BY clause_id, rank) AS n FROM candidates) WHERE n = 1",
    "W11_relative_to_best": f"{W3} SELECT clause_id, rank, round(score / max(score) OVER (PARTITION BY clause_id), 6) AS relative FROM candidates",
    "W13_occurrence": f"{W3} SELECT clause_id, rank, CAST(row_number() OVER (PARTITION BY clause_id, relation ORDER BY rank) AS INT) AS occurrence FROM candidates",
    "L01_keyset_page": f"{W3} SELECT id, balance FROM projects WHERE balance < 5000 OR (balance = 5000 AND id < 100) ORDER BY balance DESC, id DESC LIMIT 51",
    "L02_offset_page": f"{W3} SELECT id, price FROM clauses ORDER BY price DESC, id LIMIT 50 OFFSET 100",
    "L03_tie_broken_order": f"{W3} SELECT id, CAST(row_number() OVER (ORDER BY discipline, title, id) AS INT) AS place FROM projects WHERE state = 'archived'",
    "L04_pools": f"{W3} SELECT code, clause_id, rank FROM (SELECT code, clause_id, rank, row_number() OVER (PARTITION BY code ORDER BY score DESC, clause_id, rank) AS n FROM candidates) WHERE n <= 40",
    "L08_explicit_quota": f"""{W3}, leveled AS (SELECT clause_id, rank, CASE WHEN explicit AND f = 1 THEN 0 WHEN operation THEN 1 ELSE 2 END AS level FROM (SELECT clause_id, rank, section_id % 13 = 0 AS explicit, relation = 'A' AS operation, row_number() OVER (PARTITION BY clause_id, code, section_id % 13 = 0 ORDER BY rank) AS f FROM candidates))
SELECT clause_id, rank, CAST(n AS INT) AS place FROM (SELECT clause_id, rank, row_number() OVER (PARTITION BY clause_id ORDER BY level, rank) AS n FROM leveled) WHERE n <= 3""",
    "L09_dedupe_first": f"{W3} SELECT clause_id, rank FROM (SELECT clause_id, rank, row_number() OVER (PARTITION BY clause_id, code, relation ORDER BY rank) AS n FROM candidates) WHERE n = 1",
    "L10_retention": f"{W3} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY reviewed_at DESC, id DESC) AS n FROM clauses) WHERE n > 10",
    "U02_union_with_source": f"{W3} SELECT clause_id, rank, 'scoped' AS source FROM candidates WHERE relation = 'A' UNION ALL SELECT clause_id, rank, 'global' FROM candidates WHERE score > 0.9",
    "U03_intersection": f"{W3} SELECT DISTINCT clause_id FROM candidates WHERE relation = 'A' INTERSECT SELECT clause_id FROM candidates WHERE relation = 'R'",
    "U04_added_removed": f"{W3} SELECT 'added' AS change, count(*) AS n FROM (SELECT clause_id, code FROM candidates WHERE rank >= 2 EXCEPT SELECT clause_id, code FROM candidates WHERE rank <= 3) a UNION ALL SELECT 'removed', count(*) FROM (SELECT clause_id, code FROM candidates WHERE rank <= 3 EXCEPT SELECT clause_id, code FROM candidates WHERE rank >= 2) b",
    "U06_exact_cover": f"{W3} SELECT clause_id, count(*) = count(DISTINCT rank) AND min(rank) = 1 AND max(rank) = count(*) AS exact FROM candidates GROUP BY clause_id",
}
