"""DuckDB SQL of the governance queries."""

from __future__ import annotations

from lintel.operators.coverage import DECISION_REASONS
from lintel.plans.star import EVENTS, LINES, REVIEW, W3


_FP = """sha256('{"content":"text ' || (section_id % 3) || '","kcs_clause":"' || lower(relation) || '","kcs_code":"' || code || '","title":"t","warnings":[' || CASE WHEN relation = 'R' THEN '"w"' ELSE '' END || ']}')"""
_SIDES = f"""{LINES}, f AS (SELECT clause_id, pos, code || '/' || relation AS lk, {_FP} AS fp FROM lines),
b AS (SELECT *, 'c-' || clause_id || '-' || pos AS id, pos AS rank, row_number() OVER (PARTITION BY clause_id, fp ORDER BY pos) AS occ FROM f WHERE pos <= 4),
a AS (SELECT clause_id, 10 - pos AS pos, pos AS rank, lk, fp, row_number() OVER (PARTITION BY clause_id, fp ORDER BY 10 - pos) AS occ FROM f WHERE pos BETWEEN 2 AND 5),
g AS (SELECT a.clause_id, a.pos, a.fp, a.occ, b.id AS preserved, b.id IS NOT NULL AND b.rank <> a.rank AS moved, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('kcs-candidate:' || a.clause_id || ':' || a.fp || ':' || a.occ)) AS h FROM a LEFT JOIN b ON b.clause_id = a.clause_id AND b.fp = a.fp AND b.occ = a.occ)"""
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
_PLAN = f"""{_SIDES}, {REVIEW.removeprefix(LINES + ',')},
s AS (SELECT clause_id, lk, fp, max(x) AS b, max(y) AS a FROM (SELECT clause_id, lk, fp, 1 AS x, 0 AS y FROM b UNION ALL SELECT clause_id, lk, fp, 0, 1 FROM a) GROUP BY ALL),
k AS (SELECT clause_id, lk, max(b) = 1 AND max(a) = 1 AND bool_or(a <> b) AS meaning, bool_or(a = 1 AND b = 0) AS added, bool_or(b = 1 AND a = 0) AS removed FROM s GROUP BY clause_id, lk),
m AS (SELECT clause_id, bool_or(meaning) AS meaning, bool_or(added) AS added, bool_or(removed) AS removed FROM k GROUP BY clause_id),
q AS (SELECT c.clause, c.decision, c.confirmed, CASE c.clause % 3 WHEN 0 THEN 'c-' || c.clause || '-1' WHEN 1 THEN 'c-' || c.clause || '-3' END AS chosen FROM rc c WHERE EXISTS (SELECT 1 FROM lines l WHERE l.clause_id = c.clause)),
p AS (SELECT q.clause AS clause_id, q.decision, q.confirmed, coalesce(m.added OR m.removed, false) AS material_changed, coalesce((SELECT bool_or(moved) FROM g WHERE g.clause_id = q.clause), false) AS metadata_changed, (SELECT g.preserved FROM g WHERE g.clause_id = q.clause AND g.preserved = q.chosen) AS selected, q.chosen, m.meaning, m.added, m.removed FROM q LEFT JOIN m ON m.clause_id = q.clause)"""
_VALID = "(decision IS NULL OR (reason IN (SELECT unnest(CASE decision " + " ".join(f"WHEN '{d}' THEN {r!r}" for d, r in DECISION_REASONS.items()) + " END)) AND NOT (decision = 'keep' AND reason = 'partial_overlap_residual' AND (trim(edited) = '' OR trim(edited) = trim(content)))))"

SQL = {
    "I01_snapshot_sync": f"{W3}, o AS (SELECT id, balance, title FROM projects WHERE id % 10 <> 1), n AS (SELECT id, CASE WHEN id % 7 = 0 THEN balance + 1 ELSE balance END AS balance, title FROM projects WHERE id % 10 <> 2) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'unavailable' WHEN o.balance <> n.balance OR o.title <> n.title THEN 'changed' ELSE 'unchanged' END AS state FROM o FULL JOIN n ON o.id = n.id",
    "I02_integrity_counts": "SELECT count(*) AS documents, CAST(sum(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty, CAST(sum(CASE WHEN n_chars <> length(text) THEN 1 ELSE 0 END) AS BIGINT) AS wrong, count(DISTINCT source) AS sources FROM documents",
    "I03_snapshot_gate": "SELECT * FROM (VALUES ('nation', 'none', true), ('region', 'incomplete', false), ('supplier', 'missing', false)) AS t(name, reason, readable)",
    "I05_impact_plan": f"WITH {_PLAN} SELECT clause_id, material_changed, metadata_changed, decision IS NOT NULL AND material_changed AS review_required, selected, chosen IS NOT NULL AND selected IS NULL AS selection_removed, concat_ws(',', CASE WHEN meaning THEN 'candidate_meaning_changed' END, CASE WHEN added THEN 'candidate_added' END, CASE WHEN removed THEN 'candidate_removed' END, CASE WHEN metadata_changed THEN 'candidate_metadata_changed' END, CASE WHEN chosen IS NOT NULL AND selected IS NULL THEN 'selected_candidate_removed' END) AS reasons FROM p",
    "I06_apply_plan": f"WITH {_PLAN} SELECT clause_id, decision, selected, confirmed AND NOT material_changed AS coverage_valid FROM p",
    "I08_publish_revision": f"{W3} SELECT p.id, CASE WHEN p.revision = 2 THEN 'current' WHEN p.state = 'archived' THEN 'skipped' WHEN EXISTS (SELECT 1 FROM clauses c WHERE c.project_id = p.id AND c.decision = 'P') THEN 'superseded' ELSE 'queued' END AS next FROM projects p",
    "U05_snapshot_diff": f"{W3}, o AS (SELECT id, title FROM projects), n AS (SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE title END AS title FROM projects) SELECT n.id FROM n LEFT JOIN o ON o.id = n.id WHERE o.title IS DISTINCT FROM n.title",
    "U07_decision_preservation": f"{W3}, b AS (SELECT id, decision, reason FROM clauses WHERE id % 9 <> 0), a AS (SELECT id, CASE WHEN id % 13 = 0 THEN 'X' ELSE decision END AS decision, reason FROM clauses WHERE id % 8 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'lost' WHEN b.id IS NULL THEN 'new' ELSE 'changed' END AS difference FROM b FULL JOIN a ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.decision <> b.decision OR a.reason <> b.reason",
    "E26_meaning_changed": f"WITH {LINES} SELECT clause_id, code, b <> a AS changed FROM (SELECT clause_id, code, list_sort(list(DISTINCT relation) FILTER (pos <= 3)) AS b, list_sort(list(DISTINCT relation) FILTER (pos >= 2)) AS a FROM lines GROUP BY clause_id, code) WHERE len(b) > 0 AND len(a) > 0",
    "E27_carry_selection": f"WITH {LINES} SELECT o.o_orderkey AS id, n.section_id AS selected, (n.section_id IS NOT NULL) AS confirmed FROM orders o LEFT JOIN (SELECT clause_id, section_id FROM lines WHERE pos = 1) s ON s.clause_id = o.o_orderkey LEFT JOIN (SELECT DISTINCT clause_id, section_id FROM lines WHERE score > 0.5) n ON n.clause_id = o.o_orderkey AND n.section_id = s.section_id",
    "C01_deletion_safe": f"WITH {REVIEW} SELECT clause AS clause_id, coverage, array_to_string(evidence, ',') AS evidence, deletion_safe FROM cov",
    "C02_merge_batches": f"WITH {REVIEW} SELECT clause AS clause_id, CAST(segment AS INT) AS segment, status, array_to_string(evidence, ',') AS evidence FROM seg",
    "C04_call_cap": f"WITH {LINES}, b AS (SELECT clause_id, (max(pos) + 1) // 2 AS batches, greatest(1, count(DISTINCT code) FILTER (relation <> 'R')) AS packs FROM lines GROUP BY clause_id) SELECT clause_id, batches * packs AS calls, batches * packs <= 16 AS allowed FROM b",
    "G01_blockers": f"""WITH {REVIEW}, n AS (SELECT rc.project, count(*) AS reviewable, count(CASE WHEN decision IS NULL THEN 1 END) AS unreviewed, count(CASE WHEN NOT {_VALID} THEN 1 END) AS reasons, count(CASE WHEN decision = 'hold' THEN 1 END) AS holds, count(u.clause) AS deletes FROM rc LEFT JOIN unsafe u ON u.clause = rc.clause WHERE source_type <> 'heading' GROUP BY rc.project),
i AS (SELECT project, count(*) AS impacts FROM rc WHERE clause % 17 = 0 AND clause % 34 <> 0 GROUP BY project),
x AS (SELECT rp.*, coalesce(n.reviewable, 0) AS reviewable, nullif(concat_ws('; ', CASE WHEN parser_version <> 'v2' THEN 'reupload' END, CASE WHEN revision <> 'r2' AND parser_version = 'v2' AND rematch IS NULL THEN 'stale' END, 'rematch:' || rematch, CASE WHEN i.impacts > 0 THEN 'impacts:' || i.impacts END, CASE WHEN n.unreviewed > 0 THEN 'unreviewed:' || n.unreviewed END, CASE WHEN n.reasons > 0 THEN 'reasons:' || n.reasons END, CASE WHEN n.holds > 0 THEN 'holds:' || n.holds END, CASE WHEN n.deletes > 0 THEN 'deletes:' || n.deletes END), '') AS technical,
 CASE status WHEN 'reviewing' THEN 'submit' WHEN 'submitted' THEN 'approve' WHEN 'changes_requested' THEN 'resubmit' WHEN 'approved' THEN CASE WHEN NOT approved THEN 'record' END ELSE 'status' END AS last FROM rp LEFT JOIN n ON n.project = rp.project LEFT JOIN i ON i.project = rp.project)
SELECT project AS id, reviewable, concat_ws('; ', technical, last) AS blockers, technical IS NULL AND status IN ('reviewing', 'changes_requested') AS submission_ready, technical IS NULL AND last IS NULL AS export_ready FROM x""",
    "G02_decision_matrix": f"WITH {REVIEW} SELECT clause AS id, decision, reason FROM rc WHERE NOT {_VALID}",
    "G03_history_on_change": f"WITH {EVENTS} SELECT entity, seq, status FROM (SELECT entity, seq, status, lag(status) OVER (PARTITION BY entity ORDER BY seq) AS was FROM ev) WHERE was IS NULL OR was <> status",
    "G04_workflow_fold": f"WITH {EVENTS} SELECT entity, status, seq FROM (SELECT entity, status, seq, row_number() OVER (PARTITION BY entity ORDER BY seq DESC) AS n FROM ev) WHERE n = 1",
    "G04_illegal_transitions": f"WITH {EVENTS}, s AS (SELECT entity, seq, CASE status WHEN 'view' THEN 'submitted' WHEN 'click' THEN 'changes_requested' WHEN 'purchase' THEN 'approved' ELSE 'reviewing' END AS b FROM ev), t AS (SELECT entity, seq, lag(b) OVER (PARTITION BY entity ORDER BY seq) AS a, b FROM s) SELECT entity, seq FROM t WHERE a IS NOT NULL AND (a, b) NOT IN (('reviewing', 'submitted'), ('changes_requested', 'submitted'), ('submitted', 'approved'), ('submitted', 'changes_requested'), ('approved', 'changes_requested'))",
    "G05_snapshot_hash": f"WITH {LINES} SELECT clause_id, sha256(string_agg(concat_ws(':', pos, section_id, relation), '|' ORDER BY pos)) AS snapshot FROM lines GROUP BY clause_id",
    "G06_merge_adjacent": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first) AS INT) AS place, turns, chars FROM (SELECT conv_id, min(turn) AS first, count(*) AS turns, CAST(sum(chars) AS BIGINT) AS chars FROM (SELECT conv_id, turn, chars, CASE WHEN role = 'assistant' THEN turn - 1 ELSE turn END AS island FROM (SELECT conv_id, turn, min(role) AS role, sum(length(text)) AS chars FROM conversations GROUP BY conv_id, turn)) GROUP BY conv_id, island)",
    "G07_audit_rows": f"WITH {EVENTS} SELECT e.seq, e.entity, e.status, coalesce(c.c_name, 'unknown') AS name FROM ev e LEFT JOIN customer c ON c.c_custkey = CASE WHEN e.status = 'view' THEN e.entity ELSE e.entity + 1 END",
    "G08_impact_audit": f"{W3} SELECT r.r_name, n.n_name, p.id, c.id AS clause_id FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN projects p ON p.discipline = n.n_nationkey AND p.revision = 1 LEFT JOIN clauses c ON c.project_id = p.id AND c.decision = 'P'",
    "G09_clause_flags": f"{W3} SELECT c.id, count(k.rank) AS candidates, max(k.score) AS best, max(CASE WHEN k.relation = 'R' THEN 1 ELSE 0 END) AS rejected, CASE WHEN EXISTS (SELECT 1 FROM projects p WHERE p.id = c.project_id AND p.state = 'archived') THEN 1 ELSE 0 END AS archived FROM clauses c LEFT JOIN candidates k ON k.clause_id = c.id GROUP BY c.id, c.project_id",
    "G10_catalogue_page": f"""{W3}, page AS (SELECT id, title, balance, count(*) OVER (PARTITION BY title) AS same_title, row_number() OVER (PARTITION BY title ORDER BY balance DESC, id DESC) AS newest FROM projects WHERE state = 'active'),
cut AS (SELECT * FROM page ORDER BY balance DESC, id DESC LIMIT 50),
stats AS (SELECT project_id, count(*) AS clauses, sum(CASE WHEN decision = 'F' THEN 1 ELSE 0 END) AS keep, sum(CASE WHEN decision = 'P' THEN 1 ELSE 0 END) AS removed FROM clauses WHERE project_id IN (SELECT id FROM cut) GROUP BY project_id),
last AS (SELECT project_id, id FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY reviewed_at DESC, id DESC) AS n FROM clauses WHERE project_id IN (SELECT id FROM cut)) WHERE n = 1)
SELECT c.id, c.title, c.same_title, c.newest = 1 AS is_newest, coalesce(s.clauses, 0) AS clauses, CAST(coalesce(s.keep, 0) AS BIGINT) AS keep, CAST(coalesce(s.removed, 0) AS BIGINT) AS removed, l.id AS last_clause FROM cut c LEFT JOIN stats s ON s.project_id = c.id LEFT JOIN last l ON l.project_id = c.id""",
    "G11_bulk_review_page": f"""{W3}, ctx AS (SELECT id, project_id, decision, lag(id) OVER (PARTITION BY project_id ORDER BY id) AS previous, lead(id) OVER (PARTITION BY project_id ORDER BY id) AS following FROM clauses),
t AS (SELECT count(*) AS total FROM ctx WHERE decision = 'O'), g AS (SELECT * FROM ctx WHERE decision = 'O' ORDER BY id LIMIT 25 OFFSET 50),
v AS (SELECT clause_id, count(*) AS visible FROM candidates WHERE relation <> 'R' AND clause_id IN (SELECT id FROM g) GROUP BY clause_id)
SELECT t.total, g.id, g.previous, g.following, coalesce(v.visible, 0) AS visible FROM t LEFT JOIN g ON 1 = 1 LEFT JOIN v ON v.clause_id = g.id""",
    "G12_clause_detail": f"WITH {LINES}, top AS (SELECT clause_id, pos, CASE WHEN relation = 'R' THEN 'excluded' ELSE 'visible' END AS part, row_number() OVER (PARTITION BY clause_id, CASE WHEN relation = 'R' THEN 1 ELSE 0 END ORDER BY pos) AS n FROM lines) SELECT clause_id, part, count(*) AS n, CAST(sum(CASE WHEN n <= 3 THEN pos ELSE 0 END) AS BIGINT) AS shown FROM top GROUP BY clause_id, part",
    "Q02_insights": f"WITH {LINES} SELECT CASE WHEN score >= 0.45 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, CAST(sum(CASE WHEN relation = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(CAST(sum(CASE WHEN relation = 'A' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN relation <> 'N' THEN 1 ELSE 0 END), 0), 4) AS accuracy FROM lines GROUP BY CASE WHEN score >= 0.45 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END",
    "Q03_verdict_violations": f"WITH {LINES} SELECT clause_id, pos, CASE WHEN relation = 'A' AND score < 0.05 THEN 'score' WHEN relation = 'N' AND confidence > 0.09 THEN 'confidence' ELSE 'rank' END AS violation FROM lines WHERE (relation = 'A' AND score < 0.05) OR (relation = 'N' AND confidence > 0.09) OR pos > 6",
    "Q04_relevant_rank": f"WITH {LINES} SELECT o.o_orderkey AS id, coalesce(min(CASE WHEN l.section_id % 17 = 0 THEN l.pos END), min(CASE WHEN l.code = 1 THEN l.pos END), min(CASE WHEN l.relation = 'A' THEN l.pos END)) AS relevant_rank FROM orders o LEFT JOIN lines l ON l.clause_id = o.o_orderkey GROUP BY o.o_orderkey",
    "K01_review_export": f"{W3} SELECT c.id, c.decision, k.section_id FROM clauses c LEFT JOIN (SELECT clause_id, min(section_id) AS section_id FROM candidates WHERE rank = 1 GROUP BY clause_id) k ON k.clause_id = c.id WHERE c.decision <> 'P' ORDER BY c.project_id, c.id",
    "K02_audit_sheets": f"{W3}, {LINES}, {EVENTS} SELECT 'decisions' AS sheet, id AS entity, decision || '/' || reason AS detail FROM clauses WHERE decision <> 'O' UNION ALL SELECT 'impacts', clause_id, CAST(pos AS VARCHAR) FROM lines WHERE relation = 'R' UNION ALL SELECT 'workflow', seq, status FROM ev WHERE status <> 'view'",
    "K04_manifest": "SELECT page_id, sha256(html) AS digest, CAST(strlen(html) AS INT) AS bytes FROM pages",
    "K05_rebuild_check": "SELECT 'nation' AS t, count(*) AS n, count(CASE WHEN r.r_regionkey IS NULL THEN 1 END) AS orphans, true AS whole FROM nation LEFT JOIN region r ON r.r_regionkey = n_regionkey UNION ALL SELECT 'customer', count(*), count(CASE WHEN n.n_nationkey IS NULL THEN 1 END), true FROM customer LEFT JOIN nation n ON n.n_nationkey = c_nationkey",
    "K06_upsert": f"{W3}, up AS (SELECT id, 'new' AS decision, 1 AS fresh FROM clauses WHERE id % 5 = 0 UNION ALL SELECT id + 10000000, 'added', 1 FROM clauses WHERE id % 100 = 0), allrows AS (SELECT id, decision, 0 AS fresh FROM clauses UNION ALL SELECT * FROM up) SELECT id, decision FROM (SELECT id, decision, row_number() OVER (PARTITION BY id ORDER BY fresh DESC) AS n FROM allrows) WHERE n = 1",
    "X02_idempotent_queue": f"WITH {EVENTS} SELECT entity, status, min(seq) AS first_seq FROM ev GROUP BY entity, status",
    "X04_recovery": f"WITH {EVENTS}, last AS (SELECT entity, seq, status, row_number() OVER (PARTITION BY entity ORDER BY seq DESC) AS n FROM ev) SELECT entity, CASE WHEN status = 'click' THEN 'queued' WHEN status = 'error' THEN 'failed' ELSE 'completed' END AS state FROM last WHERE n = 1",
    "X05_stale": "SELECT event_id, datesub('second', ts, now) <= CASE WHEN event_type = 'error' THEN 60 ELSE 86400 END AS fresh FROM (SELECT event_id, event_type, ts, max(ts) OVER () AS now FROM events)",
    "X06_batch_limits": "SELECT user_id AS entity, concat_ws(',', CASE WHEN count(*) > 200 THEN 'files' END, CASE WHEN max(value) > 25 THEN 'file' END, CASE WHEN sum(value) > 250 THEN 'batch' END) AS refused FROM events GROUP BY user_id",
    "E02_unavailable_reason": "SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN doc_id % 50 = 7 THEN 'code mismatch' WHEN n_chars < 20 THEN 'no sections' ELSE 'ok' END AS reason FROM documents",
    "E03_bound_revision": "SELECT n_nationkey, sha256(concat_ws(':', n_name, CASE WHEN n_regionkey = 0 THEN NULL ELSE CAST(n_regionkey AS VARCHAR) END)) AS revision FROM nation",
    "E04_valid_documents": "SELECT doc_id, (lang IN ('en', 'de') AND n_chars > 100) AS valid FROM documents",
    "E12_structure_snapshot": f"WITH {REVIEW}, k AS (SELECT clause_id AS clause, count(*) AS k FROM lines GROUP BY clause_id) SELECT rc.project AS project_id, count(*) AS clauses, CAST(sum(coalesce(k.k, 0)) AS BIGINT) AS candidates, sha256(string_agg(rc.clause || ':' || coalesce(k.k, 0) || ':' || coalesce(cov.coverage, 'none'), ',' ORDER BY rc.clause)) AS digest FROM rc LEFT JOIN k ON k.clause = rc.clause LEFT JOIN cov ON cov.clause = rc.clause GROUP BY rc.project",
    "E13_decision_snapshot": f"WITH {REVIEW} SELECT rc.clause AS id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN rc.selected IS NULL THEN [] ELSE [CAST(rc.selected AS INT)] END, cov.evidence))), ',') AS evidence FROM rc JOIN cov ON cov.clause = rc.clause WHERE rc.decision IS NOT NULL",
    "E15_queue_reads": f"WITH {EVENTS} SELECT entity, count(CASE WHEN status IN ('click', 'view') THEN 1 END) AS active, max(seq) AS last_seq, min(CASE WHEN status = 'click' THEN seq END) AS next_pending FROM ev GROUP BY entity",
    "E16_transitions": f"WITH {EVENTS} SELECT seq, CASE WHEN status = 'click' AND value > 50 THEN 'running' WHEN status = 'click' THEN 'pending' WHEN status = 'error' AND entity % 2 = 0 THEN 'pending' ELSE status END AS next FROM ev",
    "E17_upload_progress": f"WITH {EVENTS} SELECT entity, CAST(sum(CASE WHEN status = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS completed, count(*) AS items, CASE WHEN sum(CASE WHEN status IN ('click', 'view') THEN 1 ELSE 0 END) = 0 THEN 'finished' ELSE 'running' END AS state FROM ev GROUP BY entity",
    "E18_acknowledge": f"WITH {REVIEW} SELECT rc.clause AS id, CASE WHEN decision IS NULL OR NOT {_VALID} OR u.clause IS NOT NULL THEN 'refused' ELSE 'acknowledged' END AS outcome FROM rc LEFT JOIN unsafe u ON u.clause = rc.clause",
    "E19_blocked_removals": f"WITH {REVIEW} SELECT k.clause AS clause_id, k.candidate AS pos FROM rk k WHERE k.relation = 'unrelated' AND (EXISTS (SELECT 1 FROM rc WHERE rc.clause = k.clause AND rc.selected = k.candidate) OR EXISTS (SELECT 1 FROM cov WHERE cov.clause = k.clause AND list_contains(cov.evidence, k.candidate)))",
    "E20_project_summary": f"{W3} SELECT p.id, (SELECT count(*) FROM projects q WHERE q.title = p.title AND q.state = 'active' AND q.revision = 2) AS duplicates, NOT EXISTS (SELECT 1 FROM projects q WHERE q.title = p.title AND q.state = 'active' AND q.revision = 2 AND (q.balance > p.balance OR (q.balance = p.balance AND q.id > p.id))) AS newest FROM projects p WHERE p.state = 'active' AND p.revision = 2",
    "E21_catalogue": f"{W3} SELECT p.id, p.title, count(c.id) AS clauses FROM projects p LEFT JOIN clauses c ON c.project_id = p.id WHERE p.state = 'active' GROUP BY p.id, p.title",
    "E22_workflow_view": f"WITH {EVENTS} SELECT a.entity, a.seq, b.n_name FROM ev a JOIN nation b ON b.n_nationkey = a.entity % 25 WHERE a.status = 'purchase' ORDER BY a.ts, a.seq",
    "E23_quality_snapshot": f"WITH {LINES} SELECT clause_id, string_agg(CAST(code AS VARCHAR), ',' ORDER BY pos) AS snapshot FROM lines WHERE pos <= 3 GROUP BY clause_id",
    "E24_document_map": "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn",
    "E28_neighbour_context": "SELECT conv_id, turn, CASE WHEN length(text) < 200 THEN last_value(CASE WHEN role <> 'system' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS pulled FROM conversations",
    "E30_summaries": f"{W3} SELECT p.id, count(DISTINCT c.id) AS clauses, max(k.score) AS best FROM projects p LEFT JOIN clauses c ON c.project_id = p.id LEFT JOIN candidates k ON k.clause_id = c.id AND k.relation <> 'R' GROUP BY p.id",
    "S11_continuations": "SELECT conv_id, island, count(*) AS merged, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT conv_id, turn, text, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM conversations) GROUP BY conv_id, island",
    "W09_fill_down": "SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events",
    "W12_relative_priority": f"WITH {LINES} SELECT clause_id, pos, round(CAST(1.0 AS DOUBLE) / (60 + pos) / max(CAST(1.0 AS DOUBLE) / (60 + pos)) OVER (PARTITION BY clause_id), 6) AS priority FROM lines",
    "S03_usable_sections": "SELECT source, count(*) AS usable FROM documents WHERE length(trim(coalesce(text, ''))) > 0 GROUP BY source",
    "S04_section_dedupe": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY source, lang, text",
    "S05_context": "SELECT conv_id, turn, coalesce(lead(CASE WHEN length(text) > 100 THEN turn END, 1) OVER w, lead(CASE WHEN length(text) > 100 THEN turn END, 2) OVER w, lead(CASE WHEN length(text) > 100 THEN turn END, 3) OVER w) AS forward FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "S06_catalogue_scan": "SELECT code, p_partkey, catalogue FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY p_partkey) AS n FROM (SELECT CAST(p_size * 20000 + p_partkey % 97 AS VARCHAR) AS code, p_partkey, p_name || ' ' || p_type AS catalogue FROM part)) WHERE n = 1 AND length(code) >= 6",
    "S02_latest_version": "SELECT p_brand, p_partkey AS latest FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name DESC, p_partkey DESC) AS n FROM part) WHERE n = 1",
    "S01_prefix_scan": "SELECT p.p_partkey FROM part p WHERE p.p_brand LIKE 'Brand#1%' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey)",
    "I05_id_assignments": f"WITH {_SIDES} SELECT clause_id, pos, coalesce(preserved, {_UUID}) AS assigned_id, preserved IS NOT NULL AS reused, moved AS metadata_changed FROM g",
    "J08_unsafe_deletes": f"WITH {REVIEW} SELECT clause AS clause_id FROM unsafe",
    "G04_four_eyes": f"WITH {EVENTS}, w AS (SELECT entity, seq, status, seq % 5 AS who, last_value(CASE WHEN status = 'view' THEN seq % 5 END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS author FROM ev) SELECT entity, seq FROM w WHERE status = 'purchase' AND author = who",
    "G06_split_in_two": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) AS INT) AS place, turn, part, sha256(piece) AS digest FROM (SELECT conv_id, turn, 0 AS part, CASE WHEN length(text) // 2 >= 100 THEN substr(text, 1, length(text) // 2) ELSE text END AS piece FROM (SELECT conv_id, turn, max(text) AS text FROM conversations GROUP BY conv_id, turn) UNION ALL SELECT conv_id, turn, 1, substr(text, length(text) // 2 + 1) FROM (SELECT conv_id, turn, max(text) AS text FROM conversations GROUP BY conv_id, turn) WHERE length(text) // 2 >= 100)",
    "K03_quality_sheets": f"WITH {LINES}, r AS (SELECT clause_id, section_id, relation = 'A' AS hit, CASE WHEN score >= 0.45 THEN 'high' ELSE 'low' END AS band FROM lines WHERE pos = 1) SELECT 'summary' AS sheet, 'evaluated' AS name, count(*) AS value FROM r UNION ALL SELECT 'summary', 'hits', count(*) FROM r WHERE hit UNION ALL SELECT 'groups', band, count(CASE WHEN hit THEN 1 END) FROM r GROUP BY band UNION ALL SELECT 'details', CAST(clause_id AS VARCHAR), section_id FROM r WHERE NOT hit",
    "E14_rematch_state": f"WITH {REVIEW} SELECT project AS project_id, sha256(string_agg(clause || '|' || coalesce(decision, '-') || '|' || coalesce(CAST(selected AS VARCHAR), '-'), ';' ORDER BY clause)) AS state FROM rc GROUP BY project",
}
