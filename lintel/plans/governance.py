"""Impact of revisions, coverage, quality, workflow, catalogue pages and state machines, as DataFrames; see `star` for the roles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lintel.functions import identity as D
from lintel.operators import coverage as V
from lintel.operators import impact as M
from lintel.operators import relational as P
from lintel.plans.governance_sql import SQL
from lintel.plans.registry import query, table
from lintel.plans.star import Star, star_query
from lintel.session import staged
from lintel.streaming import queues as Q



def _add(name: str):
    return star_query(name, SQL)


def _clause(df):
    return df.withColumnRenamed("clause", "clause_id")


# revision impact


@_add("I01_snapshot_sync")
def _(t: Star):
    rows = t.projects.select(F.col("project").alias("id"), "balance", "title")
    new = rows.where("id % 10 <> 2").withColumn("balance", F.when(F.col("id") % 7 == 0, F.col("balance") + 1).otherwise(F.col("balance")))
    changes = P.snapshot_changes(rows.where("id % 10 <> 1"), new, ["id"], ["balance", "title"])
    return changes.select("id", F.when(F.col("change") == "removed", "unavailable").otherwise(F.col("change")).alias("state"))


@_add("I02_integrity_counts")
def _(t: Star):
    return t.table("documents").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"), F.count_if(F.col("n_chars") != F.length("text")).alias("wrong"), F.count_distinct("source").alias("sources"))


@_add("I03_snapshot_gate")
def _(t: Star):
    """Each table against a manifest that states its rows and digest; the first rule that fails is the reason."""

    def facts(name: str, key: str):
        rows = t.table(name)
        line = rows.select(F.concat_ws("|", *[F.col(c).cast("string") for c in rows.columns]).alias("row"), F.col(key).cast("string").alias("key"))
        return P.rolled_digest(line, "key", ["row"]).crossJoin(rows.agg(F.count(F.lit(1)).alias("n"))).withColumn("name", F.lit(name))

    held = facts("nation", "n_nationkey").unionByName(facts("region", "r_regionkey"))
    manifest = t.spark.createDataFrame([("nation", True, 25), ("region", False, 5), ("supplier", True, 1)], "name string, completed boolean, rows long")
    rows = manifest.join(held, "name", "left")
    reason = F.when(~F.col("completed"), "incomplete").when(F.col("n").isNull(), "missing").when(F.col("n") != F.col("rows"), "count").otherwise("none")
    return rows.select("name", reason.alias("reason"), (reason == "none").alias("readable"))


def _versions(t: Star):
    """Candidates of each clause before and after a revision: the first four, and the second to the fifth in turned order."""
    said = {"code": F.col("code").cast("string"), "number": F.concat(F.lit(" "), F.col("relation")), "title": F.lit("T"), "content": F.concat(F.lit("Text  "), (F.col("section") % 3).cast("string")), "warnings": F.array_compact(F.array(F.when(F.col("relation") == "R", "W")))}
    shown = {"rank": F.col("pos"), "score": F.lit(0.5), "classification": F.lit("c"), "reasons": F.array(F.lit("r")), "version": F.lit("1"), "updated": F.lit("u"), "name": F.lit("n")}
    # lines are numbered once, as both sides read them twice (what is plain ASCII, and the rest)
    rows = staged(t.lines.select("clause", "code", "section", "relation", "pos"), "lines").select("clause", "pos", F.concat_ws("-", F.lit("c"), F.col("clause").cast("string"), F.col("pos").cast("string")).alias("id"), *[v.alias(k) for k, v in (said | shown).items()])
    return rows.where("pos <= 4"), rows.where("pos BETWEEN 2 AND 5").withColumn("pos", 10 - F.col("pos")).drop("id")


@_add("I05_id_assignments")
def _(t: Star):
    return M.assignments(*_versions(t)).select(F.col("clause").alias("clause_id"), "pos", "assigned_id", "reused", "metadata_changed")


def _impacts(t: Star):
    selected = F.when(F.col("clause") % 3 == 0, F.concat_ws("-", F.lit("c"), F.col("clause").cast("string"), F.lit("1"))).when(F.col("clause") % 3 == 1, F.concat_ws("-", F.lit("c"), F.col("clause").cast("string"), F.lit("3")))
    asked = t.lines.select("clause").distinct().join(t.review_clauses, "clause").select("clause", "decision", selected.alias("selected"))
    return M.plan(*_versions(t), asked)


@_add("I05_impact_plan")
def _(t: Star):
    return _clause(_impacts(t).withColumn("reasons", F.array_join("reasons", ",")).drop("decision"))


@_add("I06_apply_plan")
def _(t: Star):
    after = M.applied(_impacts(t), t.review_clauses.select("clause", "confirmed"))
    return _clause(after.select("clause", "decision", "selected", "coverage_valid"))


@_add("I08_publish_revision")
def _(t: Star):
    pending = t.clauses.where("decision = 'P'").select("project").distinct().withColumn("pending", F.lit(True))
    state = F.when(F.col("revision") == 2, "current").when(F.col("state") == "archived", "skipped").when(F.col("pending"), "superseded").otherwise("queued")
    return t.projects.join(pending, "project", "left").select(F.col("project").alias("id"), state.alias("next"))


@_add("U05_snapshot_diff")
def _(t: Star):
    old = t.projects.select(F.col("project").alias("id"), "title")
    new = old.withColumn("title", F.when(F.col("id") % 11 != 0, F.col("title")))
    return P.snapshot_changes(old, new, ["id"], ["title"]).where("change = 'changed'").select("id")


@_add("U07_decision_preservation")
def _(t: Star):
    rows = t.clauses.select(F.col("clause").alias("id"), "decision", "reason")
    after = rows.where("id % 8 <> 0").withColumn("decision", F.when(F.col("id") % 13 == 0, "X").otherwise(F.col("decision")))
    names = F.when(F.col("change") == "added", "new").when(F.col("change") == "removed", "lost").otherwise(F.col("change"))
    return P.snapshot_changes(rows.where("id % 9 <> 0"), after, ["id"], ["decision", "reason"]).where("change <> 'unchanged'").select("id", names.alias("difference"))


@_add("E26_meaning_changed")
def _(t: Star):
    """Of each logical key (clause, code): whether the set of what it says differs between the sides."""
    said = t.lines.groupBy("clause", "code").agg(F.array_sort(F.collect_set(F.when(F.col("pos") <= 3, F.col("relation")))).alias("b"), F.array_sort(F.collect_set(F.when(F.col("pos") >= 2, F.col("relation")))).alias("a"))
    return _clause(said.where((F.size("b") > 0) & (F.size("a") > 0)).select("clause", "code", (F.col("a") != F.col("b")).alias("changed")))


@_add("E27_carry_selection")
def _(t: Star):
    chosen = t.lines.where("pos = 1").select("clause", "section")
    still = chosen.join(t.lines.where("score > 0.5").select("clause", "section"), ["clause", "section"], "left_semi").withColumnRenamed("section", "selected")
    return t.clauses.join(still, "clause", "left").select(F.col("clause").alias("id"), "selected", F.col("selected").isNotNull().alias("confirmed"))


# coverage


@_add("C01_deletion_safe")
def _(t: Star):
    return t.coverage.select(F.col("clause").alias("clause_id"), "coverage", F.array_join("evidence", ",").alias("evidence"), "deletion_safe")


@_add("C02_merge_batches")
def _(t: Star):
    return t.segments.select(F.col("clause").alias("clause_id"), "segment", "status", F.array_join("evidence", ",").alias("evidence"))


@_add("C04_call_cap")
def _(t: Star):
    rows = t.lines
    return _clause(V.call_plan(rows.select("clause", F.floor((F.col("pos") - 1) / 2).alias("batch")), rows.where("relation <> 'R'").select("clause", F.col("code").alias("pack")), 16))


@_add("J08_unsafe_deletes")
def _(t: Star):
    return t.unsafe.select(F.col("clause").alias("clause_id"))


# governance


@_add("G01_blockers")
def _(t: Star):
    impacts = t.review_clauses.select("project", (F.col("clause") % 17 == 0).alias("review_required"), F.when(F.col("clause") % 34 == 0, F.lit(1)).alias("acknowledged_at"))
    ready = V.export_readiness(t.review_projects, t.review_clauses, t.unsafe, M.unacknowledged(impacts, F.col("project")), "r2", "v2")
    return ready.select(F.col("project").alias("id"), "reviewable", F.array_join("blockers", "; ").alias("blockers"), "submission_ready", "export_ready")


@_add("G02_decision_matrix")
def _(t: Star):
    valid = V.valid_decision(F.col("decision"), F.col("reason"), F.col("content"), F.col("edited"))
    return t.review_clauses.where(~valid).select(F.col("clause").alias("id"), "decision", "reason")


@_add("G03_history_on_change")
def _(t: Star):
    was = F.lag("status").over(Window.partitionBy("entity").orderBy("seq"))
    return t.events.withColumn("was", was).where("was IS NULL OR was <> status").select("entity", "seq", "status")


@_add("G04_workflow_fold")
def _(t: Star):
    return P.latest(t.events, ["entity"], [F.desc("seq")]).select("entity", "status", "seq")


#: Events as steps of the review's workflow.
_STEPS = {"view": "submitted", "click": "changes_requested", "purchase": "approved"}


@_add("G04_illegal_transitions")
def _(t: Star):
    """Steps that the review's workflow does not know; an entity begins in review."""
    step = F.coalesce(*[F.when(F.col("status") == a, F.lit(b)) for a, b in _STEPS.items()], F.lit("reviewing"))
    return Q.illegal(t.events.select("entity", "seq", step.alias("status")), "review").select("entity", "seq")


@_add("G04_four_eyes")
def _(t: Star):
    """Approvals by the one who submitted last, whatever the case and the spaces of their name."""
    rows = t.events.withColumn("who", F.lower(F.trim(F.concat(F.lit(" User"), (F.col("seq") % 5).cast("string")))))
    author = P.last_where(F.col("who"), F.col("status") == "view", Window.partitionBy("entity").orderBy("seq"))
    return rows.withColumn("author", author).where("status = 'purchase' AND author = who").select("entity", "seq")


@_add("G05_snapshot_hash")
def _(t: Star):
    line = F.concat_ws(":", F.col("pos").cast("string"), F.col("section").cast("string"), "relation")
    return _clause(t.lines.withColumn("line", line).groupBy("clause").agg(F.sha2(P.ordered_concat(["pos", "line"], "line", "|"), 256).alias("snapshot")))


@_add("G06_merge_adjacent")
def _(t: Star):
    """An answer merges into the turn before it; places are numbered anew, and no text is lost."""
    rows = t.turns.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.sum(F.length("text")).alias("chars"))
    merged = rows.withColumn("at", F.when(F.col("role") == "assistant", F.col("turn") - 1).otherwise(F.col("turn"))).groupBy("conv_id", "at").agg(F.min("turn").alias("first"), F.count(F.lit(1)).alias("turns"), F.sum("chars").alias("chars"))
    return merged.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("first")).alias("place"), "turns", "chars")


@_add("G06_split_in_two")
def _(t: Star):
    """A text split at its middle: the parts follow each other, later clauses move up, and the parts make up the whole."""
    rows = t.turns.groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.when(half >= 100, F.array(F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text")))).otherwise(F.array("text"))
    out = rows.select("conv_id", "turn", F.posexplode(parts).alias("part", "piece"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "part"))
    return out.select("conv_id", place.alias("place"), "turn", "part", F.sha2("piece", 256).alias("digest"))


@_add("G07_audit_rows")
def _(t: Star):
    names = t.projects.select(F.col("project").alias("as_of"), F.col("filename").alias("name"))
    rows = t.events.withColumn("as_of", F.when(F.col("status") == "view", F.col("entity")).otherwise(F.col("entity") + 1))
    return rows.join(names, "as_of", "left").select("seq", "entity", "status", F.coalesce("name", F.lit("unknown")).alias("name"))


@_add("G08_impact_audit")
def _(t: Star):
    runs = t.table("region").join(t.table("nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = runs.join(t.projects.where("revision = 1"), F.col("discipline") == F.col("n_nationkey"), "left").join(t.clauses.where("decision = 'P'"), "project", "left")
    return rows.select("r_name", "n_name", F.col("project").alias("id"), F.col("clause").alias("clause_id"))


@_add("G09_clause_flags")
def _(t: Star):
    facts = t.candidates.groupBy("clause").agg(F.count("rank").alias("candidates"), F.max("score").alias("best"), F.max((F.col("relation") == "R").cast("int")).alias("rejected"))
    archived = t.projects.select("project", (F.col("state") == "archived").cast("int").alias("archived"))
    rows = t.clauses.join(facts, "clause", "left").join(archived, "project", "left")
    return rows.select(F.col("clause").alias("id"), F.coalesce("candidates", F.lit(0)).alias("candidates"), "best", F.coalesce("rejected", F.lit(0)).alias("rejected"), F.coalesce("archived", F.lit(0)).alias("archived"))


@_add("G10_catalogue_page")
def _(t: Star):
    """The page is cut first; counts, decisions and last clauses are then read for its projects only."""
    active = t.projects.where("state = 'active'")
    titles = active.groupBy("title").agg(F.count(F.lit(1)).alias("same_title"), F.max(F.struct("balance", "project")).alias("newest"))
    page = F.broadcast(P.keyset_page(active, "balance", "project", 49))  # 50 rows
    own = t.clauses.join(page.select("project"), "project", "left_semi")
    stats = own.groupBy("project").agg(F.count(F.lit(1)).alias("clauses"), F.count_if(F.col("decision") == "F").alias("keep"), F.count_if(F.col("decision") == "P").alias("removed"), F.max(F.struct("reviewed_at", "clause"))["clause"].alias("last_clause"))
    rows = page.join(titles, "title").join(stats, "project", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("clauses", "keep", "removed")]
    return rows.select(F.col("project").alias("id"), "title", "same_title", (F.col("newest.project") == F.col("project")).alias("is_newest"), *counts, "last_clause")


@_add("G11_bulk_review_page")
def _(t: Star):
    around = P.neighbours(t.clauses.select("clause", "project", "decision"), ["project"], "clause", ["clause"])
    page = P.page_with_total(around.where("decision = 'O'"), ["clause"], 25, 50)
    visible = t.candidates.where("relation <> 'R'").join(F.broadcast(page.select("clause")), "clause", "left_semi").groupBy("clause").agg(F.count(F.lit(1)).alias("visible"))
    return page.join(visible, "clause", "left").select("total", F.col("clause").alias("id"), F.col("prev_clause").alias("previous"), F.col("next_clause").alias("following"), F.coalesce("visible", F.lit(0)).alias("visible"))


@_add("G12_clause_detail")
def _(t: Star):
    part = F.when(F.col("relation") == "R", "excluded").otherwise("visible")
    n = F.row_number().over(Window.partitionBy("clause", "part").orderBy("pos"))
    rows = t.lines.withColumn("part", part).withColumn("n", n)
    return _clause(rows.groupBy("clause", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("n") <= 3, F.col("pos")).otherwise(0)).alias("shown")))


# quality


@_add("Q02_insights")
def _(t: Star):
    band = F.when(F.col("score") >= 0.45, "high").when(F.col("score") >= 0.35, "medium").otherwise("low")
    right, known = F.count_if(F.col("relation") == "A"), F.count_if(F.col("relation") != "N")
    return t.lines.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), right.alias("correct"), F.round(right.cast("double") / F.nullif(known, F.lit(0)), 4).alias("accuracy"))


@_add("Q03_verdict_violations")
def _(t: Star):
    rules = {"score": (F.col("relation") == "A") & (F.col("score") < 0.05), "confidence": (F.col("relation") == "N") & (F.col("confidence") > 0.09), "rank": F.col("pos") > 6}
    first = F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return _clause(t.lines.select("clause", "pos", first.alias("violation")).where("violation IS NOT NULL"))


@_add("Q04_relevant_rank")
def _(t: Star):
    """By the snapshot, else by key, else by what is covered."""
    ways = [F.col("section") % 17 == 0, F.col("code") == 1, F.col("relation") == "A"]
    found = t.lines.groupBy("clause").agg(F.coalesce(*[F.min(F.when(w, F.col("pos"))) for w in ways]).alias("relevant_rank"))
    return t.clauses.join(found, "clause", "left").select(F.col("clause").alias("id"), "relevant_rank")


# sinks' queries, states and remaining reads


@_add("K01_review_export")
def _(t: Star):
    chosen = t.candidates.where("rank = 1").groupBy("clause").agg(F.min("section").alias("section_id"))
    return t.clauses.where("decision <> 'P'").join(chosen, "clause", "left").orderBy("project", "clause").select(F.col("clause").alias("id"), "decision", "section_id")


@_add("K02_audit_sheets")
def _(t: Star):
    """The rows of three sheets, each as sheet, entity, detail."""
    sheet = lambda rows, name, key, detail: rows.select(F.lit(name).alias("sheet"), F.col(key).alias("entity"), detail.alias("detail"))
    decided = t.clauses.where("decision <> 'O'")
    impacts = t.lines.where("relation = 'R'")
    steps = t.events.where("status <> 'view'")
    return sheet(decided, "decisions", "clause", F.concat_ws("/", "decision", "reason")).unionByName(sheet(impacts, "impacts", "clause", F.col("pos").cast("string"))).unionByName(sheet(steps, "workflow", "seq", F.col("status")))


@_add("K03_quality_sheets")
def _(t: Star):
    """Summary, groups and details of the quality sample in one table of sheet, name, value."""
    score = F.when(F.col("score") >= 0.45, "high").otherwise("low")
    rows = t.lines.where("pos = 1").withColumn("band", score).withColumn("hit", F.col("relation") == "A")
    summary = rows.agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("hit").alias("hits")).select(F.stack(F.lit(2), F.lit("evaluated"), F.col("evaluated"), F.lit("hits"), F.col("hits")).alias("name", "value"))
    groups = rows.groupBy("band").agg(F.count_if("hit").alias("value")).select(F.col("band").alias("name"), "value")
    details = rows.where(~F.col("hit")).select(F.col("clause").cast("string").alias("name"), F.col("section").alias("value"))
    return P.tagged({"summary": summary, "groups": groups, "details": details}, "sheet")


@_add("K04_manifest")
def _(t: Star):
    return t.table("pages").select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("bytes"))


@_add("K05_rebuild_check")
def _(t: Star):
    """Each table of a rebuilt snapshot: its rows, its orphans, and whether its columns are those that are asked for."""
    asked = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey"]}
    parents = {"nation": ("region", "n_regionkey", "r_regionkey"), "customer": ("nation", "c_nationkey", "n_nationkey")}
    parts = []
    for name, (parent, key, target) in parents.items():
        rows = t.table(name)
        lost = P.orphans(rows, t.table(parent), key, target).agg(F.count(F.lit(1)).alias("orphans"))
        parts.append(rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(lost).select(F.lit(name).alias("t"), "n", "orphans", F.lit(set(asked[name]) <= set(rows.columns)).alias("whole")))
    return parts[0].unionByName(parts[1])


@_add("K06_upsert")
def _(t: Star):
    held = t.clauses.select(F.col("clause").alias("id"), "decision")
    changed = held.where("id % 5 = 0").withColumn("decision", F.lit("new"))
    fresh = held.where("id % 100 = 0").select((F.col("id") + 10_000_000).alias("id"), F.lit("added").alias("decision"))
    return P.upsert(held, changed.unionByName(fresh), ["id"], "id")


@_add("X02_idempotent_queue")
def _(t: Star):
    return t.events.groupBy("entity", "status").agg(F.min("seq").alias("first_seq"))


@_add("X04_recovery")
def _(t: Star):
    """The state after a restart: what was running is queued again."""
    names = {"click": "running", "error": "failed"}
    status = F.coalesce(*[F.when(F.col("status") == a, F.lit(b)) for a, b in names.items()], F.lit("completed"))
    return Q.recovered(t.events.select("entity", "seq", status.alias("status"))).select("entity", F.col("status").alias("state"))


@_add("X05_stale")
def _(t: Star):
    """Entries of a cache at the time of its last event: failures live a minute, others a day."""
    now = t.events.agg(F.max("ts").alias("now"))
    age = F.timestamp_diff("SECOND", F.col("ts"), F.col("now"))
    alive = F.when(F.col("status") == "error", age <= 60).otherwise(age <= 86_400)
    return t.events.crossJoin(F.broadcast(now)).select(F.col("seq").alias("event_id"), alive.alias("fresh"))


@_add("X06_batch_limits")
def _(t: Star):
    """A batch of more than 200 files, with one above 25 MB, or above 250 MB together is refused; a value stands for MB."""
    rules = {"files": F.count(F.lit(1)) > 200, "file": F.max("value") > 25, "batch": F.sum("value") > 250}
    return t.events.groupBy("entity").agg(P.named(rules, ",").alias("refused"))


@_add("E02_unavailable_reason")
def _(t: Star):
    reason = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").when(F.col("doc_id") % 50 == 7, "code mismatch").when(F.col("n_chars") < 20, "no sections").otherwise("ok")
    return t.table("documents").select("doc_id", reason.alias("reason"))


@_add("E03_bound_revision")
def _(t: Star):
    region = F.when(F.col("n_regionkey") != 0, F.col("n_regionkey").cast("string"))
    return t.table("nation").select("n_nationkey", F.sha2(F.concat_ws(":", "n_name", region), 256).alias("revision"))


@_add("E04_valid_documents")
def _(t: Star):
    return t.table("documents").select("doc_id", (F.col("lang").isin("en", "de") & (F.col("n_chars") > 100)).alias("valid"))


@_add("E12_structure_snapshot")
def _(t: Star):
    """Clauses of each project with how many candidates and what coverage, as one digest that a later snapshot is compared with."""
    counts = t.candidates.groupBy("clause").agg(F.count(F.lit(1)).alias("k"))
    rows = t.review_clauses.join(counts, "clause", "left").join(t.coverage.select("clause", "coverage"), "clause", "left")
    line = F.concat_ws(":", F.col("clause").cast("string"), F.coalesce("k", F.lit(0)).cast("string"), F.coalesce("coverage", F.lit("none")))
    return rows.withColumn("line", line).groupBy(F.col("project").alias("project_id")).agg(F.count(F.lit(1)).alias("clauses"), F.sum(F.coalesce("k", F.lit(0))).alias("candidates"), F.sha2(P.ordered_concat(["clause", "line"], "line", ","), 256).alias("digest"))


@_add("E13_decision_snapshot")
def _(t: Star):
    """The selected candidate and those of the evidence at the time of a decision."""
    rows = t.review_clauses.where("decision IS NOT NULL").join(t.coverage.select("clause", "evidence"), "clause")
    held = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(F.col("selected").cast("int")), "evidence"))))
    return rows.select(F.col("clause").alias("id"), F.array_join(held, ",").alias("evidence"))


@_add("E14_rematch_state")
def _(t: Star):
    """The fingerprint of a project's state before a rematch: decisions and selections in order; equal states have equal fingerprints."""
    line = F.concat_ws("|", F.col("clause").cast("string"), F.coalesce("decision", F.lit("-")), F.coalesce(F.col("selected").cast("string"), F.lit("-")))
    return t.review_clauses.withColumn("line", line).groupBy(F.col("project").alias("project_id")).agg(F.sha2(P.ordered_concat(["clause", "line"], "line", ";"), 256).alias("state"))


@_add("E15_queue_reads")
def _(t: Star):
    return t.events.groupBy("entity").agg(F.count_if(F.col("status").isin("click", "view")).alias("active"), F.max("seq").alias("last_seq"), F.min(F.when(F.col("status") == "click", F.col("seq"))).alias("next_pending"))


@_add("E16_transitions")
def _(t: Star):
    """Runs after one step: a claimed one runs, a retried one waits again, others stay."""
    step = F.when(F.col("status") == "click", F.when(F.col("value") > 50, "running").otherwise("pending")).when((F.col("status") == "error") & (F.col("entity") % 2 == 0), "pending").otherwise(F.col("status"))
    return t.events.select("seq", step.alias("next"))


@_add("E17_upload_progress")
def _(t: Star):
    active = F.count_if(F.col("status").isin("click", "view"))
    return t.events.groupBy("entity").agg(F.count_if(F.col("status") == "purchase").alias("completed"), F.count(F.lit(1)).alias("items"), F.when(active == 0, "finished").otherwise("running").alias("state"))


@_add("E18_acknowledge")
def _(t: Star):
    """An impact may be acknowledged once its clause has a valid decision and, if deleted as covered, a safe one."""
    valid = V.valid_decision(F.col("decision"), F.col("reason"), F.col("content"), F.col("edited"))
    rows = t.review_clauses.join(t.unsafe.withColumn("unsafe", F.lit(True)), "clause", "left")
    refused = F.col("decision").isNull() | ~valid | F.coalesce("unsafe", F.lit(False))
    return rows.select(F.col("clause").alias("id"), F.when(refused, "refused").otherwise("acknowledged").alias("outcome"))


@_add("E19_blocked_removals")
def _(t: Star):
    """An unrelated verdict does not remove a candidate that is selected or evidence."""
    unrelated = t.review_candidates.where("relation = 'unrelated'").select("clause", "candidate")
    selected = t.review_clauses.select("clause", F.col("selected").cast("int").alias("candidate"))
    evidence = t.coverage.select("clause", F.explode("evidence").alias("candidate"))
    return unrelated.join(selected.unionByName(evidence).distinct(), ["clause", "candidate"], "left_semi").select(F.col("clause").alias("clause_id"), F.col("candidate").alias("pos"))


@_add("E20_project_summary")
def _(t: Star):
    current = t.projects.where("state = 'active' AND revision = 2")
    titles = current.groupBy("title").agg(F.count(F.lit(1)).alias("duplicates"), F.max(F.struct("balance", "project"))["project"].alias("newest"))
    return current.join(titles, "title").select(F.col("project").alias("id"), "duplicates", (F.col("newest") == F.col("project")).alias("newest"))


@_add("E21_catalogue")
def _(t: Star):
    return t.projects.where("state = 'active'").join(t.clauses, "project", "left").groupBy(F.col("project").alias("id"), "title").agg(F.count("clause").alias("clauses"))


@_add("E22_workflow_view")
def _(t: Star):
    names = t.table("nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    return t.events.where("status = 'purchase'").withColumn("nation", F.col("entity") % 25).join(names, "nation").orderBy("ts", "seq").select("entity", "seq", "n_name")


@_add("E23_quality_snapshot")
def _(t: Star):
    return _clause(t.lines.where("pos <= 3").groupBy("clause").agg(P.ordered_concat(["pos", "code"], "code", ",").alias("snapshot")))


@_add("E24_document_map")
def _(t: Star):
    return t.turns.orderBy("conv_id", "turn").select("conv_id", "turn", "role")


@_add("E28_neighbour_context")
def _(t: Star):
    before = P.last_where(F.col("turn"), F.col("role") != "system", Window.partitionBy("conv_id").orderBy("turn"))
    return t.turns.select("conv_id", "turn", F.when(F.length("text") < 200, before).alias("pulled"))


@_add("E30_summaries")
def _(t: Star):
    best = t.candidates.where("relation <> 'R'").groupBy("clause").agg(F.max("score").alias("best"))
    rows = t.projects.join(t.clauses, "project", "left").join(best, "clause", "left")
    return rows.groupBy(F.col("project").alias("id")).agg(F.count("clause").alias("clauses"), F.max("best").alias("best"))


@_add("S11_continuations")
def _(t: Star):
    rows = P.islands(t.turns, ["conv_id"], "turn", F.col("role") == "user")
    return rows.groupBy("conv_id", "island").agg(F.count(F.lit(1)).alias("merged"), F.sum(F.length("text")).alias("chars"))


@_add("W09_fill_down")
def _(t: Star):
    filled = F.last(F.when(F.col("status") != "view", F.col("status")), ignorenulls=True).over(Window.partitionBy("entity").orderBy("seq"))
    return t.events.select(F.col("seq").alias("event_id"), F.col("entity").alias("user_id"), filled.alias("filled"))


@_add("W12_relative_priority")
def _(t: Star):
    weight = 1.0 / (60 + F.col("pos"))
    return _clause(t.lines.select("clause", "pos", F.round(weight / F.max(weight).over(Window.partitionBy("clause")), 6).alias("priority")))


@_add("S03_usable_sections")
def _(t: Star):
    return t.table("documents").where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("source").agg(F.count(F.lit(1)).alias("usable"))


@_add("S04_section_dedupe")
def _(t: Star):
    """The first of equal (source, language, text): texts meet by their digest, so that they do not move."""
    rows = t.table("documents").groupBy("source", "lang", F.sha2("text", 256).alias("d"), F.col("text").isNull().alias("none"))
    return rows.agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@_add("S05_context")
def _(t: Star):
    w = Window.partitionBy("conv_id").orderBy("turn")
    marked = t.turns.withColumn("s", F.when(F.length("text") > 100, F.col("turn")))
    return marked.select("conv_id", "turn", F.coalesce(*[F.lead("s", k).over(w) for k in (1, 2, 3)]).alias("forward"))


@_add("S06_catalogue_scan")
def _(t: Star):
    """Codes of at least six digits, the first row of each, with the text that is searched."""
    code = (F.col("p_size") * 20_000 + F.col("p_partkey") % 97).cast("string")
    rows = t.table("part").select(code.alias("code"), "p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("catalogue")).where(F.length("code") >= 6)
    return rows.groupBy("code").agg(F.min_by(F.struct("p_partkey", "catalogue"), "p_partkey").alias("first")).select("code", "first.p_partkey", "first.catalogue")


@_add("S02_latest_version")
def _(t: Star):
    return t.table("part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_size", "p_name", "p_partkey")).alias("latest"))


@_add("S01_prefix_scan")
def _(t: Star):
    sold = t.table("lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return t.table("part").where(F.startswith("p_brand", F.lit("Brand#1"))).join(sold, "p_partkey", "left_semi").select("p_partkey")


@query("L05_spread_sample", "WITH p AS (SELECT c_custkey AS id, c_mktsegment AS title, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT id, title FROM p WHERE n <= 12 OR i IN (SELECT CAST(round_even(j * (p.n - 1) / 11.0, 0) AS BIGINT) FROM (SELECT unnest(range(12)) AS j))")
def spread_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("title"), "c_acctbal")
    return P.spread_sample(rows, ["title"], ["c_acctbal", "id"], 12).select("id", "title")


@query("L06_stratified_sample", """WITH p AS (SELECT o_orderkey AS id, o_orderstatus AS cohort, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
q AS (SELECT *, CASE cohort WHEN 'F' THEN 12 WHEN 'O' THEN 23 ELSE 15 END AS want FROM p)
SELECT id, cohort FROM q WHERE n <= want OR i IN (SELECT CAST(round_even(j * (q.n - 1) / CAST(q.want - 1 AS DOUBLE), 0) AS BIGINT) FROM (SELECT unnest(range(23)) AS j) WHERE j < q.want)""")
def stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("cohort"))
    parts = [P.spread_sample(rows.where(F.col("cohort") == c), ["cohort"], ["id"], n) for c, n in (("F", 12), ("O", 23), ("P", 15))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("L07_scope_sample", "WITH d AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents), s AS (SELECT * FROM d WHERE n <= 40 OR i IN (SELECT CAST(round_even(j * (d.n - 1) / 39.0, 0) AS BIGINT) FROM (SELECT unnest(range(40)) AS j))) SELECT source, sha256(substr(string_agg(substr(text, 1, 300), ' ' ORDER BY doc_id), 1, 12000)) AS sample FROM s GROUP BY source")
def scope_sample(spark, sf_dir):
    rows = P.spread_sample(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), ["source"], ["doc_id"], 40)
    parts = F.array_sort(F.collect_list(F.struct("doc_id", F.substring("text", 1, 300).alias("t"))))
    return rows.groupBy("source").agg(F.sha2(F.substring(F.array_join(F.transform(parts, lambda x: x["t"]), " "), 1, 12000), 256).alias("sample"))


@query("I07_state_hash", "SELECT conv_id, sha256(string_agg(turn || '=' || role, ',' ORDER BY turn, role)) AS state FROM conversations GROUP BY conv_id")
def state_hash(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    text = F.array_join(F.transform(rows, lambda x: F.concat(x["turn"].cast("string"), F.lit("="), x["role"])), ",")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sha2(text, 256).alias("state"))


@query("J21_snapshot_multiset", "WITH b AS (SELECT l_orderkey AS k, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n FROM lineitem WHERE l_linenumber <= 2), a AS (SELECT l_orderkey AS k, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n FROM lineitem WHERE l_linenumber >= 2) SELECT coalesce(b.k, a.k) AS k, coalesce(b.f, a.f) AS f, count(*) AS n, count(b.k) AS before, count(a.k) AS after FROM b FULL JOIN a ON a.k = b.k AND a.f = b.f AND a.n = b.n GROUP BY 1, 2")
def snapshot_multiset(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("o"))
    diff = P.multiset_diff(rows.where("o <= 2"), rows.where("o >= 2"), ["k"], "f", "o")
    return diff.groupBy("k", "f").agg(F.count(F.lit(1)).alias("n"), F.count("before_order").alias("before"), F.count("after_order").alias("after"))
