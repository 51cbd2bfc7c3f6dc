"""Whether a clause may be deleted: merging of judged source segments, guards, and the rules of decisions and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.sources.documents import chunk_lengths, greedy_batches

from lintel.functions import links as L
from lintel.functions import quantities as N
from lintel.functions import text as X

# Reasons that a decision may have, verdicts that allow a deletion, and how sure they must be.
DECISION_REASONS = {
    "keep": ["own_specific", "own_stricter", "partial_overlap_residual", "no_kcs_match"],
    "delete": ["fully_covered_by_kcs", "internal_duplicate", "obsolete_requirement", "out_of_scope", "editorial_cleanup", "management_decision"],
    "hold": ["needs_expert_review", "candidate_uncertain", "kcs_conflict"],
}
SAFE_RELATIONS, SURE = ["equivalent", "kcs_covers"], 0.85
MOST_CALLS = 64


def merge_segments(rows: DataFrame, forced: DataFrame) -> DataFrame:
    """clause, segment, status, evidence, confidence. rows: clause, segment, call, status, evidence (array), confidence; forced: clause,
    segment of segments whose coverage is never sure (their text was split, or candidates came in several packs)."""
    has = lambda s: F.bool_or(F.col("status") == s)
    both = has("covered") & has("not_covered")
    status = F.when(has("conflict"), "conflict").when(has("uncertain") | both, "uncertain").when(has("covered"), "covered").otherwise("not_covered")
    first = rows.groupBy("clause", "segment").agg(status.alias("base"), F.min("confidence").alias("confidence"), F.collect_list(F.struct("call", "status", "evidence")).alias("calls"))
    decisive = F.filter(F.array_sort("calls"), lambda c: (c["status"] == F.col("base")) | (F.col("base") == "uncertain") & c["status"].isin("covered", "not_covered"))
    evidence = F.array_distinct(F.flatten(F.transform(decisive, lambda c: c["evidence"])))
    marked = first.join(forced.select("clause", "segment", F.lit(True).alias("forced")).distinct(), ["clause", "segment"], "left")
    final = F.when((F.col("base") == "covered") & F.coalesce("forced", F.lit(False)), "uncertain").otherwise(F.col("base"))
    return marked.select("clause", "segment", final.alias("status"), evidence.alias("evidence"), "confidence")


def merge_clauses(segments: DataFrame) -> DataFrame:
    """clause, coverage, confidence, evidence, covered, segments: conflict and doubt win, coverage needs every segment."""
    is_ = lambda s: F.col("status") == s
    own = F.bool_and(is_("not_covered")) & F.bool_and(F.size("evidence") == 0)
    coverage = F.when(F.bool_or(is_("conflict")), "conflict").when(F.bool_or(is_("uncertain")), "uncertain").when(F.bool_and(is_("covered")), "fully_covered").when(own, "own_specific").otherwise("partially_covered")
    evidence = F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence"))))
    return segments.groupBy("clause").agg(coverage.alias("coverage"), F.min("confidence").alias("confidence"), evidence.alias("evidence"), F.count_if(is_("covered")).alias("covered"), F.count(F.lit(1)).alias("segments"))


def deletion_safe(merged: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds deletion_safe. candidates: clause, candidate, warnings (how many), relation (null if not analysed), confidence.

    Everything is covered and sure; there is evidence; each piece of it is a candidate of the clause, without warnings, and if it was
    analysed, with a safe and sure verdict."""
    unsafe = F.col("relation").isNotNull() & (~F.col("relation").isin(SAFE_RELATIONS) | (F.col("c_confidence") < SURE))
    pieces = merged.select("clause", F.explode("evidence").alias("candidate"))
    facts = candidates.select("clause", "candidate", "warnings", "relation", F.col("confidence").alias("c_confidence"))
    bad = pieces.join(facts, ["clause", "candidate"], "left").where(F.col("warnings").isNull() | (F.col("warnings") > 0) | unsafe).select("clause").distinct().withColumn("bad", F.lit(True))
    safe = (F.col("coverage") == "fully_covered") & (F.col("confidence") >= SURE) & (F.col("covered") == F.col("segments")) & (F.size("evidence") > 0) & F.col("bad").isNull()
    return merged.join(bad, "clause", "left").withColumn("deletion_safe", safe).drop("bad")


def guarded(status: Column, requirement: Column, evidence: Column) -> Column:
    """A covered requirement becomes uncertain if the evidence names another mortar, links only by a standard's scope, or lacks a quantity."""
    indirect = F.exists(L.standard_links(requirement, evidence), lambda x: x["reference_type"] == "indirect")
    mortar = X.named_mortar_mismatch(requirement, evidence) & ~indirect
    numbers = F.array_contains(N.differences(requirement, evidence)["categories"], "quantity")
    return F.when((status == "covered") & (mortar | indirect | numbers), "uncertain").otherwise(status)


def valid_decision(decision: Column, reason: Column, content: Column, edited: Column) -> Column:
    """Whether a decision has one of its reasons; a kept rest must have been edited."""
    known = F.create_map(*[x for d, r in DECISION_REASONS.items() for x in (F.lit(d), F.array(*map(F.lit, r)))])
    untouched = (F.trim(X.text(edited)) == "") | (F.trim(X.text(edited)) == F.trim(X.text(content)))
    listed = F.coalesce(F.array_contains(F.element_at(known, decision), reason), F.lit(False))
    return F.when(decision.isNull(), True).otherwise(listed & ~((decision == "keep") & (reason == "partial_overlap_residual") & untouched))


def unsafe_deletes(clauses: DataFrame, candidates: DataFrame, coverage: DataFrame) -> DataFrame:
    """Clauses deleted as covered whose selection or coverage does not bear it.

    clauses: clause, source_type, decision, reason, selected, confirmed; candidates: clause, candidate, warnings, relation, confidence;
    coverage: clause, deletion_safe, evidence."""
    asked = clauses.where("source_type <> 'heading' AND decision = 'delete' AND reason = 'fully_covered_by_kcs'").select("clause", "selected", "confirmed")
    unsafe = F.col("relation").isNotNull() & (~F.col("relation").isin(SAFE_RELATIONS) | (F.col("confidence") < SURE))
    facts = candidates.select("clause", "candidate", "warnings", unsafe.alias("unsafe"))
    chosen = facts.select("clause", F.col("candidate").alias("selected"), "warnings", "unsafe")
    weak = coverage.select("clause", F.explode("evidence").alias("candidate")).join(facts.where("unsafe"), ["clause", "candidate"], "left_semi").select("clause").distinct().withColumn("weak", F.lit(True))
    rows = asked.join(chosen, ["clause", "selected"], "left").join(coverage, "clause", "left").join(weak, "clause", "left")
    no, without = F.lit(False), F.col("deletion_safe").isNotNull() & (~F.col("deletion_safe") | ~F.coalesce(F.array_contains("evidence", F.col("selected")), F.lit(False)))
    bad = F.col("selected").isNull() | ~F.coalesce("confirmed", no) | F.col("warnings").isNull() | (F.col("warnings") > 0) | F.coalesce("unsafe", no) | F.coalesce("weak", no) | without
    return rows.where(bad).select("clause")


#: Blockers of an export in their order: name, whether a count follows.
BLOCKERS = [("reupload", False), ("stale", False), ("rematch", False), ("impacts", True), ("unreviewed", True), ("reasons", True), ("holds", True), ("deletes", True)]
BY_STATUS = {"reviewing": "submit", "submitted": "approve", "changes_requested": "resubmit"}


def export_readiness(projects: DataFrame, clauses: DataFrame, unsafe: DataFrame, impacts: DataFrame, current: str, parser: str) -> DataFrame:
    """project, reviewable, blockers (those of the final export, in order), submission_ready, export_ready.

    projects: project, status, revision, parser_version, rematch (status of the latest run for the current revision, or null),
    approved (whether the latest submission is). clauses: clause, project, source_type, decision, reason, content, edited."""
    shown = clauses.where("source_type <> 'heading'")
    valid = valid_decision(F.col("decision"), F.col("reason"), F.col("content"), F.col("edited"))
    counts = shown.join(unsafe.select("clause", F.lit(1).alias("unsafe")), "clause", "left").groupBy("project").agg(
        F.count(F.lit(1)).alias("reviewable"), F.count_if(F.col("decision").isNull()).alias("n_unreviewed"), F.count_if(~valid).alias("n_reasons"),
        F.count_if(F.col("decision") == "hold").alias("n_holds"), F.count("unsafe").alias("n_deletes"),
    )
    rows = projects.join(counts, "project", "left").join(impacts.withColumnRenamed("impacts", "n_impacts"), "project", "left").na.fill(0, ["reviewable", "n_unreviewed", "n_reasons", "n_holds", "n_deletes", "n_impacts"])
    reupload = ~F.col("parser_version").eqNullSafe(F.lit(parser))
    running = F.coalesce(F.col("rematch").isin("pending", "running", "failed"), F.lit(False))
    stale = ~F.col("revision").eqNullSafe(F.lit(current)) & ~reupload & ~running
    holds = {"reupload": reupload, "stale": stale, "rematch": running} | {n: F.col(f"n_{n}") > 0 for n, counted in BLOCKERS if counted}
    label = {n: F.concat_ws(":", F.lit(n), F.col(f"n_{n}").cast("string")) if counted else F.lit(n) for n, counted in BLOCKERS} | {"rematch": F.concat_ws(":", F.lit("rematch"), "rematch")}
    technical = [F.when(holds[n], label[n]) for n, _ in BLOCKERS]
    final = F.coalesce(*[F.when(F.col("status") == s, F.lit(b)) for s, b in BY_STATUS.items()], F.when(F.col("status") != "approved", F.lit("status")), F.when(~F.coalesce("approved", F.lit(False)), F.lit("record")))
    ready = F.size(F.array_compact(F.array(*technical))) == 0
    return rows.select("project", "reviewable", F.array_compact(F.array(*technical, final)).alias("blockers"), (ready & F.col("status").isin("reviewing", "changes_requested")).alias("submission_ready"), (ready & final.isNull()).alias("export_ready"))


def call_plan(segments: DataFrame, packs: DataFrame, most: int = MOST_CALLS) -> DataFrame:
    """clause, calls, allowed. segments: clause, batch (of source segments); packs: clause, pack (of candidates; none counts as one)."""
    n = segments.groupBy("clause").agg(F.count_distinct("batch").alias("batches"))
    m = packs.groupBy("clause").agg(F.count_distinct("pack").alias("packs"))
    calls = F.col("batches") * F.coalesce("packs", F.lit(1))
    return n.join(m, "clause", "left").select("clause", calls.alias("calls"), (calls <= most).alias("allowed"))


# What one call may hold, in characters and segments, and what each segment or candidate adds to its text.
SEGMENTS_A_CALL, SEGMENT_CHARS, CANDIDATE_CHARS, PACK_CHARS = 24, 8_000, 8_000, 48_000
SEGMENT_EXTRA, CANDIDATE_EXTRA = 3, 12


def _numbered_batches(rows: DataFrame, order: list[str], size: Column, count: int, chars: int, into: str) -> DataFrame:
    """clause and a row for each batch that its sizes, in order, are put into. The sizes of one clause are an array; its texts do not move."""
    sizes = rows.groupBy("clause").agg(F.array_sort(F.collect_list(F.struct(*order, size.cast("long").alias("size")))).alias("rows"))
    batches = greedy_batches(F.transform("rows", lambda r: r["size"]), count, chars)
    return sizes.select("clause", F.explode_outer(F.array_distinct(batches)).alias(into))


def planned_calls(segments: DataFrame, candidates: DataFrame, most: int = MOST_CALLS) -> DataFrame:
    """clause, calls, allowed: source batches times packs of candidates.

    segments: clause, n (from 1), text; at most SEGMENTS_A_CALL of them and SEGMENT_CHARS make a batch. candidates: clause, n, ref, text; texts
    are cut at CANDIDATE_CHARS, parts bear their number, and PACK_CHARS make a pack."""
    said = F.char_length(F.concat(F.lit("S"), F.col("n").cast("string"))) + F.char_length("text") + SEGMENT_EXTRA
    batches = _numbered_batches(segments, ["n"], said, SEGMENTS_A_CALL, SEGMENT_CHARS, "batch")
    parts = candidates.select("clause", "n", "ref", chunk_lengths(F.col("text"), CANDIDATE_CHARS).alias("parts"))
    parts = parts.select("clause", "n", "ref", F.size("parts").alias("of"), F.posexplode_outer("parts").alias("part", "chars"))  # outer, as for others Spark asks twice whether there are any
    label = F.when(F.col("of") == 1, F.col("ref")).otherwise(F.concat("ref", F.lit(" · 부분 "), (F.col("part") + 1).cast("string"), F.lit("/"), F.col("of").cast("string")))
    packs = _numbered_batches(parts, ["n", "part"], F.char_length(label) + F.col("chars") + CANDIDATE_EXTRA, 1 << 30, PACK_CHARS, "pack")
    return call_plan(batches, packs, most)


#: Candidates that a clause shows.
SHOWN = 3


def current_coverage(clauses: DataFrame, judged: DataFrame, visible: DataFrame) -> DataFrame:
    """clause, current: whether the first SHOWN candidates that a coverage was judged on are those that are visible now. judged, visible:
    clause, pos (rank); a clause without candidates on both sides is current."""

    def first(rows: DataFrame, into: str) -> DataFrame:
        top = rows.withColumn("n", F.row_number().over(Window.partitionBy("clause").orderBy("pos"))).where(F.col("n") <= SHOWN)
        return top.groupBy("clause").agg(F.array_sort(F.collect_list("pos")).alias(into))

    both = clauses.join(first(judged, "then"), "clause", "left").join(first(visible, "now"), "clause", "left")
    return both.select("clause", F.col("then").eqNullSafe(F.col("now")).alias("current"))
