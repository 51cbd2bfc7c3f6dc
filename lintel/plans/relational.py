"""Joins, aggregates, windows, pages and set operations over projects, clauses and candidates, as DataFrames; see `star` for the roles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lintel.operators import relational as P
from lintel.plans.relational_sql import SQL
from lintel.plans.star import Star, star_query

_rate = lambda hits, of: F.round(hits.cast("double") / F.nullif(of, F.lit(0)), 4)


def _add(name: str):
    return star_query(name, SQL)


# projections and filters


@_add("F01_optional_filters")
def _(t: Star):
    return P.optional_filters(t.projects, {"title": "build", "filename": "", "state": None}).select(F.col("project").alias("id"), "title", "filename")


@_add("F02_status_filters")
def _(t: Star):
    kept = t.projects.where((F.col("state") == "active") & (F.col("revision") != 2))
    return kept.join(t.clauses.where("decision <> 'F'"), "project", "left").groupBy(F.col("project").alias("id")).agg(F.count("clause").alias("open_clauses"))


@_add("F03_literal_prefix")
def _(t: Star):
    return t.projects.where(F.startswith("filename", F.lit("Customer#0000")) & (F.substring("filename", 14, 1) != "_")).select(F.col("project").alias("id"), "filename")


@_add("F04_review_filter")
def _(t: Star):
    return t.clauses.where(F.col("decision").isin("O", "P") & ((F.col("price") > 100000) | F.startswith("reason", F.lit("1-")))).select(F.col("clause").alias("id"), "decision")


@_add("F05_token_or_like")
def _(t: Star):
    docs = t.table("documents").where("lang = 'en'")
    return docs.where(P.holds_any(F.col("text"), ["idiot", "license"]) | F.startswith("source", F.lit("src1"))).select("doc_id")


@_add("F06_eligibility_flags")
def _(t: Star):
    explicit = F.col("section") % 97 == 0
    passed = t.candidates.where(explicit | (F.col("relation") != "R") & (F.col("score") >= 0.25))
    return passed.select(F.col("clause").alias("clause_id"), "rank", (F.col("relation") == "R").alias("blocked"), (F.col("score") < 0.25).alias("low"), explicit.alias("explicit"))


@_add("F07_case_defaults")
def _(t: Star):
    verdict = F.when(F.col("decision") == "F", "keep").when(F.col("decision") == "O", "hold").otherwise("delete")
    return t.clauses.select(F.col("clause").alias("id"), verdict.alias("verdict"), F.coalesce(F.nullif("reason", F.lit("3-MEDIUM")), F.lit("none")).alias("reason"))


@_add("F08_public_fields")
def _(t: Star):
    whole = F.struct(F.col("project").alias("id"), "title", "discipline", "balance")
    shown = whole.withField("label", F.concat_ws(":", "title", F.col("discipline").cast("string"))).dropFields("discipline", "balance")
    return t.projects.select(shown.alias("public")).select("public.*")


@_add("F09_violations")
def _(t: Star):
    rules = {"reason": (F.col("decision") == "P") & (F.col("reason") == "5-LOW"), "residual": F.col("price") < 2000, "unsafe": (F.col("decision") == "O") & (F.col("price") > 400000)}
    return t.clauses.select(F.col("clause").alias("id"), P.named(rules, ",").alias("violations")).where("violations <> ''")


@_add("F10_client_filters")
def _(t: Star):
    return t.clauses.where(F.col("reason") != "4-NOT SPECIFIED").groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("n"))


# joins


@_add("J01_left_join")
def _(t: Star):
    return t.projects.join(t.clauses, "project", "left").groupBy(F.col("project").alias("id")).agg(F.count("clause").alias("clauses"))


@_add("J02_left_join_anti")
def _(t: Star):
    hidden = t.candidates.where((F.col("relation") == "R") & (F.col("confidence") >= 0.05)).select("clause", "rank")
    visible = t.candidates.join(hidden, ["clause", "rank"], "left_anti").groupBy("clause").agg(F.count("rank").alias("visible"), F.max("score").alias("best"))
    return t.clauses.join(visible, "clause", "left").select(F.col("clause").alias("id"), F.coalesce("visible", F.lit(0)).alias("visible"), "best")


@_add("J03_left_analysis")
def _(t: Star):
    analyses = t.candidates.where("relation = 'A'").groupBy("clause", "rank").agg(F.count(F.lit(1)).alias("analyses"))
    return t.candidates.where("rank <= 3").join(analyses, ["clause", "rank"], "left").select(F.col("clause").alias("clause_id"), "rank", "analyses")


@_add("J04_inner_and_left")
def _(t: Star):
    analysts = t.table("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("code"), "s_name")
    rows = t.clauses.where("decision = 'P'").join(t.candidates, "clause").join(analysts, "code", "left")
    return rows.select(F.col("clause").alias("id"), "rank", F.coalesce("s_name", F.lit("none")).alias("analyst"))


@_add("J05_existence_flags")
def _(t: Star):
    pending = t.candidates.where("relation = 'N'").select("clause").distinct().withColumn("pending", F.lit(1))
    return t.clauses.join(pending, "clause", "left").groupBy(F.col("project").alias("project_id")).agg(F.count(F.lit(1)).alias("clauses"), F.count("pending").alias("pending"))


@_add("J06_semi")
def _(t: Star):
    rejected = t.clauses.where("decision = 'P'").join(t.candidates.where("relation = 'R'"), "clause", "left_semi")
    return t.projects.join(rejected, "project", "left_semi").select(F.col("project").alias("id"), "title")


@_add("J07_semi_three")
def _(t: Star):
    nations = t.table("nation").select(F.col("n_nationkey").alias("discipline"), (F.col("n_regionkey") % 3).alias("revision"))
    current = t.projects.join(nations, ["discipline", "revision"], "left_semi")
    return t.clauses.join(current, "project", "left_semi").select(F.col("clause").alias("id"))


@_add("J08_unsafe_delete")
def _(t: Star):
    facts = t.candidates.groupBy("clause").agg(F.bool_or(F.col("rank") == 2).alias("has_second"), F.bool_or(F.col("score") < 0.04).alias("weak"))
    return t.clauses.where("decision = 'F'").join(facts, "clause", "left").where(~F.coalesce("has_second", F.lit(False)) | F.coalesce("weak", F.lit(False))).select(F.col("clause").alias("id"))


@_add("J09_lateral_explode")
def _(t: Star):
    return t.table("embeddings").select("vec_id", F.explode("embedding").alias("x")).groupBy("vec_id").agg(F.count(F.lit(1)).alias("dims"), F.count_if(F.col("x") > 0).alias("positive"))


@_add("J10_page_with_total")
def _(t: Star):
    rows = t.clauses.where("decision = 'P'").select(F.col("clause").alias("id"), "price")
    return P.page_with_total(rows, [F.desc("price"), "id"], 20, 40).select("total", "id", "price")


@_add("J11_latest_row_join")
def _(t: Star):
    last = P.latest(t.clauses, ["project"], [F.desc("reviewed_at"), F.desc("clause")]).select("project", F.col("clause").alias("last_clause"), "decision")
    return t.projects.join(last, "project", "left").select(F.col("project").alias("id"), "last_clause", "decision")


@_add("J12_composite_left")
def _(t: Star):
    stats = t.clauses.groupBy("project", (F.col("clause") % 3).alias("revision")).agg(F.count(F.lit(1)).alias("impacts"))
    return t.projects.join(stats, ["project", "revision"], "left").select(F.col("project").alias("id"), F.coalesce("impacts", F.lit(0)).alias("impacts"))


@_add("J13_theta_anti")
def _(t: Star):
    """No newer project of the same title and discipline: the first in order, without a comparison of all pairs."""
    return P.latest(t.projects, ["title", "discipline"], [F.desc("balance"), F.desc("project")]).select(F.col("project").alias("id"), "discipline")


@_add("J14_case_key")
def _(t: Star):
    asked = t.clauses.withColumn("rank", F.when(F.col("decision") == "F", 1).when(F.col("decision") == "O", 2).otherwise(3))
    found = t.candidates.select("clause", "rank", F.col("rank").alias("shown"), F.col("section").alias("section_id"))
    return asked.join(found, ["clause", "rank"], "left").select(F.col("clause").alias("id"), F.col("shown").alias("rank"), "section_id")


@_add("J15_chain_left")
def _(t: Star):
    active = t.projects.where("state = 'active'")
    nations = t.table("nation")
    chain = t.table("region").join(nations, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(active, F.col("discipline") == F.col("n_nationkey"), "left")
    return chain.groupBy("r_name", "n_name").agg(F.count("project").alias("projects"))


@_add("J17_prefix_join")
def _(t: Star):
    first = lambda c: F.lower(F.substring(c, 1, 1))
    nations, parts = t.table("nation").withColumn("prefix", first("n_name")), t.table("part").select(first("p_name").alias("prefix"), "p_size")
    return nations.join(parts, "prefix").where(F.col("p_size") < F.col("n_nationkey") + 10).groupBy("n_name").agg(F.count(F.lit(1)).alias("parts"))


@_add("J18_group_overlap")
def _(t: Star):
    """With how many other clauses a clause shares each of its groups; pairs are counted, not made."""
    return P.partners(t.candidates, "section", "clause").select(F.col("clause").alias("clause_id"), F.col("section").alias("section_id"), "partners")


@_add("J19_two_overlaps")
def _(t: Star):
    return P.sharing_pairs(t.candidates.select("clause", "section", "code"), "clause", ["section", "code"])


@_add("J20_positional")
def _(t: Star):
    verdict = F.when(F.col("relation") == "A", "related").when(F.col("relation") == "N", "partial").otherwise("unrelated")
    verdicts = t.candidates.select("clause", (F.col("rank") - 1).alias("rank"), verdict.alias("verdict"))
    return t.candidates.select("clause", "rank").join(verdicts, ["clause", "rank"], "left").select(F.col("clause").alias("clause_id"), "rank", F.coalesce("verdict", F.lit("uncertain")).alias("verdict"))


@_add("J21_multiset_diff")
def _(t: Star):
    rows = t.candidates.select(F.col("clause").alias("clause_id"), F.col("relation").alias("fp"), "rank")
    diff = P.multiset_diff(rows.where("rank <= 3"), rows.where("rank >= 2 AND rank <= 4"), ["clause_id"], "fp", "rank")
    return diff.select("clause_id", "fp", "n", F.when(F.col("change") == "moved", "kept").otherwise(F.col("change")).alias("change"))


@_add("J22_nearest_previous")
def _(t: Star):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.turns.select("conv_id", "turn", P.last_where(F.col("turn"), F.col("role") == "user", w).alias("previous_user"))


@_add("J23_seen_earlier")
def _(t: Star):
    w = Window.partitionBy("clause").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    rows = t.candidates.select(F.col("clause").alias("clause_id"), "rank", F.size(F.collect_set("code").over(w)).cast("long").alias("earlier_codes"))
    return rows.distinct()


@_add("J24_anti_existing")
def _(t: Star):
    existing = t.candidates.where("relation = 'N'").select("clause", "code")
    return t.candidates.where("relation = 'A'").join(existing, ["clause", "code"], "left_anti").select(F.col("clause").alias("clause_id"), "rank")


@_add("J25_orphans")
def _(t: Star):
    count = lambda rows, kind: rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")).select("kind", "n")
    active = t.projects.where("state = 'active'")
    return count(P.orphans(t.clauses, active, "project", "project"), "clause").unionByName(count(P.orphans(t.candidates, t.clauses, "clause", "clause"), "candidate"))


# aggregates


@_add("A01_conditional_counts")
def _(t: Star):
    kinds = {"keep": "F", "hold": "O", "removed": "P"}
    return t.clauses.groupBy(F.col("project").alias("project_id")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("decision") == v).alias(k) for k, v in kinds.items()])


@_add("A02_count_after_left")
def _(t: Star):
    return t.projects.join(t.clauses.where("decision = 'P'"), "project", "left").groupBy(F.col("project").alias("id")).agg(F.count(F.lit(1)).alias("row_count"), F.count("clause").alias("clauses"))


@_add("A03_best_and_count")
def _(t: Star):
    return t.candidates.groupBy(F.col("clause").alias("clause_id")).agg(F.max("score").alias("best"), F.count("rank").alias("n"))


@_add("A04_count_distinct")
def _(t: Star):
    return t.candidates.groupBy("code").agg(F.count_distinct("clause").alias("clauses"), F.count_distinct(F.when(F.col("relation") == "R", F.col("section"))).alias("rejected"))


@_add("A05_scalar_counts")
def _(t: Star):
    large = t.clauses.where("price > 200000").groupBy("project").agg(F.count(F.lit(1)).alias("large"))
    return t.projects.join(large, "project", "left").select(F.col("project").alias("id"), F.coalesce("large", F.lit(0)).alias("large"))


@_add("A06_next_revision")
def _(t: Star):
    last = t.clauses.groupBy("project").agg(F.max(F.col("clause") % 7).alias("last"))
    return t.projects.join(last, "project", "left").select(F.col("project").alias("id"), (F.coalesce("last", F.lit(0)) + 1).alias("next_revision"))


@_add("A09_job_rollup")
def _(t: Star):
    failed, kinds = F.count_if(F.col("status") == "error"), F.count_distinct("status")
    state = F.when(failed > 0, "failed").when(kinds == 1, "uniform").otherwise("mixed")
    first = F.min_by("status", F.when(F.col("status") != "click", F.col("seq")))
    return t.events.groupBy(F.col("entity").alias("user_id")).agg(F.count(F.lit(1)).alias("items"), failed.alias("failed"), state.alias("state"), F.round(F.avg("value"), 8).alias("progress"), F.min(F.when(F.col("status") != "click", F.col("seq"))).alias("first_other"), first.alias("first_status"))


@_add("A10_ir_metrics")
def _(t: Star):
    first = t.candidates.where("rank <= 3 AND relation = 'A'").groupBy("clause").agg(F.min("rank").alias("hit"))
    found, n = F.count("hit"), F.count(F.lit(1))
    mrr = F.round(F.sum(F.coalesce(1.0 / F.col("hit"), F.lit(0.0))) / F.nullif(n, F.lit(0)), 4)
    return t.clauses.join(first, "clause", "left").agg(n.alias("evaluated"), F.count_if(F.col("hit") == 1).alias("rank1"), found.alias("found"), _rate(found, n).alias("recall3"), mrr.alias("mrr"))


@_add("A11_group_breakdown")
def _(t: Star):
    domain = t.spark.createDataFrame([(x,) for x in "FOPX"], "decision string")
    counts = t.clauses.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("price") > 100000).alias("large"))
    return F.broadcast(domain).join(counts, "decision", "left").na.fill(0, ["n", "large"])


@_add("A12_error_signals")
def _(t: Star):
    rejected, weak = F.col("relation") == "R", F.col("score") < 0.1
    return t.candidates.agg(F.count_if(rejected).alias("rejected"), F.count_if(weak).alias("weak"), _rate(F.count_if(rejected | weak), F.count(F.lit(1))).alias("rate"))


@_add("A13_coverage_progress")
def _(t: Star):
    return t.clauses.groupBy(F.col("project").alias("project_id")).agg(F.count_if(F.col("clause") % 3 == 1).alias("current_version"), F.count(F.lit(1)).alias("total"))


@_add("A14_status_lattice")
def _(t: Star):
    status = F.when(F.col("relation") == "A", "covered").when(F.col("relation") == "N", "uncertain").otherwise("missing")
    seg = t.candidates.withColumn("status", status)
    some = lambda c: F.bool_or(c)
    merged = F.when(some((F.col("status") == "missing") & (F.col("confidence") > 0.08)), "conflict").when(some(F.col("status") == "uncertain"), "uncertain").when(F.bool_and(F.col("status") == "covered"), "fully_covered").when(some(F.col("status") == "covered"), "partially_covered").otherwise("not_covered")
    return seg.groupBy(F.col("clause").alias("clause_id")).agg(merged.alias("status"), F.min("confidence").alias("confidence"))


@_add("A15_batch_status")
def _(t: Star):
    covered = F.col("relation") == "A"
    return t.candidates.groupBy("code").agg(F.when(F.bool_and(covered), "full").when(F.bool_or(covered), "partial").otherwise("none").alias("status"))


@_add("A16_ordered_concat")
def _(t: Star):
    return t.candidates.groupBy(F.col("clause").alias("clause_id")).agg(P.ordered_concat(["rank", "relation"], "relation", "").alias("relations"))


@_add("A17_revision_hash")
def _(t: Star):
    line = F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    return P.rolled_digest(t.table("nation").select(line.alias("row")), "row", ["row"]).withColumnRenamed("digest", "revision")


@_add("A18_raw_integrity")
def _(t: Star):
    key = F.col("page_id").cast("string")
    return P.rolled_digest(t.table("pages").select(key.alias("key"), F.concat(key, F.lit(":"), F.sha2("html", 256)).alias("row")), "key", ["row"])


@_add("A19_impact_counts")
def _(t: Star):
    matched, material = F.col("decision") == "F", F.col("price") > 150000
    return t.clauses.agg(F.count(F.lit(1)).alias("impacts"), F.count_if(matched).alias("matched"), F.count_if(material).alias("material"), F.count_if(matched & material).alias("review_required"))


@_add("A20_retention")
def _(t: Star):
    expected = F.max("section").over(Window.partitionBy("clause"))
    near = t.candidates.withColumn("expected", expected).where("rank <= 3")
    per = near.groupBy("clause").agg((F.min(F.when(F.col("rank") == 1, F.col("section"))) == F.first("expected")).alias("first"), F.bool_or(F.col("section") == F.col("expected")).alias("within"))
    return per.agg(F.count(F.lit(1)).alias("cases"), F.count_if("first").alias("top1"), F.count_if("within").alias("top3"))


@_add("A21_counter")
def _(t: Star):
    return t.candidates.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


# windows


@_add("W01_latest_of_title")
def _(t: Star):
    rows = P.placed(t.projects, ["title"], -F.col("balance"), [F.desc("project")], "n", within=True)
    return rows.select(F.col("project").alias("id"), "title", "n")


@_add("W02_count_of_title")
def _(t: Star):
    """The count of a title is aggregated and joined back, so that no task holds all projects of one."""
    same = t.projects.groupBy("title", "discipline").agg(F.count(F.lit(1)).alias("same"))
    return t.projects.join(same, ["title", "discipline"]).select(F.col("project").alias("id"), "same")


@_add("W03_latest_submission")
def _(t: Star):
    return P.latest(t.clauses, ["project"], [F.desc("price"), F.desc("clause")]).select(F.col("project").alias("project_id"), F.col("clause").alias("id"))


@_add("W04_latest_rematch")
def _(t: Star):
    return P.latest(t.clauses, ["project"], [F.desc("reviewed_at"), F.desc("clause")]).select(F.col("project").alias("project_id"), F.col("clause").alias("id"))


@_add("W05_lag_lead_context")
def _(t: Star):
    rows = P.neighbours(t.turns, ["conv_id"], "turn", ["role", "text", "turn"])
    return rows.select("conv_id", "turn", F.col("prev_role").alias("previous_role"), F.col("prev_text").alias("previous_text"), "next_role", "next_turn")


@_add("W06_top3_visible")
def _(t: Star):
    shown = F.row_number().over(Window.partitionBy("clause").orderBy("rank"))
    visible = t.candidates.where(~((F.col("relation") == "R") & (F.col("confidence") >= 0.05)))
    return visible.withColumn("shown", shown).where("shown <= 3").select(F.col("clause").alias("clause_id"), "rank", "shown")


@_add("W07_rerank")
def _(t: Star):
    rank = F.row_number().over(Window.partitionBy("clause").orderBy("rank"))
    return t.candidates.where("relation <> 'R'").select(F.col("clause").alias("clause_id"), F.col("rank").alias("old_rank"), rank.alias("rank"))


@_add("W08_last_substantive")
def _(t: Star):
    substantive = F.length("text") > 200
    of = lambda *keys: P.last_where(F.col("turn"), substantive, Window.partitionBy(*keys).orderBy("turn"))
    return t.turns.select("conv_id", "turn", of("conv_id").alias("substantive"), of("conv_id", "role").alias("same_role"))


@_add("W10_first_of_key")
def _(t: Star):
    return t.candidates.groupBy("code").agg(F.min(F.struct("clause", "rank")).alias("first")).select("code", F.col("first.clause").alias("clause_id"), "first.rank")


@_add("W11_relative_to_best")
def _(t: Star):
    return t.candidates.select(F.col("clause").alias("clause_id"), "rank", F.round(F.col("score") / F.max("score").over(Window.partitionBy("clause")), 6).alias("relative"))


@_add("W13_occurrence")
def _(t: Star):
    return t.candidates.select(F.col("clause").alias("clause_id"), "rank", F.row_number().over(Window.partitionBy("clause", "relation").orderBy("rank")).alias("occurrence"))


# order, pages, samples


@_add("L01_keyset_page")
def _(t: Star):
    """The page behind a cursor that went out to a client and came back; its filters are those that it was made for."""
    filters = {"state": "", "title": ""}
    after = P.decode_cursor(P.encode_cursor((5000.0, 100), filters), filters)
    return P.keyset_page(t.projects.select(F.col("project").alias("id"), "balance"), "balance", "id", 50, after)


@_add("L02_offset_page")
def _(t: Star):
    return t.clauses.orderBy(F.desc("price"), "clause").offset(100).limit(50).select(F.col("clause").alias("id"), "price")


@_add("L03_tie_broken_order")
def _(t: Star):
    """Places in the whole order: the place within a discipline and title behind the rows of those before it."""
    rows = t.projects.where("state = 'archived'")
    return P.placed(rows, ["discipline", "title"], F.col("project"), [], "place").select(F.col("project").alias("id"), "place")


@_add("L04_pools")
def _(t: Star):
    n = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("score"), "clause", "rank"))
    return t.candidates.withColumn("n", n).where("n <= 40").select("code", F.col("clause").alias("clause_id"), "rank")


@_add("L08_explicit_quota")
def _(t: Star):
    explicit = F.col("section") % 13 == 0
    first = F.row_number().over(Window.partitionBy("clause", "code", explicit).orderBy("rank"))
    level = F.when(explicit & (first == 1), 0).when(F.col("relation") == "A", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("clause").orderBy("level", "rank"))
    return t.candidates.withColumn("level", level).withColumn("place", place).where("place <= 3").select(F.col("clause").alias("clause_id"), "rank", "place")


@_add("L09_dedupe_first")
def _(t: Star):
    return t.candidates.groupBy("clause", "code", "relation").agg(F.min("rank").alias("rank")).select(F.col("clause").alias("clause_id"), "rank")


@_add("L10_retention")
def _(t: Star):
    n = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("reviewed_at"), F.desc("clause")))
    return t.clauses.withColumn("n", n).where("n > 10").select(F.col("clause").alias("id"))


# sets


@_add("U02_union_with_source")
def _(t: Star):
    part = lambda rows, source: rows.select(F.col("clause").alias("clause_id"), "rank", F.lit(source).alias("source"))
    return part(t.candidates.where("relation = 'A'"), "scoped").unionByName(part(t.candidates.where("score > 0.9"), "global"))


@_add("U03_intersection")
def _(t: Star):
    has = lambda r: t.candidates.where(F.col("relation") == r).select(F.col("clause").alias("clause_id"))
    return has("A").intersect(has("R"))


@_add("U04_added_removed")
def _(t: Star):
    """Both differences in one grouping: a key is added if only the later side holds it, removed if only the earlier one does."""
    held = t.candidates.groupBy("clause", "code").agg(F.bool_or(F.col("rank") >= 2).alias("after"), F.bool_or(F.col("rank") <= 3).alias("before"))
    counts = held.agg(F.count_if(F.col("after") & ~F.col("before")).alias("added"), F.count_if(F.col("before") & ~F.col("after")).alias("removed"))
    return counts.select(F.stack(F.lit(2), F.lit("added"), "added", F.lit("removed"), "removed").alias("change", "n"))


@_add("U06_exact_cover")
def _(t: Star):
    n = F.count(F.lit(1))
    return t.candidates.groupBy(F.col("clause").alias("clause_id")).agg(((n == F.count_distinct("rank")) & (F.min("rank") == 1) & (F.max("rank") == n)).alias("exact"))
