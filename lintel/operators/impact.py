"""What a new revision of the corpus means for reviewed clauses: candidate ids that live on, reasons, and what must be reviewed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import identity as D
from lintel.functions import text as X

# Reasons, in the order in which they are listed, and the namespace and prefix of new ids.
REASONS = ["candidate_meaning_changed", "candidate_added", "candidate_removed", "candidate_metadata_changed", "selected_candidate_removed"]
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
NEW_ID = "kcs-candidate"
#: Rows of a task that ranks and matches them, about, whatever the size of the tables.
TASK_ROWS = 500_000


def with_fingerprints(rows: DataFrame) -> DataFrame:
    """Adds fp (what a candidate says), lk (its code and clause number) and meta (the rest that is shown) to rows with code, number,
    title, content, warnings, rank, score, classification, reasons, version, updated, name."""
    # all texts are folded as one and taken apart again; only rows with other characters than ASCII go to Python for their normal form
    texts = ["code", "number", "title", "content", "classification", "version", "updated", "name"]
    lists = [F.array_join(F.coalesce(c, F.array().cast("array<string>")), "\u001e") for c in ("warnings", "reasons")]
    whole = F.concat_ws("\u001f", *[X.text(c) for c in texts], *lists)
    rows = rows.withColumn("_f", whole)
    plain = F.octet_length("_f") == F.char_length("_f")
    rows = rows.where(plain).unionByName(rows.where(~plain).withColumn("_f", X.compatibility_form(F.col("_f"))))
    # white space is folded once in the whole, of which the separators are no part, so a field is only trimmed
    rows = rows.withColumn("_f", F.split(F.regexp_replace(F.lower("_f"), X.U + r"\s+", " "), "\u001f"))
    flat = {name: F.trim(F.get("_f", i)) for i, name in enumerate([*texts, "warnings", "reasons"])}
    each = lambda name: F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.get("_f", (len(texts) + ["warnings", "reasons"].index(name))), "\u001e"), F.trim), lambda x: x != "")))
    code = F.regexp_replace(flat["code"], r"[^\p{L}\p{N}]", "")
    fp = D.fingerprint({"kcs_code": code, "kcs_clause": flat["number"], "title": flat["title"], "content": flat["content"], "warnings": each("warnings")})
    logical = F.concat_ws("\u001f", code, flat["number"])
    meta = F.struct("rank", "score", flat["classification"].alias("classification"), each("reasons").alias("reasons"), flat["version"].alias("version"), flat["updated"].alias("updated"), flat["name"].alias("name"))
    return rows.withColumn("fp", fp).withColumn("lk", logical).withColumn("meta", meta).drop("_f")


def _met(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of both sides (new: whether after) with occurrence and, for those after, old: id and meta of the row before that lives on in them.

    Both sides are dealt by clause in one shuffle; ranks, matches and whatever is summed up for a clause then happen where it lies."""

    def side(rows: DataFrame, new: bool) -> DataFrame:
        known = rows if "fp" in rows.columns else with_fingerprints(rows)
        identity = F.lit(None).cast(before.schema["id"].dataType) if new else F.col("id")
        return known.select("clause", "pos", identity.alias("id"), F.unhex("fp").alias("fp"), "lk", "meta", F.lit(new).alias("new"))

    tasks = max(int(before.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(before.count() + after.count()) // TASK_ROWS))
    rows = side(before, False).unionByName(side(after, True)).repartition(tasks, "clause")
    rows = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy("clause", "fp", "new").orderBy("pos")))
    # of an occurrence there is one row at most on each side, the one before first
    match = Window.partitionBy("clause", "fp", "occurrence").orderBy("new")
    return rows.withColumn("old", F.when(F.col("new") & F.col("clause").isNotNull(), F.lag(F.struct("id", "meta")).over(match)))


def _assigned() -> tuple[Column, Column]:
    """reused and metadata_changed of rows that have met."""
    reused = F.col("old.id").isNotNull()
    return reused, reused & ~F.col("meta").eqNullSafe(F.col("old.meta"))


def assignments(before: DataFrame, after: DataFrame) -> DataFrame:
    """clause, pos, occurrence, fp, preserved_id, assigned_id, reused, metadata_changed of each candidate after.

    before: clause, pos, id and what with_fingerprints needs, or what it gives; after likewise without id. Equal fingerprints are matched in order; what
    has no match gets an id made of its clause, fingerprint and occurrence, so that a repeated run gives the same."""
    reused, changed = _assigned()
    rows = _met(before, after).where("new").withColumn("fp", F.lower(F.hex("fp")))
    name = F.concat_ws(":", F.lit(NEW_ID), F.col("clause").cast("string"), "fp", F.col("occurrence").cast("string"))
    assigned = F.coalesce(F.col("old.id"), D.uuid5(URL_NAMESPACE, name))
    return rows.select("clause", "pos", "occurrence", "fp", F.col("old.id").alias("preserved_id"), assigned.alias("assigned_id"), reused.alias("reused"), changed.alias("metadata_changed"))


def plan(before: DataFrame, after: DataFrame, clauses: DataFrame) -> DataFrame:
    """One row of each clause: material_changed, metadata_changed, review_required, selected (mapped), selection_removed, reasons.

    clauses: clause, decision, selected (an id before). Sets of fingerprints are compared whole and, for code and number that both
    sides have, one by one. A row is fingerprinted once and moves once; what a clause comes to is summed up where its rows lie."""
    reused, changed = _assigned()
    rows = _met(before, after).select("clause", "lk", "fp", "new", F.when(reused, F.col("old.id")).alias("kept"), changed.alias("changed"))
    per_fp = rows.groupBy("clause", "lk", "fp").agg(
        F.bool_or(~F.col("new")).alias("b"), F.bool_or("new").alias("a"), F.bool_or("changed").alias("changed"), F.collect_list("kept").alias("kept"),
    )
    per_key = per_fp.groupBy("clause", "lk").agg(
        (F.bool_or("b") & F.bool_or("a") & F.bool_or(F.col("b") != F.col("a"))).alias("meaning"), F.bool_or(F.col("a") & ~F.col("b")).alias("added"),
        F.bool_or(F.col("b") & ~F.col("a")).alias("removed"), F.bool_or("changed").alias("metadata_changed"), F.flatten(F.collect_list("kept")).alias("kept"),
    )
    flags = ("meaning", "added", "removed", "metadata_changed")
    sets = per_key.groupBy("clause").agg(*[F.bool_or(c).alias(c) for c in flags], F.flatten(F.collect_list("kept")).alias("kept"))
    found = clauses.join(sets, "clause", "left").withColumn("mapped", F.when(F.array_contains("kept", F.col("selected")), F.col("selected")))
    no = F.lit(False)
    given = {c: F.coalesce(F.col(c), no) for c in flags}
    material, gone = given["added"] | given["removed"], F.col("selected").isNotNull() & F.col("mapped").isNull()
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in zip(REASONS, [*given.values(), gone], strict=True)]))
    return found.select("clause", "decision", material.alias("material_changed"), given["metadata_changed"].alias("metadata_changed"), (F.col("decision").isNotNull() & material).alias("review_required"), F.col("mapped").alias("selected"), gone.alias("selection_removed"), reasons.alias("reasons"))


def applied(impacts: DataFrame, coverage: DataFrame) -> DataFrame:
    """clause, decision, selected, coverage_valid after a plan: coverage (clause, confirmed) of what has changed materially counts no more."""
    rows = impacts.join(coverage, "clause", "left")
    return rows.select("clause", "decision", "selected", (F.coalesce("confirmed", F.lit(False)) & ~F.col("material_changed")).alias("coverage_valid"), "review_required")


def unacknowledged(impacts: DataFrame, project: Column) -> DataFrame:
    """How many impacts of a project still ask for a review."""
    return impacts.where("review_required AND acknowledged_at IS NULL").groupBy(project.alias("project")).agg(F.count(F.lit(1)).alias("impacts"))


RUN_ID = "spec-kcs-rematch"


def published(runs: DataFrame, projects: DataFrame, snapshot: str, revision: str, parser: str) -> DataFrame:
    """The runs after a revision was published: project, target, snapshot, status, requeued, id.

    runs: project, target, snapshot, status, id, one for each project and target. projects: project, revision, snapshot, archived, parser.
    Waiting and running work for other revisions is superseded, and so is running work on another snapshot of this one; waiting work takes
    the new snapshot and queues again. Each project that lags behind, is not archived and was read by the current parser gets a run of its
    own, unless it has one for this revision in whatever state."""
    other, here = F.col("target") != revision, F.col("snapshot") != snapshot
    active = F.col("status").isin("pending", "running")
    moved = ~other & here & active
    kept = runs.select(
        "project", "target", F.when(moved, snapshot).otherwise(F.col("snapshot")).alias("snapshot"),
        F.when((active & other) | (moved & (F.col("status") == "running")), "superseded").otherwise(F.col("status")).alias("status"), (moved & (F.col("status") == "pending")).alias("requeued"), "id",
    )
    # a project of this very snapshot that knows no revision is at the one published
    known = F.when((F.coalesce("revision", F.lit("")) == "") & (F.col("snapshot") == snapshot), revision).otherwise(F.coalesce("revision", F.lit("")))
    stale = projects.where(~F.col("archived") & (known != revision) & (F.col("parser") == parser)).select("project")
    new = stale.join(runs.where(~other).select("project"), "project", "left_anti")
    name = F.concat_ws(":", F.lit(RUN_ID), F.col("project").cast("string"), F.lit(revision))
    queued = new.select("project", F.lit(revision).alias("target"), F.lit(snapshot).alias("snapshot"), F.lit("pending").alias("status"), F.lit(True).alias("requeued"), D.uuid5(URL_NAMESPACE, name).alias("id"))
    return kept.unionByName(queued)
