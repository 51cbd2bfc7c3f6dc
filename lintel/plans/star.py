"""The star schema in its roles, and the SQL that the relational and governance queries must agree with.

A customer is a project, its segment the title, its nation the discipline; an order is a clause with a decision (its status) and an
order date; a line is a candidate whose line number is its rank and whose quantity stands for its score; an event is an audit or queue
entry: its user the entity, its id the sequence, its type the new status. The queries themselves are DataFrames built from the
library's operators; DuckDB runs this SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.operators import coverage as V
from lintel.operators.coverage import DECISION_REASONS
from lintel.plans.registry import QUERIES, query, table

PROJECTS = "projects AS (SELECT c_custkey AS id, c_name AS filename, c_mktsegment AS title, c_nationkey AS discipline, c_acctbal AS balance, CASE WHEN c_custkey % 5 = 0 THEN 'archived' ELSE 'active' END AS state, c_custkey % 3 AS revision FROM customer)"
CLAUSES = "clauses AS (SELECT o_orderkey AS id, o_custkey AS project_id, o_orderstatus AS decision, o_totalprice AS price, o_orderdate AS reviewed_at, o_orderpriority AS reason FROM orders)"
CANDIDATES = "candidates AS (SELECT l_orderkey AS clause_id, l_linenumber AS rank, l_partkey AS section_id, l_quantity / 50.0 AS score, l_returnflag AS relation, l_discount AS confidence, l_suppkey AS code FROM lineitem)"
W3 = f"WITH {PROJECTS}, {CLAUSES}, {CANDIDATES}"
EVENTS = "ev AS (SELECT user_id AS entity, event_id AS seq, event_type AS status, value, ts FROM events)"
LINES = "lines AS (SELECT l_orderkey AS clause_id, l_suppkey AS code, l_partkey AS section_id, l_returnflag AS relation, l_quantity / 50.0 AS score, l_discount AS confidence, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS pos FROM lineitem)"

ALL_REASONS = [r for rs in DECISION_REASONS.values() for r in rs] + ["other"]
STATUSES = ["reviewing", "submitted", "changes_requested", "approved"]
# clauses under review, their candidates, and what was judged of their segments, derived from keys so that every rule meets every case
REVIEW = f"""{LINES},
rc AS (SELECT o_orderkey AS clause, o_custkey AS project, CASE o_orderkey % 10 WHEN 0 THEN 'heading' WHEN 1 THEN 'table' ELSE 'paragraph' END AS source_type, CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'hold' END WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'keep' ELSE 'delete' END AS decision,
 {ALL_REASONS!r}[CAST(o_orderkey % {len(ALL_REASONS)} AS INT) + 1] AS reason, o_orderpriority AS content, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN o_orderpriority ELSE o_orderpriority || ' x' END AS edited, nullif(o_orderkey % 4, 0) AS selected, o_orderkey % 3 <> 0 AS confirmed FROM orders),
rk AS (SELECT clause_id AS clause, pos AS candidate, CASE WHEN section_id % 5 = 0 THEN 1 ELSE 0 END AS warnings, CASE code % 4 WHEN 0 THEN 'equivalent' WHEN 1 THEN 'kcs_covers' WHEN 2 THEN 'unrelated' END AS relation, 1 - 2 * confidence AS confidence FROM lines),
js AS (SELECT clause_id AS clause, (pos + 1) // 2 AS segment, pos % 2 AS call, CASE relation WHEN 'A' THEN 'covered' WHEN 'N' THEN 'not_covered' ELSE CASE WHEN confidence > 0.08 THEN 'conflict' ELSE 'uncertain' END END AS status, pos, 1 - confidence AS confidence FROM lines),
forced AS (SELECT DISTINCT clause_id AS clause, (pos + 1) // 2 AS segment FROM lines WHERE section_id % 7 = 0),
seg0 AS (SELECT clause, segment, CASE WHEN bool_or(status = 'conflict') THEN 'conflict' WHEN bool_or(status = 'uncertain') OR (bool_or(status = 'covered') AND bool_or(status = 'not_covered')) THEN 'uncertain' WHEN bool_or(status = 'covered') THEN 'covered' ELSE 'not_covered' END AS base, min(confidence) AS confidence FROM js GROUP BY clause, segment),
seg AS (SELECT s.clause, s.segment, CASE WHEN s.base = 'covered' AND f.clause IS NOT NULL THEN 'uncertain' ELSE s.base END AS status, s.confidence, coalesce((SELECT list(j.pos ORDER BY j.call, j.pos) FROM js j WHERE j.clause = s.clause AND j.segment = s.segment AND j.status = 'covered' AND s.base IN ('covered', 'uncertain')), []) AS evidence FROM seg0 s LEFT JOIN forced f ON f.clause = s.clause AND f.segment = s.segment),
cov0 AS (SELECT clause, CASE WHEN bool_or(status = 'conflict') THEN 'conflict' WHEN bool_or(status = 'uncertain') THEN 'uncertain' WHEN bool_and(status = 'covered') THEN 'fully_covered' WHEN bool_and(status = 'not_covered') AND max(len(evidence)) = 0 THEN 'own_specific' ELSE 'partially_covered' END AS coverage, min(confidence) AS confidence, list_sort(flatten(list(evidence))) AS evidence, count(CASE WHEN status = 'covered' THEN 1 END) AS covered, count(*) AS segments FROM seg GROUP BY clause),
cov AS (SELECT c.*, coverage = 'fully_covered' AND confidence >= 0.85 AND len(evidence) > 0 AND NOT EXISTS (SELECT 1 FROM rk WHERE rk.clause = c.clause AND list_contains(c.evidence, rk.candidate) AND (rk.warnings > 0 OR (rk.relation IS NOT NULL AND (rk.relation NOT IN ('equivalent', 'kcs_covers') OR rk.confidence < 0.85)))) AS deletion_safe FROM cov0 c),
unsafe AS (SELECT c.clause FROM rc c LEFT JOIN rk k ON k.clause = c.clause AND k.candidate = c.selected LEFT JOIN cov v ON v.clause = c.clause WHERE c.source_type <> 'heading' AND c.decision = 'delete' AND c.reason = 'fully_covered_by_kcs' AND (c.selected IS NULL OR NOT c.confirmed OR k.clause IS NULL OR k.warnings > 0 OR (k.relation IS NOT NULL AND (k.relation NOT IN ('equivalent', 'kcs_covers') OR k.confidence < 0.85)) OR (v.clause IS NOT NULL AND (NOT v.deletion_safe OR NOT list_contains(v.evidence, c.selected) OR EXISTS (SELECT 1 FROM rk e WHERE e.clause = c.clause AND list_contains(v.evidence, e.candidate) AND e.relation IS NOT NULL AND (e.relation NOT IN ('equivalent', 'kcs_covers') OR e.confidence < 0.85)))))),
rp AS (SELECT c_custkey AS project, {STATUSES!r}[CAST(c_custkey % 4 AS INT) + 1] AS status, CASE WHEN c_custkey % 3 = 0 THEN 'r1' ELSE 'r2' END AS revision, CASE WHEN c_custkey % 11 = 0 THEN 'v1' ELSE 'v2' END AS parser_version, CASE c_custkey % 13 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' END AS rematch, c_custkey % 8 <> 0 AS approved FROM customer)"""


class Star:
    """The tables of one folder, opened when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def projects(self) -> DataFrame:
        state = F.when(F.col("c_custkey") % 5 == 0, "archived").otherwise("active")
        return self.table("customer").select(F.col("c_custkey").alias("project"), F.col("c_name").alias("filename"), F.col("c_mktsegment").alias("title"), F.col("c_nationkey").alias("discipline"), F.col("c_acctbal").alias("balance"), state.alias("state"), (F.col("c_custkey") % 3).alias("revision"))

    @cached_property
    def clauses(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("clause"), F.col("o_custkey").alias("project"), F.col("o_orderstatus").alias("decision"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("reviewed_at"), F.col("o_orderpriority").alias("reason"))

    @cached_property
    def candidates(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("clause"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("section"), (F.col("l_quantity") / 50.0).alias("score"), F.col("l_returnflag").alias("relation"), F.col("l_discount").alias("confidence"), F.col("l_suppkey").alias("code"))

    @cached_property
    def lines(self) -> DataFrame:
        """Candidates numbered in one order, as line numbers repeat."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        return self.table("lineitem").select(F.col("l_orderkey").alias("clause"), F.col("l_suppkey").alias("code"), F.col("l_partkey").alias("section"), F.col("l_returnflag").alias("relation"), (F.col("l_quantity") / 50.0).alias("score"), F.col("l_discount").alias("confidence"), F.row_number().over(w).alias("pos"))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), "value", "ts")

    @cached_property
    def turns(self) -> DataFrame:
        return self.table("conversations")

    @cached_property
    def review_clauses(self) -> DataFrame:
        key = F.col("o_orderkey")
        pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), n.cast("int") + 1)
        kind = F.when(key % 10 == 0, "heading").when(key % 10 == 1, "table").otherwise("paragraph")
        decision = F.when(F.col("o_orderstatus") == "O", F.when(key % 3 != 0, "hold")).when((F.col("o_orderstatus") == "F") & (key % 2 == 0), "keep").otherwise("delete")
        edited = F.when(key % 4 == 0, "").when(key % 4 == 1, F.col("o_orderpriority")).otherwise(F.concat("o_orderpriority", F.lit(" x")))
        return self.table("orders").select(key.alias("clause"), F.col("o_custkey").alias("project"), kind.alias("source_type"), decision.alias("decision"), pick(ALL_REASONS, key % len(ALL_REASONS)).alias("reason"), F.col("o_orderpriority").alias("content"), edited.alias("edited"), F.nullif(key % 4, F.lit(0)).alias("selected"), (key % 3 != 0).alias("confirmed"))

    @cached_property
    def review_candidates(self) -> DataFrame:
        relation = F.when(F.col("code") % 4 == 0, "equivalent").when(F.col("code") % 4 == 1, "kcs_covers").when(F.col("code") % 4 == 2, "unrelated")
        return self.lines.select("clause", F.col("pos").alias("candidate"), (F.col("section") % 5 == 0).cast("int").alias("warnings"), relation.alias("relation"), (1 - 2 * F.col("confidence")).alias("confidence"))

    @cached_property
    def segments(self) -> DataFrame:
        """Judged source segments, merged over the calls that judged them."""
        status = F.when(F.col("relation") == "A", "covered").when(F.col("relation") == "N", "not_covered").when(F.col("confidence") > 0.08, "conflict").otherwise("uncertain")
        rows = self.lines.withColumn("segment", F.floor((F.col("pos") + 1) / 2).cast("int"))
        judged = rows.select("clause", "segment", (F.col("pos") % 2).alias("call"), status.alias("status"), F.when(F.col("relation") == "A", F.array("pos")).otherwise(F.array().cast("array<int>")).alias("evidence"), (1 - F.col("confidence")).alias("confidence"))
        return V.merge_segments(judged, rows.where("section % 7 = 0").select("clause", "segment"))

    @cached_property
    def coverage(self) -> DataFrame:
        return V.deletion_safe(V.merge_clauses(self.segments), self.review_candidates)

    @cached_property
    def review_projects(self) -> DataFrame:
        key = F.col("c_custkey")
        status = F.element_at(F.array(*map(F.lit, STATUSES)), (key % 4).cast("int") + 1)
        return self.table("customer").select(key.alias("project"), status.alias("status"), F.when(key % 3 == 0, "r1").otherwise("r2").alias("revision"), F.when(key % 11 == 0, "v1").otherwise("v2").alias("parser_version"), F.when(key % 13 == 0, "pending").when(key % 13 == 1, "failed").alias("rematch"), (key % 8 != 0).alias("approved"))

    @cached_property
    def unsafe(self) -> DataFrame:
        return V.unsafe_deletes(self.review_clauses, self.review_candidates, self.coverage)


def star_query(name: str, sql: dict[str, str]):
    """Registers a function of a Star under a name whose SQL is given."""

    def add(f):
        query(name, sql.get(name))(lambda spark, sf_dir: f(Star(spark, sf_dir)))
        return f

    assert name not in QUERIES
    return add
