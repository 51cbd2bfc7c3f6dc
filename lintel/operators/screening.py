"""Verdicts of a reader (a person or a model) on pairs and fields: what is put to it, and what of its answers is believed.

The verdicts are tables that come in; nothing here asks anybody."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions import text as X
from lintel.sources.documents import greedy_batches

# Longest source and target of a pair, pairs and characters of a batch, relations, statuses, lengths of quotes, and wording.
LONGEST_SOURCE, LONGEST_TARGET, BATCH_PAIRS, BATCH_CHARS = 4_000, 6_000, 8, 24_000
RELATIONS, STATUSES = ["related", "partial", "unrelated", "uncertain"], ["corresponds", "differs", "unconfirmed"]
ANALYSIS_RELATIONS = ["equivalent", "kcs_covers", "partial_overlap", "own_specific", "conflict", "unrelated"]
QUOTE_LENGTHS = (5, 100)
CONDITION_TOKENS = r"\d+(?:\.\d+)?(?:kgf?/㎠|kgf?/cm[²2]|MPa|일|회|매|개|%|급|종)"
DOUBTFUL = r"일치하지|다르|본문에\s*없|규정하지\s*않|확인되지|직접.*(?:아니|않)|추가\s*조건"
DITTO = r'상\s*동|^["〃]+$'


def batch_numbers(pairs: DataFrame) -> DataFrame:
    """source_id, idx, batch (from 0 in each source) of pairs (source_id, idx, source, target) that fit: of one source, eight at most, below
    24,000 characters together unless a pair is alone. Of texts only the lengths are grouped."""
    sizes = pairs.select("source_id", "idx", F.length("source").cast("long").alias("a"), F.length("target").cast("long").alias("b"))
    # not a filter: it would measure the texts once more, and lengths that are used twice are kept as columns, so that no text is sorted
    fits = F.when((F.col("a") <= LONGEST_SOURCE) & (F.col("b") <= LONGEST_TARGET), F.struct("idx", (F.col("a") + F.col("b")).alias("size")))
    rows = sizes.groupBy("source_id").agg(F.array_sort(F.collect_list(fits)).alias("rows"))
    numbered = F.arrays_zip(F.transform("rows", lambda r: r["idx"]).alias("idx"), greedy_batches(F.transform("rows", lambda r: r["size"]), BATCH_PAIRS, BATCH_CHARS - 1).alias("batch"))
    return rows.select("source_id", F.explode(numbered).alias("x")).select("source_id", "x.idx", "x.batch")


def batches(pairs: DataFrame) -> DataFrame:
    """pairs (source_id, idx, source, target) that fit, with their batch. Longer texts are not cut to be put to anybody; they stay uncertain."""
    return pairs.join(batch_numbers(pairs), ["source_id", "idx"])


def screened(pairs: DataFrame, asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """source_id, idx, relation of every pair. verdicts: source_id, batch, idx, relation, source_quote, target_quote.

    A batch whose answers miss or repeat a pair, or know another relation, is not believed. A pair is related, or partly so, only if
    both quotes stand in the bodies of its texts; what was not asked or not believed is uncertain."""
    got = verdicts.groupBy("source_id", "batch").agg(F.sort_array(F.collect_list("idx")).alias("got"), F.bool_and(F.col("relation").isin(RELATIONS)).alias("known"))
    whole = asked.groupBy("source_id", "batch").agg(F.sort_array(F.collect_list("idx")).alias("want")).join(got, ["source_id", "batch"]).where((F.col("got") == F.col("want")) & F.col("known")).select("source_id", "batch")
    answers = verdicts.join(whole, ["source_id", "batch"], "left_semi").select("source_id", "idx", "relation", "source_quote", "target_quote")
    rows = pairs.join(answers, ["source_id", "idx"], "left")
    proven = X.evidence_present(F.col("source_quote"), X.verification_body(F.col("source"))) & X.evidence_present(F.col("target_quote"), X.verification_body(F.col("target")))
    relation = F.when(F.col("relation").isin("related", "partial") & ~proven, "uncertain").otherwise(F.coalesce("relation", F.lit("uncertain")))
    return rows.select("source_id", "idx", relation.alias("relation"))


def valid_analysis(relation: Column, confidence: Column, rationale: Column) -> Column:
    """Whether an analysis of a pair can be stored: one of six relations, a confidence within 0 and 1, and a reason."""
    return F.coalesce(relation.isin(ANALYSIS_RELATIONS) & confidence.between(0, 1) & (F.trim(rationale) != ""), F.lit(False))


def unproven(field: Column, source: Column, explanation: Column, quotes: Column) -> Column:
    """Whether a correspondence goes beyond its evidence: a number with its unit that no quote holds, or an explanation that doubts it."""
    flat = lambda c: F.regexp_replace(c, r"[\s,]", "")
    quoted = flat(F.array_join(quotes, " "))
    missing = F.exists(F.regexp_extract_all(flat(source), F.lit(CONDITION_TOKENS), F.lit(0)), lambda t: ~F.contains(quoted, t))
    return (field != "tests") & (missing | explanation.rlike(X.U + DOUBTFUL))


def checked_fields(fields: DataFrame, entries: DataFrame, sections: DataFrame) -> DataFrame:
    """row, field, status, quotes of each field of a table row. fields: row, field, source, ambiguous (its standards are); entries: row,
    field, status, explanation, evidence (array of struct section, quote); sections: section, text.

    Entries of a row count only if they are its fields, once each, with known statuses. Of the first two pieces of evidence those count
    whose quote, of 5 to 100 characters, stands in its section; without one nothing is confirmed. A correspondence that goes beyond its
    evidence, rests on ditto marks, or has ambiguous standards is not confirmed either."""
    want = fields.groupBy("row").agg(F.sort_array(F.collect_list("field")).alias("want"))
    got = entries.groupBy("row").agg(F.sort_array(F.collect_list("field")).alias("got"), F.bool_and(F.col("status").isin(STATUSES)).alias("known"))
    whole = want.join(got, "row").where((F.col("want") == F.col("got")) & F.col("known")).select("row")
    given = entries.join(whole, "row", "left_semi")
    pieces = given.select("row", "field", F.posexplode(F.slice("evidence", 1, 2)).alias("i", "e")).select("row", "field", "i", F.col("e.section").alias("section"), X.clean_space(F.col("e.quote")).alias("quote"))
    held = pieces.join(sections, "section").where(F.length("quote").between(*QUOTE_LENGTHS) & F.contains("text", F.col("quote")))
    quotes = held.groupBy("row", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "quote"))), lambda x: x["quote"]).alias("quotes"))
    rows = fields.join(given.select("row", "field", "status", "explanation"), ["row", "field"]).join(quotes, ["row", "field"], "left")
    doubt = F.col("quotes").isNull() | F.col("source").rlike(X.U + DITTO) | (F.col("status") == "corresponds") & (unproven(F.col("field"), F.col("source"), F.coalesce("explanation", F.lit("")), F.coalesce("quotes", F.array())) | F.col("ambiguous"))
    return rows.select("row", "field", F.when(doubt, "unconfirmed").otherwise(F.col("status")).alias("status"), F.coalesce("quotes", F.array().cast("array<string>")).alias("quotes"))


def cached(rows: DataFrame, cache: DataFrame, version: str, model: str, today: str) -> DataFrame:
    """rows (row, source_hash, body_hash) with state: fresh (shown as it is), stale (of another day: shown, marked), reusable (the texts
    compared are the same: fields are kept, nothing is asked again) or pending. cache: row, source_hash, version, body_hash, model, checked."""
    held = cache.select("row", F.col("source_hash").alias("s"), "version", F.col("body_hash").alias("b"), "model", "checked")
    same = (F.col("s") == F.col("source_hash")) & (F.col("version") == version)
    body = (F.col("b") == F.col("body_hash")) & (F.col("model") == model)
    state = F.when(same & (F.substring("checked", 1, 10) == today), "fresh").when(same & body, "reusable").when(same, "stale").otherwise("pending")
    return rows.join(held, "row", "left").select("row", state.alias("state"))


def suggestions(checked: DataFrame, fields: DataFrame, standards: DataFrame) -> DataFrame:
    """row, text: a proposal that names the standards in place of the test methods and keeps every other condition. It is made only if all
    standards of a row were read by machine, none is ambiguous and the tests correspond. standards: row, standard, status; fields: row,
    field, label, source, material, ambiguous."""
    read = standards.groupBy("row").agg(F.bool_and(F.col("status") == "machine_verified").alias("all"), F.array_join(F.array_sort(F.collect_list("standard")), ", ").alias("names")).where("all")
    tests = checked.where("field = 'tests' AND status = 'corresponds'").select("row")
    rest = fields.where("field <> 'tests'").groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", F.concat("label", F.lit(": "), "source", F.lit(".")).alias("t")))), lambda x: x["t"]), " ").alias("rest"))
    own = fields.where("field = 'tests' AND NOT ambiguous").join(tests, "row", "left_semi").join(read, "row").join(rest, "row", "left")
    return own.select("row", F.concat_ws(" ", F.concat("material", F.lit("의 "), "source", F.lit("은 "), "names", F.lit("에 따른다.")), "rest").alias("text"))
