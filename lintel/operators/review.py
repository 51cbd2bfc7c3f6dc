"""Operators on clauses under review: query texts, table evidence, references, labels and positions."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from lintel.functions import links as L
from lintel.functions import quantities as N
from lintel.functions import terms as T
from lintel.functions import text as X
from lintel.session import deals


def query_texts(clauses: DataFrame, keys: list[str]) -> DataFrame:
    """Adds query: a clause's own requirement, that of an adjacent clause only if a reference word asks for it, and its context's end.

    Adjacent means the next place in order, in the same context, and no heading."""
    w = Window.partitionBy(*keys).orderBy("source_order")
    rows = clauses.withColumn("_own", X.own_requirement(F.col("title"), F.col("content")))
    near = F.struct("_own", "source_order", "source_type", F.coalesce("context", F.lit("")).alias("context"))

    def pulled(other: Column, step: int, asks: Column) -> Column:
        ok = asks & (other["source_order"] - F.col("source_order") == step) & (other["source_type"] != "heading") & (other["context"] == F.coalesce("context", F.lit("")))
        return F.when(ok, other["_own"])

    back = pulled(F.lag(near).over(w), -1, X.clause_refers_back(F.col("_own")))
    ahead = pulled(F.lead(near).over(w), 1, X.clause_refers_ahead(F.col("_own")))
    context = F.when((F.coalesce("context", F.lit("")) != "") & ~X.commercial_only(F.col("_own")), F.right(F.col("context"), F.lit(160)))
    return rows.withColumn("query", F.concat_ws(" ", "_own", back, ahead, context)).drop("_own")


def table_fields(content: Column, context: Column) -> Column:
    """struct<standards, grades, thickness, products>: standards of the row, else of the nearest caption only."""
    captions = F.filter(F.transform(F.split(X.text(context), " > "), lambda p: F.trim(p)), lambda p: ~F.startswith(p, F.lit("[표 열]")))
    own, caption = N.product_standards(content), N.product_standards(F.coalesce(F.element_at(captions, -1), F.lit("")))
    thickness = F.regexp_extract_all(X.text(content), F.lit(r"(?i)\d+(?:\.\d+)?\s*(?:mm|㎜)\s*(?:이하|이상|미만|초과)?"), F.lit(0))
    products = F.filter(X.words_array(T.PRODUCTS), lambda p: F.contains(X.text(content), p))
    return F.struct(F.when(F.size(own) > 0, own).otherwise(caption).alias("standards"), N.grades(content).alias("grades"), thickness.alias("thickness"), products.alias("products"))


def matching_table_rows(clauses: DataFrame, rows: DataFrame, clause: str, row: str) -> DataFrame:
    """Pairs that share a standard and a grade in one of their rows each, once.

    Keys with the same standards and grades are one class. Classes meet by an equi-join on standards and grades and are deduplicated;
    their pairs are then expanded to members, so the pairs of keys, of which there can be far more, are neither made twice nor moved."""

    def classes(df: DataFrame, key: str, into: str) -> tuple[DataFrame, DataFrame]:
        sets = F.struct(*[F.array_sort(F.array_distinct(c)).alias(c) for c in ("standards", "grades")])
        members = df.select(F.col(key), sets.alias("of")).groupBy(key).agg(F.array_sort(F.collect_set("of")).alias("of"))
        members = members.withColumn(into, F.sha2(F.to_json("of"), 256))
        held = members.dropDuplicates([into]).select(into, F.explode("of").alias("of"))
        return members.select(key, into), held.select(into, F.explode("of.standards").alias("s"), F.col("of.grades").alias("g")).select(into, "s", F.explode("g").alias("g"))

    (left, a), (right, b) = classes(clauses, clause, "_a"), classes(rows, row, "_b")
    met = a.join(b, ["s", "g"]).select("_a", "_b").distinct()
    return left.join(met, "_a").join(right, "_b").select(clause, row)


def table_checks(rows: DataFrame, id_col: str) -> DataFrame:
    """One row per checked field: found if all of the source's values are known; thickness and products are never confirmed."""
    status = lambda a, b: F.when(F.size(F.array_except(a, b)) == 0, "found").otherwise("unconfirmed")
    checks = [("standards", status("standards", "known_standards")), ("grades", status("grades", "known_grades")), ("thickness", F.lit("unconfirmed")), ("products", F.lit("unconfirmed"))]
    return rows.select(id_col, F.explode(F.array(*[F.struct(F.lit(n).alias("field"), s.alias("status")) for n, s in checks])).alias("c")).select(id_col, "c.*")


#: Fixed value: wording of the second cell of a row of tests.
TEST_WORDS = r"시험|강도|치수|내화|내 화|규격|흡"


def test_fields(source_type: Column, content: Column, notation: Column) -> Column:
    """array<struct<field, source>> of a table row about tests, else null: four cells, or five with the standard in the third; the second
    speaks of tests, and the row's notation (of four cells given apart) names a product standard. Empty cells are no fields."""
    cells = F.transform(F.split(X.text(content), r"\|", -1), X.clean_space)
    n = F.size(cells)
    named = F.coalesce(F.nullif(notation, F.lit("")), F.when(n == 5, F.get(cells, 2)), F.lit(""))
    ok = (source_type == "table") & n.isin(4, 5) & (F.size(L.standard_references(named)["codes"]) > 0) & F.get(cells, 1).rlike(TEST_WORDS)
    at = [("tests", F.lit(1)), ("frequency", F.when(n == 5, 3).otherwise(2)), ("conditions", F.when(n == 5, 4).otherwise(3))]
    fields = F.array(*[F.struct(F.lit(name).alias("field"), F.get(cells, i).alias("source")) for name, i in at])
    return F.when(ok, F.filter(fields, lambda f: f["source"] != ""))


def all_references(c: Column) -> Column:
    """References to national and foreign standards, canonical, first seen first within each family."""
    families = [r"KCS\s*\d{2}\s*\d{2}\s*\d{2}", r"KS\s*[A-Z]\s*\d{3,}", r"ASTM\s*[A-Z]\s*\d+", r"JIS\s*[A-Z]\s*\d+", r"ISO\s*\d+", r"EN\s*\d+", r"DIN\s*\d+", r"AISC\s*\d+", r"AWS\s*[A-Z]\d+(?:\.\d+)?"]
    found = F.flatten(F.array(*[F.regexp_extract_all(X.text(c), F.lit(rf"(?i)(?<![A-Za-z]){p}"), F.lit(0)) for p in families]))
    return F.array_distinct(F.transform(found, lambda r: F.upper(F.regexp_replace(F.trim(r), r"\s+", " "))))


def missing_references(refs: Column, candidates: Column) -> Column:
    flat = F.upper(F.regexp_replace(X.text(candidates), r"[\s\-_]+", ""))
    return F.filter(refs, lambda r: ~F.contains(flat, F.regexp_replace(r, r"[\s\-_]+", "")))


#: Lines that one task relates to others, about.
DEALT = 100_000


#: Hash buckets whose rows are counted, to learn of frequent keys without a count of each key.
BUCKETS = 1 << 16


def related_references(asking: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """clause, rank, code: codes of the same topic elsewhere that the clause does not cite yet, at most k.

    `pool` holds all rows of the clauses that ask, so a code that a clause does not cite comes from another one. A clause with m codes
    finds its k among the first k + m codes of each of its topics; no more codes of a topic meet it. Rows move four times: by clause, where they
    become one row for each topic, the first of which takes the clause's own codes along; both sides by topic; and what was found by clause."""
    tasks = deals(asking, DEALT)
    # no clause has more codes than a bucket of clauses has rows; tasks keep no more codes of a topic
    buckets = asking.groupBy(F.pmod(F.xxhash64("clause"), F.lit(BUCKETS)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    most = min((buckets.agg(F.max("n")).first()[0] or 0) + k, 2**31 - 1)
    held = asking.repartition(tasks, "clause").groupBy("clause").agg(F.collect_set("topic").alias("topics"), F.collect_set("code").alias("cited"))
    asks = held.where("clause IS NOT NULL").select("clause", "cited", F.posexplode_outer("topics").alias("at", "topic")).where("topic IS NOT NULL")
    asks = asks.select("clause", "topic", (F.size("cited") + k).alias("need"), F.when(F.col("at") == 0, F.col("cited")).alias("cited"))

    codes, keys = pool.where("topic IS NOT NULL AND code IS NOT NULL").select("topic", "code"), ["topic"]
    gathered = F.slice(F.array_sort(F.collect_set("code")), 1, most).alias("codes")
    often = _frequent(asking.select("topic").unionByName(pool.select("topic")), "topic", DEALT)
    if often is None:
        first = codes.repartition(tasks, "topic").groupBy("topic").agg(gathered)
    else:  # topics that more rows have are cut by clause, and as many copies of their few codes meet the parts
        often, keys, cuts = F.broadcast(often.select("topic", F.ceil(F.col("n") / DEALT).cast("int").alias("cuts"))), ["topic", "cut"], F.coalesce("cuts", F.lit(1))
        asks = asks.join(often, "topic", "left").withColumn("cut", F.pmod(F.xxhash64("clause"), cuts).cast("int")).drop("cuts")
        ranked = codes.distinct().withColumn("at", F.row_number().over(Window.partitionBy("topic").orderBy("code"))).where(F.col("at") <= most)
        first = ranked.groupBy("topic").agg(gathered).join(often, "topic", "left").select("topic", "codes", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("cut")).repartition(tasks, *keys)
    met = asks.repartition(tasks, *keys).hint("merge").join(first, keys, "left")
    # a code is met in several topics; it is made one where the clause lies
    found = met.select("clause", F.expr("slice(codes, 1, need)").alias("codes"), "cited").repartition(tasks, "clause")
    found = found.groupBy("clause").agg(F.flatten(F.collect_list("codes")).alias("codes"), F.flatten(F.collect_list("cited")).alias("cited"))
    new = found.select("clause", F.slice(F.array_sort(F.array_except("codes", "cited")), 1, k).alias("codes"))
    return new.select("clause", F.posexplode("codes").alias("rank", "code")).select("clause", (F.col("rank") + 1).alias("rank"), "code")


def _frequent(df: DataFrame, key: str, rows: int) -> DataFrame | None:
    """key, n of the keys that more than `rows` rows of df have, or None; only keys in buckets of so many rows are counted one by one."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("b")
    full = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows).select("b")
    if full.isEmpty():
        return None
    kept = df.withColumn("b", bucket).join(F.broadcast(full), "b", "left_semi")
    found = kept.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)  # at most a row for so many rows
    return None if found.isEmpty() else found


def source_positions(clauses: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, clause, page, at: each clause's text is looked for behind the one found before; a clause that is not found moves nothing.

    The cursor runs through a document in order, so a document is one group; its pages are joined once and found by bisection."""

    def find(cs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        flat = lambda t: re.sub(r"\s+", "", t or "")
        ps = ps.sort_values("page")
        parts = [flat(t) for t in ps["text"]]
        ends = list(accumulate(map(len, parts)))
        whole, cursor, out = "".join(parts), 0, []
        for doc, clause, text in cs.sort_values("clause")[["doc", "clause", "text"]].itertuples(index=False):
            needle = flat(text)
            at = whole.find(needle, cursor) if needle else -1
            page = None
            if at >= 0:
                page, cursor = int(ps["page"].iloc[bisect_right(ends, at)]), at + len(needle)
            out.append((doc, clause, page, at if at >= 0 else None))
        return pd.DataFrame(out, columns=["doc", "clause", "page", "at"]).astype({"page": "Int32", "at": "Int64"})

    return clauses.groupBy("doc").cogroup(pages.groupBy("doc")).applyInPandas(find, "doc string, clause int, page int, at long")


#: A clause of fewer letters and digits than this, or one that refers to others, is read with its neighbours.
SHORT = 45


def neighbour_context(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows (source_type, title, content, heading_context) with source_context: the context of the headings and, for a clause that is short
    or refers to others, the nearest clauses before and behind it that are no headings."""
    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    body = F.when(F.coalesce("source_type", F.lit("")) != "heading", said)
    last = lambda by: F.last(body, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", last(F.col(order))).withColumn("_behind", last(F.desc(order)))
    whole = F.regexp_replace(F.lower(F.concat_ws(" ", "heading_context", said)), "[^0-9a-z가-힣]", "")
    alone = (F.char_length(whole) >= SHORT) & ~said.rlike(X.UI + T.NEIGHBOUR_REFERENCE) & ~said.rlike(X.UI + T.NEIGHBOUR_AHEAD)
    shown = F.filter(F.array("heading_context", "_before", "_behind"), lambda x: x.isNotNull() & (x != ""))
    return rows.withColumn("source_context", F.when(alone, F.col("heading_context")).otherwise(F.array_join(shown, " "))).drop("_before", "_behind")


#: Depths of section numbers; a column is made for each that occurs.
MOST_LEVELS = 64


def contextual_labels(rows: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Adds full_label (section number, item in brackets and letter, each carried on until a higher one begins) and section_path (the
    titles of the open sections, outermost first)."""
    w = Window.partitionBy(doc).orderBy(order)
    parts = X.split_label(F.col(text))
    label, title = parts["label"], parts["title"]
    section = F.when(label.rlike(r"^\d"), F.regexp_replace(label, r"\.$", ""))
    rows = rows.withColumn("_s", section).withColumn("_i", F.when(label.rlike(r"^\("), label)).withColumn("_l", F.when(label.rlike(r"^[가-하]\."), label))
    rows = rows.withColumn("_sec", F.last("_s", ignorenulls=True).over(w)).withColumn("_ns", F.count("_s").over(w))
    w2 = Window.partitionBy(doc, "_ns").orderBy(order)
    rows = rows.withColumn("_item", F.last("_i", ignorenulls=True).over(w2))
    full = F.concat(F.coalesce("_sec", F.lit("")), F.coalesce("_item", F.lit("")), F.coalesce(F.concat(F.lit("-"), F.col("_l")), F.lit("")))
    rows = rows.withColumn("full_label", full)
    # the newest title of each depth, and the place where it began; a depth is open if no shallower section began behind it
    depth = F.size(F.split("_s", r"\."))
    deepest = rows.where("_s IS NOT NULL").agg(F.max(depth)).first()[0] or 1  # one number
    if deepest > MOST_LEVELS:
        raise ValueError(f"a section number of {deepest} parts; at most {MOST_LEVELS} are told apart")
    levels = range(1, deepest + 1)
    for k in levels:
        rows = rows.withColumn(f"_t{k}", F.last(F.when(F.col("_s").isNotNull() & (depth == k), F.struct(F.col(order).alias("at"), title.alias("title"))), ignorenulls=True).over(w))
    latest = lambda k: F.greatest(F.lit(None).cast("long"), *[F.col(f"_t{j}.at").cast("long") for j in range(1, k)]) if k > 1 else F.lit(None).cast("long")
    open_ = [F.when(F.col(f"_t{k}").isNotNull() & (latest(k).isNull() | (F.col(f"_t{k}.at").cast("long") > latest(k))), F.col(f"_t{k}.title")) for k in levels]
    return rows.withColumn("section_path", F.concat_ws(" > ", *open_)).drop("_s", "_i", "_l", "_sec", "_ns", "_item", *[f"_t{k}" for k in levels])


# Headings of a table of contents, how far it is looked for, and its page locators.
CONTENTS_MARKS = ["목차", "차례", "contents", "tableofcontents"]
MARK_WITHIN, ENTRIES_WITHIN, LEAST_RUN = 200, 400, 5
PAGE_LOCATOR = r"(?:\.{2,}|…+|·{2,}|\t)\s*\d+\s*$"


def contents_entry(c: Column) -> Column:
    """struct<label, title> of a numbered heading without its page locator; null if it is none."""
    parts = X.split_label(X.clean_space(F.regexp_replace(X.text(c), PAGE_LOCATOR, "")))
    label, title = F.regexp_replace(parts["label"], r"\.$", ""), F.trim(parts["title"])
    return F.when(label.rlike(r"^\d+(?:\.\d+)*$") & (title != "") & (F.length(title) <= 200), F.struct(label.alias("label"), X.normalize_key(title, expand=False).alias("title")))


def body_starts(rows: DataFrame) -> DataFrame:
    """doc, body_start of documents with a table of contents. rows: doc, pos (from 0), kind (paragraph or table), text, toc_style,
    page_break.

    Behind a marker (a heading, or a paragraph styled as contents) the body begins where the first entry comes again after entries of
    two labels at least, or behind a page break after as many unless contents go on there. Without such a start, a run of at least five
    entries that begins at a top section is a table of contents if its first three entries come again in order: within the run first,
    else behind it."""
    flat = F.regexp_replace(F.lower(X.clean_space(F.col("text"))), "[^0-9a-z가-힣]", "")
    paragraph = F.col("kind") == "paragraph"
    marked = rows.withColumn("e", F.when(paragraph, contents_entry(F.col("text")))).withColumn("mark", paragraph & flat.isin(CONTENTS_MARKS)).withColumn("blank", paragraph & (X.clean_space(F.col("text")) == ""))
    marked = marked.withColumn("styled", paragraph & F.coalesce("toc_style", F.lit(False))).withColumn("toc_like", F.col("e").isNotNull() & (F.col("styled") | F.col("text").rlike(PAGE_LOCATOR)))
    ahead = Window.partitionBy("doc").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    marked = marked.withColumn("next", F.first(F.when(~F.col("blank"), F.struct("pos", "toc_like")), ignorenulls=True).over(ahead))
    # behind a marker
    marks = marked.where((F.col("mark") | F.col("styled")) & (F.col("pos") < MARK_WITHIN)).groupBy("doc").agg(F.min(F.struct("pos", (~F.col("mark")).alias("own"))).alias("m"))
    near = marked.join(marks, "doc").where(paragraph & (F.col("pos") >= F.col("m.pos") + F.when(F.col("m.own"), 0).otherwise(1)) & (F.col("pos") < F.col("m.pos") + ENTRIES_WITHIN))
    w = Window.partitionBy("doc").orderBy("pos")
    near = near.withColumn("first", F.first("e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    labels = lambda upto: F.size(F.collect_set("e.label").over(w.rowsBetween(Window.unboundedPreceding, upto)))
    near = near.withColumn("before", labels(-1)).withColumn("upto", labels(0))
    again = F.when((F.col("e") == F.col("first")) & (F.col("before") >= 2), F.col("pos"))
    broken = F.when(F.coalesce("page_break", F.lit(False)) & (F.col("upto") >= 2) & F.col("next").isNotNull() & ~F.col("next.toc_like"), F.col("next.pos"))
    explicit = near.withColumn("start", F.coalesce(again, broken)).where("start IS NOT NULL").groupBy("doc").agg(F.min_by("start", "pos").alias("start"))
    # runs of entries: numbered by what is no entry before them
    shown = marked.where(paragraph & ~F.col("blank"))
    shown = shown.withColumn("run", F.count_if(F.col("e").isNull()).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    entries = shown.where("e IS NOT NULL").withColumn("e1", F.lead("e", 1).over(w)).withColumn("e2", F.lead("e", 2).over(w))
    runs = entries.where(F.col("pos") < MARK_WITHIN).withColumn("at", F.row_number().over(Window.partitionBy("doc", "run").orderBy("pos")) - 1)
    heads = runs.groupBy("doc", "run").agg(F.count(F.lit(1)).alias("size"), F.max("pos").alias("end"), *[F.min_by(c, "pos").alias(f"h{i}") for i, c in enumerate(("e", "e1", "e2"))])
    heads = heads.where((F.col("size") >= LEAST_RUN) & ~F.contains(F.col("h0.label"), F.lit(".")))
    places = entries.select("doc", F.col("run").alias("in_run"), "pos", "e", "e1", "e2").join(runs.select("doc", "pos", "at"), ["doc", "pos"], "left")
    same = (F.col("e") == F.col("h0")) & (F.col("e1") == F.col("h1")) & (F.col("e2") == F.col("h2"))
    inside = (F.col("in_run") == F.col("run")) & (F.col("at") >= LEAST_RUN)
    hits = heads.join(places, "doc").where(same & (inside | (F.col("pos") > F.col("end"))))
    order = F.struct(F.when(inside, 0).otherwise(1), F.when(inside, F.col("pos")).otherwise(F.col("run")), F.col("pos"))
    implicit = hits.groupBy("doc").agg(F.min_by("pos", order).alias("implied"))
    return explicit.join(implicit, "doc", "full").select("doc", F.coalesce("start", "implied").alias("body_start"))


def exact_cover(ids: Column, expected: Column) -> Column:
    """Every expected id once and no other."""
    return (F.array_sort(ids) == F.array_sort(expected)) & (F.size(ids) == F.size(F.array_distinct(ids)))


def unique_json_keys(c: Column) -> Column:
    """Whether a text is JSON without a repeated key in any object; parsers keep the last one silently, so pairs are looked at."""

    def ok(t: str | None) -> bool:
        def pairs(items):
            if len(items) != len(dict(items)):
                raise ValueError("repeated key")
            return dict(items)

        try:
            json.loads(t or "", object_pairs_hook=pairs)
        except ValueError:
            return False
        return True

    @F.pandas_udf(BooleanType())
    def check(s: pd.Series) -> pd.Series:
        return s.map(ok)

    return check(c)
