"""Product standards in texts, and links of clauses by the audited scope of a standard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.functions import terms as T
from lintel.functions.text import U, UI, text, verification_body


def standard_references(c: Column) -> Column:
    """struct<codes, ambiguous>: product standards with prefixes that a list leaves out. A run is a full reference with all that its list
    adds, taken in one match; a part or range behind its number makes the text ambiguous and is skipped."""
    p = UI + T.STANDARD_RUN
    part = lambda i: F.regexp_extract_all(text(c), F.lit(p), F.lit(i))
    runs = F.arrays_zip(part(1).alias("letter"), part(2).alias("iso"), part(3).alias("number"), part(4).alias("range"), part(5).alias("list"))

    def codes(r: Column) -> Column:
        prefix = F.concat(F.lit("KS "), F.upper(r["letter"]), F.when(r["iso"] != "", F.lit(" ISO ")).otherwise(F.lit(" ")))
        return F.transform(F.concat(F.array(r["number"]), F.regexp_extract_all(r["list"], F.lit(r"\d{4}"), F.lit(0))), lambda n: F.concat(prefix, n))

    return F.struct(F.array_distinct(F.flatten(F.transform(runs, codes))).alias("codes"), F.exists(runs, lambda r: r["range"] != "").alias("ambiguous"))


def standard_links(source: Column, target: Column) -> Column:
    """array<struct<standard, reference_type, requirement>>, one element at most: the source names the standard of refractory mortar and
    a mortar, and the target's own text asks of mortar for refractory brickwork that it conform to a standard. It is an explicit link
    if the target names the standard there, an indirect one if it names none, and none if it names another."""
    own, body = verification_body(source), verification_body(target)
    asked = F.regexp_extract(body, U + T.REFRACTORY_REQUIREMENT, 0)
    named = standard_references(asked)["codes"]
    ok = F.array_contains(standard_references(own)["codes"], T.REFRACTORY_STANDARD) & own.rlike(T.MORTAR) & (asked != "") & ((F.size(named) == 0) | F.array_contains(named, T.REFRACTORY_STANDARD))
    kind = F.when(F.array_contains(named, T.REFRACTORY_STANDARD), "explicit").otherwise("indirect")
    link = F.struct(F.lit(T.REFRACTORY_STANDARD).alias("standard"), kind.alias("reference_type"), F.trim(asked).alias("requirement"))
    return F.filter(F.array(F.when(ok, link)), lambda x: x.isNotNull())
