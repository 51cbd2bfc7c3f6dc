"""Quantities with units, normative wording, and what a comparison of two texts would lose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.functions import terms as T
from lintel.functions.text import UI, U, clean_space, compatibility_form, text

QUANTITY = f"(?i)({T.NUMBER})\\s*({T.LATIN_UNIT}(?![A-Za-z])|{T.SYMBOL_UNIT})"


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def number_text(c: Column) -> Column:
    """Without grouping commas, signs of plus and trailing zeros."""
    value = F.replace(c, F.lit(","), F.lit("")).cast("decimal(38,12)")
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%s", value.cast("string")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(value == 0, F.lit("0")).otherwise(plain)


def unit_name(c: Column) -> Column:
    key = F.lower(c)
    return F.coalesce(F.element_at(_literal_map(T.UNIT_NAMES), key), F.replace(F.replace(key, F.lit("2"), F.lit("²")), F.lit("3"), F.lit("³")))


def quantities(c: Column) -> Column:
    """array<struct<number, unit>>, distinct, by value and unit."""
    numbers, units = (F.regexp_extract_all(clean_space(c), F.lit(QUANTITY), F.lit(i)) for i in (1, 2))
    items = F.zip_with(numbers, units, lambda n, u: F.struct(number_text(n).cast("decimal(38,12)").alias("value"), unit_name(u).alias("unit"), number_text(n).alias("number")))
    return F.transform(F.array_sort(F.array_distinct(items)), lambda x: F.struct(x["number"].alias("number"), x["unit"].alias("unit")))


def canonical(item: Column) -> Column:
    """struct<family, value> of a quantity, in the family's smallest unit."""
    family = F.coalesce(F.element_at(_literal_map({k: v[0] for k, v in T.UNIT_FACTORS.items()}), item["unit"]), item["unit"])
    factor = F.coalesce(F.element_at(_literal_map({k: v[1] for k, v in T.UNIT_FACTORS.items()}), item["unit"]), F.lit("1")).cast("decimal(14,3)")
    return F.struct(family.alias("family"), (item["number"].cast("decimal(20,6)") * factor).cast("decimal(38,9)").alias("value"))


def starts_with_quantity(c: Column) -> Column:
    s = clean_space(c)
    word = "|".join(T.WORD_UNITS)
    latin = s.rlike(f"(?i)^{T.NUMBER}\\s*(?:{T.LATIN_UNIT}(?![A-Za-z])|㎜|㎝|㎞|㎟|㎠|㎡|㎥|㎎|㎏|℃|%)")
    return latin | s.rlike(f"{U}^{T.NUMBER}\\s*(?:{word})\\s*(?:$|{T.AFTER_WORD_UNIT})")


def distinct_matches(pattern: str, c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(U + pattern), F.lit(0))))


def topic_tokens(c: Column) -> Column:
    """Distinct words without their particle and without stop words."""

    def stem(t: Column) -> Column:
        out = t
        for p in reversed(T.PARTICLES):
            out = F.when((F.length(t) > len(p) + 1) & F.endswith(t, F.lit(p)), F.substring(t, F.lit(1), F.length(t) - len(p))).otherwise(out)
        return out

    found = F.transform(F.regexp_extract_all(F.lower(text(c)), F.lit("[A-Za-z가-힣]{2,}"), F.lit(0)), stem)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(T.TOPIC_STOP_WORDS)))


def topic_overlap(a: Column, b: Column) -> Column:
    x, y = topic_tokens(a), topic_tokens(b)
    inside = F.exists(x, lambda s: F.exists(y, lambda t: (F.least(F.length(s), F.length(t)) >= 3) & (F.contains(s, t) | F.contains(t, s))))
    return F.coalesce(F.arrays_overlap(x, y), F.lit(False)) | inside


def differences(source: Column, target: Column) -> Column:
    """struct<warnings, categories>: what the source requires and the target lacks, in a fixed order; one-sided."""
    s, t = clean_space(source), clean_space(target)
    same_topic = topic_overlap(s, t)
    sq, tq = quantities(s), F.transform(quantities(t), canonical)
    lost = F.exists(sq, lambda q: ~F.exists(tq, lambda x: x == canonical(q)))
    limit_s, limit_t = distinct_matches(T.LIMIT, s), distinct_matches(T.LIMIT, t)
    only = lambda p: (F.size(distinct_matches(p, s)) > 0) & (F.size(distinct_matches(p, t)) == 0)
    checks = [
        ("quantity", (F.size(sq) > 0) & lost), ("limit", (F.size(limit_s) > 0) & (limit_s != limit_t)),
        ("prohibition", only(T.PROHIBITION)), ("obligation", only(T.OBLIGATION)),
    ]
    kinds = F.filter(F.array(*[F.when(same_topic & ok, F.lit(name)) for name, ok in checks]), lambda x: x.isNotNull())
    return F.struct(F.transform(kinds, lambda k: F.element_at(_literal_map(T.WARNINGS), k)).alias("warnings"), kinds.alias("categories"))


def warnings_by_tolerance(source: Column, target: Column) -> Column:
    """The lighter comparison: relative tolerance of 1e-9 on values, and any missing limit word."""
    sq, tq = (F.transform(quantities(clean_space(c)), canonical) for c in (source, target))
    near = lambda a, b: (a["family"] == b["family"]) & (F.abs(a["value"].cast("double") - b["value"].cast("double")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a["value"].cast("double"))))
    lost = F.exists(sq, lambda q: ~F.exists(tq, lambda x: near(q, x)))
    limits = F.size(F.array_except(distinct_matches(T.LIMIT, clean_space(source)), distinct_matches(T.LIMIT, clean_space(target)))) > 0
    only = lambda p: clean_space(source).rlike(U + p) & ~clean_space(target).rlike(U + p)
    checks = [("quantity", lost), ("limit", limits), ("prohibition", only(T.PROHIBITION)), ("obligation", only(T.OBLIGATION))]
    return F.filter(F.array(*[F.when(ok, F.lit(T.WARNINGS[name])) for name, ok in checks]), lambda x: x.isNotNull())


def unsupported_numbers(claim: Column, quotes: Column) -> Column:
    """Numbers of a claim that no quoted evidence holds."""
    found = F.array_distinct(F.regexp_extract_all(text(claim), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
    return F.filter(found, lambda n: ~F.contains(F.array_join(quotes, " "), n))


def grades(c: Column) -> Column:
    """Steel grades, with comma-separated suffixes expanded onto the base before them; a bare -TMC adds none."""
    run = T.GRADE + r"((?:\s*,\s*(?:-TMC|[A-Z]{1,2})(?![A-Z0-9]))*)"
    bases, firsts, tails = (F.transform(F.regexp_extract_all(F.upper(compatibility_form(text(c))), F.lit(run), F.lit(i)), lambda x: F.regexp_replace(x, r"\s+", "")) for i in (1, 2, 3))
    rows = F.arrays_zip(bases.alias("b"), firsts.alias("f"), tails.alias("t"))
    each = F.transform(rows, lambda r: F.concat(
        F.array(F.concat(r["b"], r["f"])),
        F.transform(F.filter(F.split(r["t"], ","), lambda s: (s != "") & (s != "-TMC")), lambda s: F.concat(r["b"], s)),
    ))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def product_standards(c: Column) -> Column:
    p = F.lit(UI + T.TABLE_STANDARD)
    letters, numbers = (F.regexp_extract_all(compatibility_form(text(c)), p, F.lit(i)) for i in (1, 2))
    return F.array_distinct(F.zip_with(letters, numbers, lambda a, b: F.concat(F.lit("KS "), F.upper(a), F.lit(" "), b)))


