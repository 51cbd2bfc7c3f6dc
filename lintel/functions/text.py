"""Column functions on text: normalisation, tokens, n-grams, references and predicates. All but entity decoding run in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from html import unescape
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lintel.functions import terms as T

#: Unicode classes for \\s, \\d, \\w and \\b.
U = "(?U)"
UI = "(?iU)"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def clean_space(c: Column) -> Column:
    """Runs of white space become one space; trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(text(c), U + r"\s+", " "))


def compact(c: Column) -> Column:
    return F.lower(F.regexp_replace(text(c), U + r"\s+", ""))


def replace_each(c: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """Every match of a pattern replaced by a function of it."""
    between, hits = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, hits, lambda b, h: F.concat(b, F.coalesce(f(h), F.lit("")))), "")


def normalize_references(c: Column) -> Column:
    """'KSD-3503' and other spellings become 'KS D 3503'."""
    p = UI + T.PRODUCT_STANDARD
    return replace_each(text(c), p, lambda h: F.concat(F.lit("KS "), F.upper(F.regexp_extract(h, p, 1)), F.lit(" "), F.regexp_extract(h, p, 2)))


def _of_groups(flat: Column, hit: Callable[[int], Column]) -> Column:
    """For each group of equivalent terms of which a compacted text holds one, `hit` of its number, else null. The text is bound, so that
    it is compacted once and not for each term."""
    found = lambda f: F.array(*[F.when(F.greatest(*[F.contains(f, F.lit("".join(t.split()).lower())) for t in g], F.lit(False)), hit(i)) for i, g in enumerate(T.EQUIVALENT_TERMS)])
    return F.array_compact(F.element_at(F.transform(F.array(flat), found), 1))


def matched_groups(c: Column) -> Column:
    """Numbers of the groups of equivalent terms of which a text holds one."""
    return _of_groups(compact(c), F.lit)


def expand_terms(c: Column) -> Column:
    """The text and every equivalent of terms in it, first seen first."""
    groups = _of_groups(compact(c), lambda i: words_array(T.EQUIVALENT_TERMS[i]))
    return clean_space(F.concat_ws(" ", text(c), F.array_join(F.array_distinct(F.flatten(groups)), " ")))


def normalize_key(c: Column, expand: bool = True) -> Column:
    """Lower-case letters and digits of the canonical text, nothing else."""
    return F.regexp_replace(F.lower(clean_space(normalize_references(expand_terms(c) if expand else text(c)))), "[^0-9a-z가-힣]", "")


@F.pandas_udf(StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    """All named and numeric references; there is no built-in function for them."""
    return s.map(unescape, na_action="ignore")


def _without_tags(c: Column) -> Column:
    for pattern in (r"(?is)<img\b[^>]*>", r"(?i)data:image/[^;]+;base64,[A-Za-z0-9+/=]+", r"(?i)<br\s*/?>", r"(?i)</(?:p|div|tr|li|td|th)>", r"(?s)<[^>]+>"):
        c = F.regexp_replace(c, pattern, " ")
    return c


def strip_html(c: Column) -> Column:
    return clean_space(unescape_entities(_without_tags(text(c))))


def strip_html_basic(c: Column) -> Column:
    """Tags to spaces and the four commonest references, in the JVM only."""
    c = F.regexp_replace(F.regexp_replace(text(c), r"(?i)<br\s*/?>|</(?:p|div|li|tr|td|th|h[1-6])>", " "), r"(?s)<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return clean_space(c)


@F.pandas_udf(StringType())
def compatibility_form(s: pd.Series) -> pd.Series:
    """Normal form KC; there is no built-in function for it. Pure ASCII is in that form already."""
    return s.map(lambda t: t if t.isascii() else normalize("NFKC", t), na_action="ignore")


def folded(c: Column) -> Column:
    """Compatibility form, lower case, single spaces; null becomes ''."""
    return clean_space(F.lower(compatibility_form(text(c))))


def folded_each(c: Column) -> Column:
    """The texts of an array folded, without empty ones, distinct and in order; as one text, as Python functions take no array elements."""
    whole = folded(F.array_join(F.coalesce(c, F.array().cast("array<string>")), "\u001e"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(whole, "\u001e"), lambda x: F.trim(x)), lambda x: x != "")))


def folded_key(c: Column) -> Column:
    """Letters and digits of the folded text, nothing else."""
    return F.regexp_replace(folded(c), r"[^\p{L}\p{N}]", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(text(c), r"\D", "")


def format_code(c: Column) -> Column:
    d = digits(c)
    parts = lambda *cuts: F.concat_ws(" ", F.lit("KCS"), *[F.substring(d, a, n) for a, n in cuts])
    return F.when(F.length(d) >= 6, parts((1, 2), (3, 2), (5, 100))).when(F.length(d) == 4, parts((1, 2), (3, 2))).otherwise(F.concat(F.lit("KCS "), d))


def version_key(version: Column, updated: Column) -> Column:
    d = digits(version)
    return F.struct(F.when(d == "", F.lit(0)).otherwise(d.cast("decimal(38,0)")).cast("decimal(38,0)").alias("version"), text(updated).alias("updated"))


def char_ngrams(key: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """All character n-grams of a key, repeats included, by look-ahead matches."""
    return F.concat(*[F.regexp_extract_all(key, F.lit(f"(?=({'.' * n}))"), F.lit(1)) for n in sizes])


def word_tokens(c: Column, expand: bool = True) -> Column:
    """Words of at least two letters, and numbers, without stop words; repeats included."""
    source = F.lower(expand_terms(c) if expand else text(c))
    found = F.regexp_extract_all(source, F.lit(r"[A-Za-z가-힣]{2,}|\d+(?:\.\d+)?"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(T.STOP_WORDS))


def token_set(c: Column) -> Column:
    return F.array_distinct(word_tokens(c, expand=False))


def section_search_text(code: Column, name: Column, title: Column, content: Column) -> Column:
    return F.concat_ws(" ", text(code), text(name), text(title), text(title), text(content))


def referenced_codes(c: Column) -> Column:
    p = F.lit("(?i)" + T.STANDARD_CODE)
    a, b, d = (F.regexp_extract_all(text(c), p, F.lit(i)) for i in (1, 2, 3))
    join = lambda x, y: F.concat(x, y)
    return F.array_distinct(F.zip_with(F.zip_with(a, b, join), d, join))


def keyword_prefixes(c: Column) -> Column:
    """Code prefixes of every discipline that a text names, in table order."""
    found = [F.when(F.greatest(*[F.contains(text(c), F.lit(k)) for k in keys], F.lit(False)), words_array(T.CHAPTER_PREFIXES[chapter])).otherwise(words_array([])) for keys, chapter in T.KEYWORD_CHAPTERS]
    return F.array_distinct(F.flatten(F.array(*found)))


def first_discipline_prefixes(c: Column) -> Column:
    """Prefixes of the first discipline that a text names."""
    out = words_array([])
    for keys, chapter in reversed(T.KEYWORD_CHAPTERS):
        out = F.when(F.greatest(*[F.contains(text(c), F.lit(k)) for k in keys], F.lit(False)), words_array(T.CHAPTER_PREFIXES[chapter])).otherwise(out)
    return out


def refers_back(c: Column) -> Column:
    return text(c).rlike(UI + T.SECTION_BACKWARD)


def refers_ahead(c: Column) -> Column:
    return text(c).rlike(UI + T.SECTION_FORWARD)


def clause_refers_back(c: Column) -> Column:
    return text(c).rlike(U + T.CLAUSE_BACKWARD)


def clause_refers_ahead(c: Column) -> Column:
    return text(c).rlike(U + T.CLAUSE_FORWARD)


def commercial_only(c: Column) -> Column:
    return text(c).rlike(U + T.COMMERCIAL) & ~text(c).rlike(U + T.TECHNICAL)


def clearly_unrelated(source: Column, target: Column) -> Column:
    return commercial_only(source) & ~text(target).rlike(U + T.COMMERCIAL)


def masonry_units(c: Column) -> Column:
    flat = compact(c)
    named = F.filter(F.array(*[F.when(flat.rlike(p), F.lit(n)) for n, p in T.MASONRY_UNITS]), lambda x: x.isNotNull())
    brick = F.when(F.contains(flat, F.lit("벽돌")) & ~F.exists(named, lambda x: F.endswith(x, F.lit("_brick"))), words_array(["brick"])).otherwise(words_array([]))
    block = F.when(F.contains(flat, F.lit("블록")) & ~F.arrays_overlap(named, words_array(["form_block", "concrete_block", "alc"])), words_array(["block"])).otherwise(words_array([]))
    return F.concat(named, brick, block)


def masonry_conflict(source: Column, target: Column) -> Column:
    """Exclusive, different masonry units; a generic unit covers those of its family."""
    s, t = masonry_units(source), masonry_units(target)
    both = F.concat(s, t)
    covered = lambda generic, family: F.array_contains(both, generic) & (F.size(F.array_except(both, words_array(family))) == 0)
    return (F.size(s) == 1) & (F.size(t) == 1) & (s != t) & ~covered("brick", T.BRICKS) & ~covered("block", T.BLOCKS)


def named_mortar_mismatch(source: Column, target: Column) -> Column:
    names = lambda c: F.array_distinct(F.regexp_extract_all(text(c), F.lit(U + r"(내화|단열)\s*(?:몰탈|모르타르|모르터)"), F.lit(1)))
    s, t = names(source), names(target)
    return (F.size(s) == 1) & (F.size(t) == 1) & ~F.arrays_overlap(s, t)


def own_requirement(title: Column, content: Column) -> Column:
    t, c = F.regexp_replace(F.trim(text(title)), "…$", ""), F.trim(text(content))
    mix = t.rlike(U + r"(?:몰탈|모르타르|모르터|배합)[^:：]{0,40}\d\s*$") & c.rlike(U + r"^\d(?:\s*[:：]\s*\d)?\s*(?:으로|을|를|\))")
    return F.when(F.startswith(c, t), c).when(mix, F.concat(t, F.lit(" : "), c)).otherwise(F.trim(F.concat_ws(" ", t, c)))


def verification_body(c: Column) -> Column:
    out = text(c)
    for prefix, marker in reversed(T.FIELD_LABELS):
        at = F.instr(text(c), marker)
        out = F.when(F.startswith(text(c), F.lit(prefix)) & (at > 0), F.substring(text(c), at + len(marker), F.length(text(c)))).otherwise(out)
    return out


def contextual_requirement(title: Column, content: Column, context: Column, analysis: Column) -> Column:
    own = own_requirement(title, content)
    both = F.concat_ws("\n", F.nullif(context, F.lit("")), F.nullif(analysis, F.lit("")))
    return F.when(both != "", F.concat(F.lit("[원문 상위 문맥] "), both, F.lit("\n[현재 요구사항] "), own)).otherwise(own)


def evidence_present(quote: Column, source: Column) -> Column:
    """The quote, without its own label and white space, occurs in the text; at least four characters."""
    needle = compact(F.regexp_replace(text(quote), U + T.QUOTE_LABEL, ""))
    return (F.length(needle) >= 4) & F.contains(compact(source), needle)


def score_band(c: Column) -> Column:
    return F.when(c.isNull(), "none").when(c >= 0.45, "high").when(c >= 0.35, "medium").otherwise("low")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if a norm is 0; kept within -1 and 1; other lengths are an error."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    value = F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (norm(a) * norm(b)))))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def safe_filename(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), r'[\\/:*?"<>|\x00-\x1f]', "_"))


def safe_cell(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(text(c).rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), text(c))).otherwise(text(c))


def table_cells(c: Column) -> Column:
    return F.transform(F.split(text(c), r" \| ", -1), lambda x: F.trim(x))


def split_label(c: Column) -> Column:
    """Label ('1.2', '(3)', '가.') and the rest of a heading."""
    p = U + r"^\s*(\d+(?:\.\d+)*\.?|\(\d+\)|[가-하]\.|[①-⑳])\s*(.*)$"
    return F.struct(F.regexp_extract(text(c), p, 1).alias("label"), F.when(text(c).rlike(p), F.regexp_extract(text(c), p, 2)).otherwise(F.trim(text(c))).alias("title"))


def sentences(c: Column) -> Column:
    """Sentences of the lines of a text, white space collapsed, without empty ones. A sentence ends behind its mark where white space, a
    letter or an opening bracket follows."""
    lines = F.transform(F.split(text(c), r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"), clean_space)
    cut = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?。;；])(?:\s+|(?=[가-힣A-Za-z(\[]))")))
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")
