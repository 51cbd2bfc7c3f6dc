"""Readers of specifications: Word files, HTML tables, corpus JSON, and the splitting of long texts.

Files come through Spark's binaryFile and json sources, so any store that Spark reads will do; only what has no built-in (zip, XML,
tables with spans, boundary-seeking splits) runs in Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import or_
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lintel.functions import text as X
from lintel.session import small_batches

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CLAUSES = "path string, source_order int, source_type string, outline_level int, label string, text string, context string"
LABEL = re.compile(r"^\s*(\d+(?:\.\d+)*\.?|\(\d+\)|[가-하]\.|[①-⑳])\s*")


BOX, MC = f"{W}txbxContent", "{http://schemas.openxmlformats.org/markup-compatibility/2006}"


def _within(node) -> Iterator:
    """What a node holds, text boxes left out: those are blocks of their own."""
    for x in node:
        if x.tag != BOX:
            yield x
            yield from _within(x)


def _boxes(node) -> Iterator:
    """The outermost text boxes of a node; of alternatives the first that has any."""
    for x in node:
        if x.tag == BOX:
            yield x
        elif x.tag == f"{MC}AlternateContent":
            yield from next((found for y in x if (found := list(_boxes(y)))), [])
        else:
            yield from _boxes(x)


def _value(node, path: str) -> str | None:
    found = node.find(path) if node is not None else None
    return found.get(f"{W}val") if found is not None else None


class _Numbering:
    """Labels of numbered paragraphs: every list counts by itself, and a level begins anew behind a higher one."""

    def __init__(self, numbering, styles):
        none = ElementTree.Element("none")
        numbering, styles = (none if x is None else x for x in (numbering, styles))
        levels = {a.get(f"{W}abstractNumId"): {x.get(f"{W}ilvl"): (_value(x, f"{W}numFmt") or "decimal", _value(x, f"{W}lvlText"), int(_value(x, f"{W}start") or 1)) for x in a.findall(f"{W}lvl")} for a in numbering.findall(f"{W}abstractNum")}
        self.lists = {n.get(f"{W}numId"): levels.get(_value(n, f"{W}abstractNumId"), {}) for n in numbering.findall(f"{W}num")}
        self.of_style = {x.get(f"{W}styleId"): x.find(f"{W}pPr/{W}numPr") for x in styles.findall(f"{W}style")}
        self.counted: dict[str, dict[int, int]] = defaultdict(dict)

    def label(self, p) -> str:
        place = p.find(f"{W}pPr/{W}numPr")
        if place is None:
            place = self.of_style.get(_value(p, f"{W}pPr/{W}pStyle"))
        number, level = _value(place, f"{W}numId"), int(_value(place, f"{W}ilvl") or 0)
        if str(level) not in self.lists.get(number, {}):
            return ""
        kind, pattern, start = self.lists[number][str(level)]
        counts = {k: v for k, v in self.counted[number].items() if k <= level}
        counts[level] = counts[level] + 1 if level in counts else start
        self.counted[number] = counts
        if kind == "bullet":
            return "•"
        letter = {"lowerLetter": "a", "upperLetter": "A"}.get(kind)

        def written(m: re.Match) -> str:
            k = int(m[1]) - 1
            value = max(1, counts.get(k, 0))
            return chr(ord(letter) + (value - 1) % 26) if letter and k == level else str(value)

        return re.sub(r"%([1-9])", written, f"%{level + 1}." if pattern is None else pattern)


def _paragraph(p) -> tuple[str, int | None]:
    text = "".join(t.text or "" if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else "\n" if t.tag == f"{W}br" else "" for t in _within(p))
    level, style = _value(p, f"{W}pPr/{W}outlineLvl"), _value(p, f"{W}pPr/{W}pStyle")
    if level is not None:
        return text.strip(), int(level)
    m = re.match(r"(?i)(?:heading|제목)\s*(\d)", style or "")
    return text.strip(), int(m[1]) - 1 if m else None


def word_clauses(content: bytes) -> list[tuple]:
    """(order, type, level, label, text, context) of a Word file's body: paragraphs, headings and table rows, in order; text boxes follow
    the paragraph that holds them. A numbered paragraph's label is that of its list."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else None
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        numbering = _Numbering(part("word/numbering.xml"), part("word/styles.xml"))
    out, path = [], {}

    def add(kind: str, text: str, level: int | None, label: str = "") -> None:
        m = LABEL.match(text)
        out.append((len(out), kind, level, label or (m[1] if m else ""), text, " > ".join(path[k] for k in sorted(path))))

    def walk(parent) -> None:
        for x in parent:
            if x.tag == f"{W}p":
                (text, level), label = _paragraph(x), numbering.label(x)
                if text and level is not None:
                    for k in [k for k in path if k >= level]:
                        del path[k]
                    add("heading", text, level, label)
                    path[level] = text
                elif text:
                    add("paragraph", text, None, label)
                for box in _boxes(x):
                    walk(box)
            elif x.tag == f"{W}tbl":
                for row in x.iter(f"{W}tr"):
                    cells = [" ".join(filter(None, (_paragraph(p)[0] for p in c.iter(f"{W}p")))) for c in row.findall(f"{W}tc")]
                    if any(cells):
                        add("table", " | ".join(cells), None)
            elif x.tag == f"{W}sdt":
                for held in x.findall(f"{W}sdtContent"):
                    walk(held)

    walk(body)
    return out


def read_word(files: DataFrame) -> DataFrame:
    """files: path, content (of the binaryFile source). A file that is no Word file gives one row of type 'unreadable'."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CLAUSES.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = word_clauses(bytes(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
                    rows = [(0, "unreadable", None, "", str(e), "")]
                out = pd.DataFrame([(path, *r) for r in rows], columns=columns)
                out["outline_level"] = out["outline_level"].astype("Int32")
                yield out

    return files.select("path", "content").mapInPandas(parse, CLAUSES)


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.stack = [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "table":
            self.stack.append({"rows": [], "cell": None})
            self.tables.append(self.stack[-1])
        elif self.stack and tag == "tr":
            self.stack[-1]["rows"].append([])
        elif self.stack and tag in ("td", "th"):
            if not self.stack[-1]["rows"]:
                self.stack[-1]["rows"].append([])
            span = lambda k: max(1, min(SPAN_LIMIT, int(attrs[k]))) if (attrs.get(k) or "").isdecimal() else 1
            self.stack[-1]["cell"] = [[], span("rowspan"), span("colspan")]
            self.stack[-1]["rows"][-1].append(self.stack[-1]["cell"])

    def handle_endtag(self, tag):
        if self.stack and tag in ("td", "th"):
            self.stack[-1]["cell"] = None
        elif self.stack and tag == "table":
            self.stack.pop()

    def handle_data(self, data):
        if self.stack and self.stack[-1]["cell"] is not None:
            self.stack[-1]["cell"][0].append(data)


#: Fixed value: the widest and deepest span that a cell may have.
SPAN_LIMIT = 100


def spread(rows: list[list[tuple[str, int, int]]]) -> list[dict[int, str]]:
    """The slots of a table's rows. A cell (text, rows, columns) takes the first free slot of its row and fills its whole rectangle, the
    slots in rows below included, so that those rows find them taken; nothing reaches below the last row."""
    slots: list[dict[int, str]] = [{} for _ in rows]
    for r, cells in enumerate(rows):
        column = 0
        for text, down, across in cells:
            while column in slots[r]:
                column += 1
            for line in slots[r : r + down]:
                line.update(dict.fromkeys(range(column, column + across), text))
            column += across
    return slots


def table_rows(html: str | None) -> list[tuple[int, int, list[str]]]:
    """(table, row, cells) with the values of row and column spans repeated in every cell that they cover."""
    parser = _Tables()
    parser.feed(html or "")
    clean = lambda cell: (re.sub(r"\s+", " ", "".join(cell[0])).strip(), cell[1], cell[2])
    return [(t, r, [line[c] for c in sorted(line)]) for t, table in enumerate(parser.tables) for r, line in enumerate(spread([list(map(clean, row)) for row in table["rows"]]))]


def read_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, table, row, cells of every table row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *r) for i, h in zip(pdf["id"], pdf["html"], strict=True) for r in table_rows(h)]
            yield pd.DataFrame(rows, columns=["id", "table", "row", "cells"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(parse, f"id {kind}, table int, row int, cells array<string>")


CORPUS = "array<struct<codeType:string,code:string,fullCode:string,name:string,version:string,updateDate:string,list:array<struct<label:string,title:string,contents:string>>>>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Every version of every document of a folder of corpus files, with the code that its file name states."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"KCS_(\d+)\.json$", 1).alias("file_code"), "value")
    return versions(files.where("file_code <> ''"))


def versions(files: DataFrame) -> DataFrame:
    """files: file_code, value (JSON array of versions)."""
    return files.select("file_code", F.explode(F.from_json("value", CORPUS)).alias("v")).select("file_code", "v.*")


def latest_versions(rows: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """The last version of each code by (digits of the version, update date), of those that the catalogue (code, version) names."""
    rows = rows.where(F.col("code") == F.col("file_code"))
    if catalogue is not None:
        listed = catalogue.select(F.col("code").alias("c"), F.col("version").alias("v"))
        rows = rows.join(listed, (F.col("code") == F.col("c")) & (F.col("v").isNull() | (F.col("v") == F.col("version"))), "left_semi")
    key = F.struct(F.coalesce(F.regexp_replace("version", r"\D", "").try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")), F.coalesce("updateDate", F.lit("")))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy(key.desc()))).where("_n = 1").drop("_n")


def sections(latest: DataFrame, strip: Column | None = None) -> DataFrame:
    """Sections that have a title or a text, in order, the first of equal (code, label, content)."""
    rows = latest.select("code", "name", "version", "updateDate", F.posexplode("list").alias("pos", "s")).select("code", "name", "version", "updateDate", "pos", "s.label", "s.title", F.col("s.contents").alias("content"))
    usable = rows.where((F.trim(F.coalesce("title", F.lit(""))) != "") | (F.trim(F.coalesce("content", F.lit(""))) != ""))
    w = Window.partitionBy("code", "label", "content").orderBy("pos")
    return usable.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_context(rows: DataFrame, dependent: Column, substantive: Column) -> DataFrame:
    """Adds back (the last substantive content of the same title, else of the document) and ahead (the first of the next three)."""
    doc, same = Window.partitionBy("code").orderBy("pos"), Window.partitionBy("code", "title").orderBy("pos")
    before = lambda w: F.last(F.when(substantive, F.col("content")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_s", F.when(substantive, F.col("content")))
    ahead = F.coalesce(*[F.lead("_s", k).over(doc) for k in (1, 2, 3)])
    return marked.withColumn("back", F.when(dependent, F.coalesce(before(same), before(doc)))).withColumn("ahead", ahead).drop("_s")


#: The last place of a cut in a window: behind punctuation, else behind white space.
_CUTS = [re.compile(r"(?s).*[.!?。;；,:，、]"), re.compile(r"(?s).*[ \n\t]")]


def split_chunks(text: str | None, most: int) -> list[str]:
    """Pieces of at most `most` characters that make up the text again; a cut prefers the last punctuation mark in the second half of its
    window, else the last white space there, else it is hard. An empty text is one empty piece."""
    text, out, at = text or "", [], 0
    while len(text) - at > most:
        window = text[at : at + most]
        found = next((m.end() for p in _CUTS if (m := p.match(window, max(1, most // 2)))), most)
        out.append(window[:found])
        at += found
    return [*out, text[at:]]


@F.pandas_udf(ArrayType(StringType()))
def _chunks(texts: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([split_chunks(t, int(n)) for t, n in zip(texts, most, strict=True)])


def chunks(c: Column, most: int) -> Column:
    """array<string> of the pieces of a text. Lowers the session's bound of Arrow batches, as texts are long."""
    small_batches(SparkSession.active())
    return _chunks(F.coalesce(c, F.lit("")), F.lit(most))


#: The same breaks for Java: punctuation, and white space.
_PUNCTUATION, _SPACE = ".!?。;；,:，、", r" \n\t"


def chunk_lengths(c: Column, most: int) -> Column:
    """array<int> of the characters of each piece that `chunks` makes of a text, without Python. Lowers the bound of Arrow batches as `chunks` does.

    A text without any break is cut by arithmetic; others by a pattern whose alternatives are the rest of a text, a cut behind the last punctuation
    mark, one behind the last white space, and a hard one. Characters beyond the basic plane, which take two units in Java, are masked for it."""
    small_batches(SparkSession.active())
    c, half = F.coalesce(c, F.lit("")), max(1, most // 2)
    cut = lambda breaks: f".{{{half},{most - 1}}}[{breaks}]|" if half < most else ""
    pieces = F.lit(rf"(?s).{{1,{most}}}+\z|{cut(_PUNCTUATION)}{cut(_SPACE)}.{{{most}}}")

    def lengths(size: Column) -> Column:
        narrow = F.octet_length(c) == size
        # Java splits at one character by a vectorized search: a tenth of the time of a class of characters
        has = lambda x: F.size(F.split(c, x if x.isspace() else rf"\{x}", 2)) > 1
        broken = reduce(or_, map(has, " .,:;!?\n\t")) | (~narrow & reduce(or_, map(has, "。；，、")))
        hard = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / most).cast("int")), lambda i: F.least(F.lit(most), size - i * most))
        masked = F.when(narrow, c).otherwise(F.regexp_replace(c, r"[\x{10000}-\x{10FFFF}]", "x"))
        found = F.transform(F.regexp_extract_all(masked, pieces, F.lit(0)), F.char_length)
        return F.when(size <= most, F.array(size)).when(~broken, hard).otherwise(found)

    return F.transform(F.array(F.char_length(c)), lengths)[0]  # so that a text is measured once


def source_segments(docs: DataFrame, id_col: str, text_col: str, most: int = 2000) -> DataFrame:
    """id, n (from 1), segment, was_split: the sentences of a text, each cut into pieces if it is too long."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(X.sentences(F.col(text_col))).alias("s", "sentence"))
    pieces = rows.select("id", "s", chunks(F.col("sentence"), most).alias("pieces")).select("id", "s", F.posexplode("pieces").alias("p", "segment"), (F.size("pieces") > 1).alias("was_split"))
    n = F.row_number().over(Window.partitionBy("id").orderBy("s", "p"))
    return pieces.select("id", n.alias("n"), "segment", "was_split")


def greedy_batches(lengths: Column, count: int, chars: int) -> Column:
    """Batch number of each element of an array of lengths: a batch ends before it would hold too many elements or characters."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("c"), F.lit(0).alias("b"))

    def step(a, x):
        over = (a["n"] > 0) & ((a["n"] >= count) | (a["c"] + x > chars))
        b = a["b"] + over.cast("int")
        return F.struct(F.concat(a["out"], F.array(b)).alias("out"), F.when(over, 1).otherwise(a["n"] + 1).alias("n"), F.when(over, x).otherwise(a["c"] + x).cast("long").alias("c"), b.alias("b"))

    return F.aggregate(lengths, start, step, lambda a: a["out"])
