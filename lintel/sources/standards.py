"""Texts of standards as their publisher's viewer gives them, and outlines of Word files by patterns over their XML."""

from __future__ import annotations

import io
import json
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lintel.functions import text as X

MACHINE = "info struct<tmprKsNo:string,reformNo:string,activeYn:string,formType:string,operationDate:string>, content array<struct<NUMBERING:string,TITLE_NUMBERING:string,CONTENT:string>>"
# Least number of sections, most characters, and class of blocks that are no text of the standard.
LEAST_SECTIONS, MOST_CHARS, NAVIGATION = 3, 80_000, "jb-serach-text"


def _plain(c: Column) -> Column:
    """Text of a fragment: scripts, styles and the viewer's own navigation left out, cells and rows kept apart."""
    c = F.regexp_replace(X.text(c), rf"(?is)<(script|style)\b.*?</\1\s*>|<(\w+)[^>]*class\s*=\s*[\"'][^\"']*{NAVIGATION}[^\"']*[\"'][^>]*>.*?</\2\s*>", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)</t[hd]\s*>", " | "), r"(?i)</tr\s*>", "\n")
    return X.clean_space(X.unescape_entities(F.regexp_replace(c, r"(?s)<[^>]+>", "")))


def machine_sections(files: DataFrame) -> DataFrame:
    """standard, section, text, title_path of numbered sections. files: standard, revision, edition_date, value (JSON of the viewer).

    A file counts only if it is the revision, in force, in the form and of the date that the standard's own page states, and if it has
    three sections at least and 80,000 characters at most."""
    rows = files.withColumn("j", F.from_json("value", MACHINE))
    d = F.regexp_extract_all("j.info.operationDate", F.lit(r"\d+"), F.lit(0))
    date = F.concat_ws("-", F.get(d, 0), F.lpad(F.get(d, 1), 2, "0"), F.lpad(F.get(d, 2), 2, "0"))
    own = (F.col("j.info.tmprKsNo") == F.replace("standard", F.lit(" "), F.lit(""))) & (F.col("j.info.reformNo") == F.col("revision")) & (F.col("j.info.activeYn") == "Y") & (F.col("j.info.formType") == "STD") & (F.size(d) == 3) & (date == F.col("edition_date"))
    items = rows.where(own).select("standard", F.posexplode("j.content").alias("i", "x")).select("standard", "i", X.text(F.col("x.NUMBERING")).alias("section"), X.text(F.col("x.TITLE_NUMBERING")).alias("heading"), X.text(F.col("x.CONTENT")).alias("body"))
    items = items.withColumn("title", _plain(F.col("heading"))).withColumn("text", X.clean_space(F.concat_ws(" ", "title", _plain(F.col("body")))))
    titles = items.where("title <> ''").groupBy("standard", "section").agg(F.max_by("title", "i").alias("title"))
    shown = items.where(F.col("section").rlike(r"^\d+(?:\.\d+)*$") & (F.trim("body") != "") & (F.col("text") != ""))
    # the titles of all numbers that a section's number begins with
    parts = F.split("section", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    path = shown.select("standard", "section", F.posexplode(above).alias("depth", "number")).join(titles.withColumnRenamed("section", "number"), ["standard", "number"])
    paths = path.groupBy("standard", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "title"))), lambda x: x["title"]), " > ").alias("title_path"))
    size = shown.groupBy("standard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).where((F.col("n") >= LEAST_SECTIONS) & (F.col("chars") <= MOST_CHARS)).select("standard")
    return shown.join(size, "standard", "left_semi").join(paths, ["standard", "section"], "left").select("standard", "section", "text", F.coalesce("title_path", F.lit("")).alias("title_path"))


def edition(pages: DataFrame) -> DataFrame:
    """standard, name, revision, edition_date, machine of pages (standard, html) that state all three; others have status 'unknown'."""
    token = F.replace("standard", F.lit(" "), F.lit(""))
    clicks = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<button[^>]*\sonclick\s*=\s*\"([^\"]*)\""), F.lit(1)), " ")
    called = lambda name, rest: F.concat(F.lit(name + r"\(\s*['\"]"), token, F.lit(rest))
    cell = lambda label: X.clean_space(X.unescape_entities(F.regexp_replace(F.regexp_extract("html", rf"(?is)<th[^>]*>\s*{label}\s*</th>\s*<td[^>]*>(.*?)</td>", 1), r"(?s)<[^>]+>", "")))
    rows = pages.withColumn("clicks", clicks).withColumn("revision", F.call_function("regexp_extract", F.col("clicks"), called("lookup", r"['\"]\s*,\s*['\"](\d+)['\"]"), F.lit(1)))
    rows = rows.withColumn("edition_date", cell("최종개정확인일")).withColumn("name", cell(r"표준명\(한글\)"))
    known = (F.col("revision") != "") & F.col("edition_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("name") != "")
    machine = F.regexp_like("clicks", F.concat(F.lit(r"open3\(\s*['\"]"), token, F.lit(r"['\"]\s*,\s*['\"]"), "revision", F.lit(r"['\"]\s*,\s*['\"]STD['\"]")))
    return rows.select("standard", "name", "revision", "edition_date", F.when(~known, "unknown").when(machine, "machine").otherwise("viewer_only").alias("status"))


@F.pandas_udf(StringType())
def _document_xml(contents: pd.Series) -> pd.Series:
    def read(content):
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                return z.read("word/document.xml").decode("utf-8", "replace")
        except (zipfile.BadZipFile, KeyError):
            return None

    return contents.map(read, na_action="ignore")


def word_outline(files: DataFrame) -> DataFrame:
    """path, source_order (from 1), source_type, outline_level, label, content, context of Word files (path, content), by patterns over
    their XML; only unpacking runs in Python. The context is the path of open headings, a heading's own left out."""
    tag = lambda name: rf"(?s)<w:{name}(?:\s[^>]*)?>.*?</w:{name}>"
    body = files.select("path", _document_xml(F.col("content")).alias("xml")).where("xml IS NOT NULL").withColumn("body", F.coalesce(F.nullif(F.regexp_extract("xml", r"(?s)<w:body.*?</w:body>", 0), F.lit("")), F.col("xml")))
    blocks = body.select("path", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<w:(p|tbl)(?:\s[^>]*)?>.*?</w:\1>"), F.lit(0))).alias("b", "xml"))

    def said(c: Column) -> Column:
        raw = F.array_join(F.regexp_extract_all(c, F.lit(r"(?s)<w:t(?:\s[^>]*)?>(.*?)</w:t>"), F.lit(1)), "")
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")):
            raw = F.replace(raw, F.lit(name), F.lit(char))
        return X.clean_space(raw)

    table = F.col("xml").startswith("<w:tbl")
    lines = F.when(table, F.regexp_extract_all("xml", F.lit(tag("tr")), F.lit(0))).otherwise(F.array("xml"))
    rows = blocks.select("path", "b", table.alias("table"), F.posexplode(lines).alias("r", "xml"))
    cells = F.array_join(F.filter(F.transform(F.regexp_extract_all("xml", F.lit(tag("tc")), F.lit(0)), said), lambda t: t != ""), " | ")
    rows = rows.withColumn("content", F.when(F.col("table"), cells).otherwise(said(F.col("xml")))).where("content <> ''")
    outline = F.regexp_extract("xml", r"(?i)<w:outlineLvl[^>]*w:val=[\"'](\d+)[\"']", 1).try_cast("int") + 1
    style = F.regexp_extract(F.regexp_extract("xml", r"(?i)<w:pStyle[^>]*w:val=[\"']([^\"']+)[\"']", 1), r"(?i)(?:Heading|제목)\s*(\d+)", 1).try_cast("int")
    rows = rows.withColumn("level", F.when(~F.col("table"), F.coalesce(outline, style))).withColumn("level", F.nullif("level", F.lit(0)))
    order = Window.partitionBy("path").orderBy("b", "r")
    rows = rows.withColumn("source_order", F.row_number().over(order))
    upto = Window.partitionBy("path").orderBy("source_order")
    levels = range(1, 10)
    for k in levels:
        rows = rows.withColumn(f"_h{k}", F.last(F.when(F.col("level") == k, F.struct("source_order", "content")), ignorenulls=True).over(upto))
    higher = lambda k: F.greatest(F.lit(0), F.lit(0), *[F.coalesce(F.col(f"_h{j}.source_order"), F.lit(0)) for j in range(1, k)])
    open_ = F.array(*[F.when(F.coalesce(F.col(f"_h{k}.source_order"), F.lit(0)) > higher(k), F.col(f"_h{k}.content")) for k in levels])
    depth = F.array_max(F.transform(open_, lambda t, i: F.when(t.isNotNull(), i + 1).otherwise(0)))
    shown = F.when(F.col("level").isNotNull(), F.col("level") - 1).otherwise(depth)
    context = F.array_join(F.slice(F.transform(open_, lambda t: F.coalesce(t, F.lit(""))), F.lit(1), shown), " > ")
    label = F.when(F.col("table"), F.concat(F.lit("표-"), F.col("source_order").cast("string"))).otherwise(F.trim(F.regexp_extract("content", r"^((?:\d+(?:\.\d+)*|[가-힣]|[A-Za-z])[.)]?)\s+.+$", 1)))
    kind = F.when(F.col("table"), "table").when(F.col("level").isNotNull(), "heading").otherwise("paragraph")
    return rows.select("path", "source_order", kind.alias("source_type"), F.col("level").alias("outline_level"), label.alias("label"), "content", context.alias("context"))


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    """Replace a JSON file at once: it is written beside its place and renamed, so that a reader sees the old one or the new one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    beside = hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    store = hadoop.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(payload, ensure_ascii=False, indent=2).encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    store.rename(fs.makeQualified(beside), fs.makeQualified(target), options)
