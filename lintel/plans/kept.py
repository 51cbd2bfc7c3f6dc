"""References that rows inherit, codes that prefixes allow, and copies that are verified by digests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lintel.operators import backup as B
from lintel.operators import coverage as V
from lintel.operators import impact as M
from lintel.operators import places as L
from lintel.operators.intervals import longest_prefixes
from lintel.operators.segments import inherited_references
from lintel.plans.registry import query, table
from lintel.plans.star import Star
from lintel.session import scratch

#: Lines of a supplier are a document's table rows; those of every other supplier are one document, half of all rows.
ROWS = """SELECT CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE l_suppkey END AS document, l_orderkey * 64 + idx AS place, l_orderkey % 5 AS tab, l_partkey % 200 AS material,
 CASE WHEN l_returnflag = 'R' THEN 5 WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 4 END AS cells, CASE WHEN l_linenumber = 1 THEN CASE WHEN l_tax < 0.05 THEN 'samples' ELSE 'other' END END AS heading,
 'KS ' || CAST(l_partkey % 11 AS VARCHAR) AS codes FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS idx FROM lineitem)"""


@query("J23_inherited_references", f"""WITH r AS ({ROWS}),
h AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY document, tab ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS under,
 list(CASE WHEN cells = 5 THEN codes END) OVER (PARTITION BY document, material ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS given FROM r),
n AS (SELECT document, place, CASE WHEN cells = 5 THEN codes WHEN cells = 4 AND under = 'samples' THEN nullif(array_to_string(list_sort(list_distinct(list_filter(given, lambda x: x IS NOT NULL))), '; '), '') END AS notation FROM h)
SELECT document, place, notation FROM n WHERE notation IS NOT NULL""")
def references(spark, sf_dir):
    """Codes of five-column rows, and those that four-column rows take from them, in documents one of which has half of all rows."""
    lines = table(spark, sf_dir, "lineitem")
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = lines.withColumn("idx", idx).select(
        F.when(F.col("l_suppkey") % 2 == 0, 0).otherwise(F.col("l_suppkey")).cast("long").alias("document"), (F.col("l_orderkey") * 64 + F.col("idx")).alias("place"),
        (F.col("l_orderkey") % 5).alias("table"), (F.col("l_partkey") % 200).alias("material"),
        F.when(F.col("l_returnflag") == "R", 5).when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), 4).alias("cells"),
        F.when(F.col("l_linenumber") == 1, F.when(F.col("l_tax") < 0.05, "samples").otherwise("other")).alias("heading"),
        F.concat(F.lit("KS "), (F.col("l_partkey") % 11).cast("string")).alias("codes"),
    )
    return inherited_references(rows).where("notation IS NOT NULL").select("document", "place", "notation")


CODE = "CASE WHEN p_size % 3 = 0 THEN '070707' ELSE lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR), 6, '0') END"
PREFIXES = """(SELECT n_nationkey AS query, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS prefix FROM nation UNION SELECT n_nationkey, lpad(CAST(n_nationkey * 37 % 1000 AS VARCHAR), 3, '0') FROM nation
 UNION SELECT n_nationkey, lpad(CAST(n_nationkey * 101 AS VARCHAR), 4, '0') FROM nation)"""


@query("J17_longest_prefix", f"""WITH p AS (SELECT p_partkey, {CODE} AS code FROM part), a AS {PREFIXES}
SELECT query, p_partkey, code, arg_max(prefix, length(prefix)) AS prefix FROM p JOIN a ON starts_with(code, prefix) GROUP BY query, p_partkey, code""")
def longest_prefix(spark, sf_dir):
    """Catalogue codes that each nation's prefixes of two to four digits allow, by the longest of them; a third of all codes are equal."""
    key = F.col("p_partkey")
    code = F.when(F.col("p_size") % 3 == 0, "070707").otherwise(F.lpad((key * 7919 % 1000000).cast("string"), 6, "0"))
    n = F.col("n_nationkey").cast("long")
    digits = lambda c, size: F.lpad(c.cast("string"), size, "0")
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query"), F.explode(F.array(digits(n, 2), digits(n * 37 % 1000, 3), digits(n * 101, 4))).alias("prefix"))
    return longest_prefixes(table(spark, sf_dir, "part").select("p_partkey", code.alias("code")), "code", asked.distinct()).select("query", "p_partkey", "code", "prefix")


DAMAGED = """(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 997 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, CASE WHEN o_orderkey % 1499 = 9 THEN NULL ELSE o_orderpriority END AS o_orderpriority
 FROM orders WHERE o_orderkey % 1009 <> 5 UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 2003 = 1)"""


def _copies(spark, sf_dir) -> tuple[str, str]:
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    hurt = orders.where(key % 1009 != 5).withColumn("o_totalprice", F.when(key % 997 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    hurt = hurt.withColumn("o_orderpriority", F.when(key % 1499 != 9, F.col("o_orderpriority")))
    hurt = hurt.unionByName(orders.where(key % 2003 == 1).withColumn("o_orderkey", key + 10_000_000))
    paths = scratch(spark, "good"), scratch(spark, "damaged")
    for rows, path in zip((orders, hurt), paths):
        B.write_copy(rows, "o_orderkey", path)
    return paths


@query("K04_verified_copy", f"""SELECT o_orderkey, CASE WHEN d IS NULL THEN 'added' WHEN g IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT o_orderkey, orders AS g FROM orders) FULL JOIN (SELECT o_orderkey, x AS d FROM {DAMAGED} x) USING (o_orderkey) WHERE g IS DISTINCT FROM d""")
def verified_copy(spark, sf_dir):
    """What has to be done to a damaged copy of the orders: planted changes, found by digests of key ranges."""
    good, damaged = _copies(spark, sf_dir)
    return B.differences(spark, damaged, good, "o_orderkey")


@query("K04_restored", "SELECT * FROM orders")
def restored(spark, sf_dir):
    good, damaged = _copies(spark, sf_dir)
    return B.restored(spark, damaged, good, "o_orderkey")


@query("K04_retention", """SELECT o_custkey AS owner, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
WHERE n > 3 AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 90 DAYS""")
def retention(spark, sf_dir):
    """Orders as copies of their customers: all but the three newest may go once they are 90 days old."""
    copies = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("made"), F.col("o_orderkey").alias("id"))
    return B.pruned(copies, ["owner"], 3, 90, F.lit("1998-01-01").cast("timestamp_ntz")).select("owner", "id")


RUNS = """(SELECT o_custkey AS project, 'r' || (1 + o_orderkey % 2) AS target, max(o_orderkey) AS key FROM orders GROUP BY ALL)"""


@query("I08_published_runs", f"""WITH r AS (SELECT project, target, ['pending', 'running', 'completed', 'failed', 'superseded'][CAST(key % 5 AS INT) + 1] AS status, 's' || (1 + key // 2 % 2) AS snapshot FROM {RUNS}),
p AS (SELECT c_custkey AS project, CASE c_custkey % 3 WHEN 0 THEN 'r1' WHEN 1 THEN 'r2' ELSE '' END AS revision, 's' || (1 + c_custkey % 2) AS snapshot FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0)
SELECT project, target, CASE WHEN target = 'r2' AND status IN ('pending', 'running') THEN 's2' ELSE snapshot END AS snapshot,
 CASE WHEN status IN ('pending', 'running') AND target <> 'r2' OR status = 'running' AND snapshot <> 's2' THEN 'superseded' ELSE status END AS status, target = 'r2' AND status = 'pending' AND snapshot <> 's2' AS requeued FROM r
UNION ALL SELECT project, 'r2', 's2', 'pending', true FROM p WHERE revision <> 'r2' AND NOT (revision = '' AND snapshot = 's2') AND project NOT IN (SELECT project FROM r WHERE target = 'r2')""")
def published_runs(spark, sf_dir):
    """Revision r2 as snapshot s2 is published; customers are projects, the last of their even and odd orders their runs."""
    key = F.col("key")
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project"), F.concat(F.lit("r"), (1 + F.col("o_orderkey") % 2).cast("string")).alias("target")).agg(F.max("o_orderkey").alias("key"))
    states = F.array(*[F.lit(s) for s in ("pending", "running", "completed", "failed", "superseded")])
    runs = runs.select("project", "target", F.concat(F.lit("s"), (1 + F.floor(key / 2) % 2).cast("string")).alias("snapshot"), F.element_at(states, (key % 5).cast("int") + 1).alias("status"), key.cast("string").alias("id"))
    k = F.col("c_custkey")
    projects = table(spark, sf_dir, "customer").select(
        k.alias("project"), F.when(k % 3 == 0, "r1").when(k % 3 == 1, "r2").otherwise("").alias("revision"), F.concat(F.lit("s"), (1 + k % 2).cast("string")).alias("snapshot"), (k % 5 == 0).alias("archived"), F.when(k % 7 == 0, "old").otherwise("v2").alias("parser")
    )
    return M.published(runs, projects, "s2", "r2", "v2").drop("id")


@query("G12_current_coverage", """WITH l AS (SELECT l_orderkey AS clause, l_partkey AS section, l_returnflag AS relation, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS pos FROM lineitem)
SELECT clause, coalesce(list(pos ORDER BY pos) FILTER (section % 6 <> 0), [])[1:3] = coalesce(list(pos ORDER BY pos) FILTER (relation <> 'R'), [])[1:3] AS current FROM l GROUP BY clause""")
def current_coverage(spark, sf_dir):
    """Whether what a clause's coverage was judged on is what it shows now: the same three candidates, in the same order."""
    lines = Star(spark, sf_dir).lines
    held = lines.where("section % 6 <> 0").select("clause", "pos")
    return V.current_coverage(lines.select("clause").distinct(), held, lines.where("relation <> 'R'").select("clause", "pos")).select("clause", "current")


_FLAT = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', ''{1})"


@query("P01_all_places", f"""WITH t AS (SELECT page_id AS doc, list_filter(string_split_regex(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[.!?]\\s+'), lambda s: length({_FLAT.format('s', ", 'g'")}) > 0) AS s FROM pages),
f AS (SELECT doc, list_transform(s, lambda x: {_FLAT.format('x', ", 'g'")}) AS s FROM t),
m AS (SELECT doc, s, array_to_string(CASE WHEN len(s) >= 8 THEN s[4:6] || s[1:3] || s[7:] ELSE s END, '') AS text FROM f),
c AS (SELECT doc, text, i AS ord, s[i] AS said, strpos(text, s[i]) AS p FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM m))
SELECT doc, ord, CASE WHEN once THEN p - 1 END AS start, CASE WHEN once THEN 'found' WHEN length(said) < 8 THEN 'absent' ELSE 'several' END AS status FROM (SELECT *, length(said) >= 8 AND strpos(substr(text, p + 1), said) = 0 AS once FROM c)""")
def all_places(spark, sf_dir):
    """Sentences of each page in a copy in which the fourth to the sixth have floated to the front. Those that stand once are found; of the
    others, which a test holds against a plain search, it is only said that they stand at several places."""
    words = F.split(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "), r"[.!?]\s+")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.filter(words, lambda s: L.letters(s) != "").alias("s"))
    part = lambda a, n: F.slice("s", a, n)
    moved = F.when(F.size("s") >= 8, F.concat(part(4, 3), part(1, 3), F.slice(F.col("s"), F.lit(7), F.greatest(F.size("s") - 6, F.lit(0))))).otherwise(F.col("s"))
    sources = pages.select("doc", F.array_join(moved, " ").alias("text"))
    clauses = pages.select("doc", F.posexplode("s").alias("i", "text")).select("doc", (F.col("i") + 1).cast("long").alias("ord"), "text")
    places = L.find_places(sources, clauses)
    several = F.col("status").isin("repeated", "ambiguous")
    return places.select("doc", "ord", F.when(~several, F.col("start")).alias("start"), F.when(several, "several").when(F.col("status") == "absent", "absent").otherwise("found").alias("status"))
