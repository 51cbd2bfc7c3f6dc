"""N-gram Jaccard join on word shingles through a token-group matrix.

1. One pass over the texts gives each document its number of distinct shingles, a key of its whole set and a bitmap of the set;
   documents with equal sets are one class. The pass also counts shingles in a hashed table, which orders them from rare to common.
2. Another pass gives each set's rarest shingles, as many as any linked set must meet in one of them at least (n - ceil(t n) + 1).
   These postings, grouped by shingle, are the matrix: which sets, and later which groups of sets, hold a shingle.
3. Similar sets are partitioned into groups: a set joins the first holder of the shingles that it meets most often, with sets of
   about its size. Thousands of near copies so become one column of the matrix instead of a pair each.
4. Each group's token union is stored as the union of its members' bitmaps. A set and a group that meet in a shingle are a candidate;
   a shingle of the set whose bit the union lacks is in no member, so the set's size less such bits bounds its overlap with any of
   them. Groups whose bound is too low stay closed; only texts of the others move.
5. Members of qualifying groups are opened and compared with the sets that ask. A group of more than a block is first compared with a
   few of its members, and what these connect already is not compared again.
6. Components are those of the verified links.

The table of counts has a fixed size and exact sums: what strangers add to a counter varies by the square root of its mean, so a
shingle is told from rare ones as soon as it is more frequent than that.

The order of shingles and the choice of groups change the work, never the result: two linked sets share a rare shingle, so the one
asks the other's group (or their own). Shingles and sets are known by 64-bit hashes.

Defined results: documents without words (null and empty texts included) have an empty set and are linked with nothing; with fewer
words than a shingle the whole sequence is one; ids may repeat (each row gets its result); the component of a null id is the
smallest id of its links, null if there is none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.llm.common import dropped, small_batches, staged
from lintel.llm.components import connected
from lintel.llm.words import give_back, held, slices

SHINGLE, PERCENT = 5, 80
#: Counters of shingles, and in how many blocks tasks hand theirs in.
COUNTERS, BLOCKS = 1 << 20, 64
#: Holders of a shingle that one window sees; shingles of members, and of queries, that meet in one task; members that a group of more than a block is first compared with.
HOLDERS, MEET, LEADERS = 1 << 16, 1 << 19, 16
#: Bytes whose words are hashed at a time.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.random.default_rng(17).integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ROLL = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _block_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a block that ends in white space."""
    powers = held(("jaccard",), lambda: [np.ones(1, np.uint64)] * 2)  # of the base and its inverse, kept between blocks
    if len(powers[0]) < len(data):
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(len(data) + (1 << 16), base, np.uint64)
            p[0] = 1
            powers[i] = np.cumprod(p)
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(word, prepend=False))  # the last byte is white space, so edges pair up
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * powers[0][: len(data)], out=total[1:])
    return _mixed((total[ends] - total[starts]) * powers[1][starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words begin and the last's end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(data):  # blocks bound memory whatever a text's length; only a single word may exceed one
        end = min(at + BLOCK_BYTES, len(data))
        while not _SPACE[data[end - 1]]:
            end += 1
        h, s = _block_hashes(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted, as int64."""
    words, bounds = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        rolled += words[j : n - k + 1 + j] * _ROLL[j % len(_ROLL)] * np.uint64(2 * (j // len(_ROLL)) + 1) if n >= k else np.uint64(0)
    rolled = _mixed(rolled).astype(np.int64)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes())], np.uint64).astype(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def set_key(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it is linked with."""
    return -(-percent * n // 100)


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts]


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bit for each token in a number of bits that depends on the set's size alone, as 64-bit words; the upper half folds onto the lower."""
    width = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[tokens & (width - 1)] = True
    return np.packbits(bits, bitorder="little").view("<i8")


def summarise(docs: DataFrame, k: int) -> DataFrame:
    """A row per document: doc_id, n, key, text_hash, bits; and rows of hashed counts: block, counts."""
    rest = "text_hash long, bits array<long>, block long, counts binary"

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, done = np.zeros(COUNTERS, np.int32), set()
        for pdf in batches:
            ids, hashes, texts = pdf["doc_id"].astype("Int64"), pdf["text_hash"], pdf["text"].tolist()
            for a, b in slices(texts):
                sets = shingle_sets(_encoded(texts[a:b]), k)
                seen += np.bincount(np.concatenate(sets) & (COUNTERS - 1), minlength=COUNTERS).astype(np.int32)
                keys, bits = [set_key(s) if len(s) else None for s in sets], []
                for key, s in zip(keys, sets, strict=True):  # once a set and task
                    bits.append(None if key is None or key in done else bitmap(s))
                    done.add(key)
                yield pd.DataFrame({"doc_id": ids[a:b].array, "n": [len(s) for s in sets], "key": pd.array(keys, "Int64"), "text_hash": hashes[a:b].array, "bits": bits, "block": pd.array([None] * len(sets), "Int64"), "counts": None})
            give_back()
        if seen.any():
            none = pd.array([None] * BLOCKS, "Int64")
            yield pd.DataFrame({"doc_id": none, "n": 0, "key": none, "text_hash": 0, "bits": None, "block": pd.array(range(BLOCKS), "Int64"), "counts": [zlib.compress(c.tobytes(), 1) for c in seen.reshape(BLOCKS, -1)]})

    return staged(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInPandas(one, f"doc_id long, n long, key long, {rest}"), "sets")


def common_order(summary: DataFrame) -> np.ndarray:
    """The table of hashed counts over all documents: COUNTERS numbers, whatever the data."""

    def add(keys: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS // BLOCKS, "<i8")
        for pdf in batches:
            for c in pdf["counts"]:
                total += np.frombuffer(zlib.decompress(c), np.int32)
        yield pd.DataFrame({"block": [keys[0]], "counts": [total.tobytes()]})

    out = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.int64)
    parts = summary.where("block is not null").select("block", "counts").groupBy("block").applyInPandas(add, "block long, counts binary")
    for r in parts.collect():  # BLOCKS rows
        out[r["block"]] = np.frombuffer(r["counts"], "<i8")
    return out.reshape(-1)


def postings(docs: DataFrame, order: np.ndarray, k: int, percent: int) -> DataFrame:
    """token, key, parts: the rarest shingles of every set, once a set and task; parts is into how many a shingle's holders are dealt."""
    usual = float(order.mean())
    parts = np.minimum(1 + np.maximum(order - 2 * usual, 0) // HOLDERS, 2**31 - 1).astype(np.int32)  # half of the bound, at most, is noise
    by_count = np.argsort(np.argsort(order, kind="stable")).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((by_count, {i: int(parts[i]) for i in np.flatnonzero(parts > 1).tolist()}))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()
        place, many = shared.value
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in slices(texts):
                tokens, keys = [], []
                for s in shingle_sets(_encoded(texts[a:b]), k):
                    key = set_key(s) if len(s) else None
                    if key is None or key in done:
                        continue
                    done.add(key)
                    tokens.append(s[np.lexsort((s, place[s & (COUNTERS - 1)]))[: len(s) - needed(len(s), percent) + 1]])
                    keys.append(np.full(len(tokens[-1]), key))
                if tokens:
                    token = np.concatenate(tokens)
                    spread = [many.get(x, 1) for x in (token & (COUNTERS - 1)).tolist()] if many else 1
                    yield pd.DataFrame({"token": token, "key": np.concatenate(keys), "parts": spread})
            give_back()

    return docs.select("text").where("text is not null").mapInPandas(one, "token long, key long, parts int")


def matrix_of(rows: DataFrame) -> DataFrame:
    """token, key, holder of the shingles that several sets hold, holder being the smallest of them. No task sees all holders of a frequent shingle."""
    part = F.pmod(F.xxhash64("key"), F.col("parts"))
    w = Window.partitionBy("token", "part")
    seen = rows.withColumn("part", part).withColumn("holder", F.min("key").over(w)).withColumn("last", F.max("key").over(w))
    seen = staged(seen.where("holder < last or parts > 1").distinct(), "seen")
    wide = seen.where("parts > 1")
    ends = wide.groupBy("token").agg(F.min("holder").alias("holder"), F.max("last").alias("last")).where("holder < last").select("token", "holder")
    few = seen.where("parts = 1").select("token", "key", "holder")
    out = staged(few.unionByName(wide.select("token", "key").join(ends, "token").select("token", "key", "holder")), "matrix")
    dropped(seen)
    return out


def _folded(bits: Column) -> Column:
    half = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda a, b: a.bitwiseOR(b))


def overlap_bound(n: Column, bits: Column, union: Column) -> Column:
    """No set within the union shares more tokens than this with a set of n tokens; null if their bitmaps are too unlike to tell."""
    q, u = F.size(bits), F.size(union)
    own = F.when(q == 2 * u, _folded(bits)).otherwise(bits)
    theirs = F.when(u == 2 * q, _folded(union)).otherwise(union)
    missing = F.aggregate(F.zip_with(own, theirs, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda s, x: s + x)
    return F.when((q == u) | (q == 2 * u) | (u == 2 * q), n - missing)


def qualifying(found: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of found (key, target) the pairs whose bound reaches the threshold. members: target, member; sets: key, n, bits."""
    words = members.join(sets, members["member"] == sets["key"]).select("target", F.posexplode("bits").alias("at", "word"))
    unions = words.groupBy("target", "at").agg(F.bit_or("word").alias("word"))
    unions = unions.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("tokens"))
    bound = overlap_bound(F.col("n"), F.col("bits"), F.col("tokens"))
    asked = found.join(sets, "key").join(unions, "target")
    return asked.where(F.coalesce(100 * bound >= percent * F.col("n"), F.lit(True))).select("key", "target")


def bodies_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """key, body (a compressed text with that set) of the wanted keys (key, text_hash); a text is less to move than its shingles.

    Texts that cannot be wanted are left out by a bitmap of fixed size before anything moves."""
    bit = F.pmod(F.col("text_hash"), F.lit(1 << 24))
    maps = wanted.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m")).collect()  # 512 rows of 4 KiB; bits count from 1
    bits = np.zeros((1 << 24) // 8, np.uint8).reshape(-1, 4096)
    for r in maps:
        bits[r["b"] - 1] = np.frombuffer(r["m"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()
        for pdf in batches:
            bit = pdf["bit"].to_numpy()
            there = (shared.value[bit >> 3] >> (bit & 7)) & 1 == 1
            texts, hashes = pdf["text"][there].tolist(), pdf["text_hash"][there].tolist()
            for a, b in slices(texts):
                raw, found = _encoded(texts[a:b]), []
                for t, h, s in zip(raw, hashes[a:b], shingle_sets(raw, k), strict=True):
                    if len(s) and h not in done:
                        done.add(h)
                        found.append((set_key(s), h, zlib.compress(t, 6)))
                if found:
                    yield pd.DataFrame(found, columns=["key", "text_hash", "body"])
            give_back()

    read = docs.where("text is not null").withColumn("text_hash", F.xxhash64("text")).select("text", "text_hash", bit.alias("bit")).mapInPandas(one, "key long, text_hash long, body binary")
    return read.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy("text_hash"))).where("_k = 1").select("key", "body")


def verified(docs: DataFrame, roles: DataFrame, summary: DataFrame, k: int, percent: int) -> DataFrame:
    """roles: target, key, n, asks, held. Links a, b that connect every key that asks with all that the target holds which are similar
    enough; what such links of the same task connect already is not linked again."""
    block = lambda role: F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col(role), F.col("n")).otherwise(0)) / MEET)).cast("int")
    sizes = staged(roles.groupBy("target").agg(block("asks").alias("q"), block("held").alias("m"), F.sum("n").alias("n")), "sizes")
    single = (F.col("q") == 1) & (F.col("m") == 1)
    pools = max(1, (sizes.where(single).agg(F.sum("n")).first()[0] or 0) // (2 * MEET))
    # small targets share tasks; a large one has a task for each block of queries and block of members
    pool = F.when(single, F.pmod(F.xxhash64("target"), F.lit(pools))).otherwise(F.col("target"))
    dealt = roles.drop("n").join(sizes.drop("n"), "target").withColumn("pool", pool).withColumn("single", single)
    dealt = dealt.withColumn("x", F.pmod(F.xxhash64("key"), F.col("q"))).withColumn("y", F.pmod(F.xxhash64(F.lit(1), "key"), F.col("m")))
    rows_of = lambda n, make: F.transform(F.sequence(F.lit(0), n - 1), make)
    none = F.array().cast("array<struct<x:bigint,y:bigint>>")
    at = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    places = F.concat(
        F.when(F.col("asks"), rows_of(F.col("m"), lambda j: at(F.col("x"), j))).otherwise(none),
        F.when(F.col("held"), rows_of(F.col("q"), lambda i: at(i, F.col("y")))).otherwise(none),
    )
    routes = dealt.select("key", "target", "pool", "asks", "held", F.col("x").alias("own_x"), F.col("y").alias("own_y"), F.explode(F.array_distinct(places)).alias("at"))
    routes = routes.select("key", "target", "pool", F.col("at.x").alias("x"), F.col("at.y").alias("y"), (F.col("asks") & (F.col("at.x") == F.col("own_x"))).alias("asks"), (F.col("held") & (F.col("at.y") == F.col("own_y"))).alias("held"))
    wanted = summary.where("key is not null").select("key", "text_hash").join(roles.select("key").distinct(), "key", "left_semi")
    moved = bodies_of(docs, wanted, k).join(routes, "key")

    def opened(column: pd.Series) -> list[np.ndarray]:
        texts = [zlib.decompress(x) for x in column]
        return [s for a, b in slices(texts) for s in shingle_sets(texts[a:b], k)]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, rows in pdf.groupby("target"):
            held_here = rows["held"].to_numpy()
            asks = np.flatnonzero(rows["asks"].to_numpy())
            if not held_here.any() or not len(asks):
                continue
            sets_, keys = opened(rows["body"]), rows["key"].to_numpy()
            of = np.flatnonzero(held_here)
            ids = keys[of]
            size = np.array([len(sets_[i]) for i in of])
            flat, owner = np.concatenate([sets_[i] for i in of]), np.repeat(np.arange(len(of)), size)
            by = np.argsort(flat, kind="stable")
            flat, owner = flat[by], owner[by]
            union, first, holders = np.unique(flat, return_index=True, return_counts=True)
            root = np.arange(len(ids))  # of each member, the first that it is connected with here
            place = {m: i for i, m in enumerate(ids.tolist())}
            for i in asks.tolist():
                key, q = keys[i], sets_[i]
                at = np.minimum(np.searchsorted(union, q), len(union) - 1)
                at = at[union[at] == q]
                if len(at) < needed(len(q), percent):  # the bound of this block's union
                    continue
                span = holders[at]
                hit = np.repeat(first[at] - np.cumsum(span) + span, span) + np.arange(span.sum())
                both = np.bincount(owner[hit], minlength=len(ids))
                near = np.flatnonzero((100 * both >= percent * (size + len(q) - both)) & (ids != key))
                if not len(near):
                    continue
                own = place.get(key)
                roots = np.unique(root[near])
                if own is None:
                    links.extend((key, ids[r]) for r in roots)
                else:
                    roots = roots[roots != root[own]]
                    links.extend((key, ids[r]) for r in roots)
                    roots = np.append(roots, root[own])
                if len(roots) > 1:
                    root[np.isin(root, roots)] = roots.min()
        give_back()
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    out = staged(moved.groupBy("pool", "x", "y").applyInPandas(meet, "a long, b long"), "links")
    dropped(sizes)
    return out


def _without_connected(docs: DataFrame, roles: DataFrame, summary: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Groups of more than a block: their members are compared with LEADERS of them first; of what is then connected the largest part
    needs not ask its own group, as its links there are known. Returns the roles that are left and the links so found."""
    own = F.col("held") & F.col("asks")
    large = staged(roles.where("held").groupBy("target").agg(F.sum("n").alias("n"), F.count(F.when(own, 1)).alias("both")).where((F.col("n") > MEET) & (F.col("both") > LEADERS)).select("target"), "large")
    if large.isEmpty():
        return roles, None
    inside = roles.where(own).join(large, "target", "left_semi")
    order = Window.partitionBy("target").orderBy(F.xxhash64(F.lit(3), "key"), "key")
    first = inside.select("target", "key").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= LEADERS).select("target", F.col("key").alias("_leader"))
    first = first.select("target", F.col("_leader").alias("key"), F.lit(True).alias("_leads"))
    asked = inside.select("target", "key", "n").join(first, ["target", "key"], "left")
    links = verified(docs, asked.select("target", "key", "n", F.lit(True).alias("asks"), F.col("_leads").isNotNull().alias("held")), summary, k, percent)
    parts = inside.select("target", "key").join(connected(links).withColumnRenamed("node", "key"), "key")
    counts = parts.groupBy("target", "component").agg(F.count(F.lit(1)).alias("size"))
    most = counts.groupBy("target").agg(F.max_by("component", F.struct("size", "component")).alias("component"))
    known = parts.join(most, ["target", "component"]).select("target", "key", F.lit(True).alias("_known"))
    left = roles.join(known, ["target", "key"], "left").select("target", "key", "n", (F.col("asks") & F.col("_known").isNull()).alias("asks"), "held")
    return staged(left, "roles"), links


def similar_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id, text); and text_hash and component, by which rows of one id that
    lie in different components are told apart (component is null for rows without shingles, which are linked with nothing)."""
    small_batches(docs.sparkSession)
    summary = summarise(docs, k)
    rows = summary.where("block is null").select("doc_id", "n", "key", "text_hash")
    matrix = matrix_of(postings(docs, common_order(summary), k, percent))
    # groups of similar sets: a set joins the first holder that it meets in most of its rare shingles, and sets of its bitmap's width
    stars = matrix.where("key != holder").groupBy("key", "holder").agg(F.count(F.lit(1)).alias("met"))
    best = stars.groupBy("key").agg(F.max_by("holder", F.struct("met", -F.col("holder"))).alias("star"))
    classes = summary.where("key is not null").groupBy("key").agg(F.max("n").alias("n"), F.min("text_hash").alias("text_hash"))
    width = F.ceil(F.log2(2 * F.col("n")))
    grouped = matrix.select("key").distinct().join(best, "key", "left").join(classes, "key")
    grouped = staged(grouped.select("key", "n", "text_hash", F.xxhash64(F.coalesce("star", "key"), F.greatest(F.lit(6), width)).alias("group")), "groups")
    # matrix of shingles and groups
    labelled = staged(matrix.select("token", "key").join(grouped.drop("text_hash"), "key"), "labelled")
    dropped(matrix)
    spans = labelled.groupBy("token", "group").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("held"))
    fits = (100 * F.col("q.n") >= percent * F.col("g.least")) & (100 * F.col("g.most") >= percent * F.col("q.n"))
    # of two groups the smaller asks; alone in its own group a set has nobody to meet there
    asks = (F.col("q.group") < F.col("g.group")) | (F.col("q.group") == F.col("g.group")) & (F.col("g.held") > 1)
    found = labelled.alias("q").join(spans.alias("g"), (F.col("q.token") == F.col("g.token")) & asks & fits).select("q.key", F.col("g.group").alias("target")).distinct()
    found = staged(found, "candidates")
    dropped(labelled)
    members = grouped.select(F.col("group").alias("target"), F.col("key").alias("member")).join(found.select("target").distinct(), "target", "left_semi")
    sets = grouped.select("key", "n").join(summary.where("bits is not null").select("key", "bits"), "key").dropDuplicates(["key"])
    near = staged(qualifying(found, members, sets, percent), "qualifying")
    present = members.join(near.select("target").distinct(), "target", "left_semi").select("target", F.col("member").alias("key"), F.lit(False).alias("asks"), F.lit(True).alias("held"))
    roles = near.select("target", "key", F.lit(True).alias("asks"), F.lit(False).alias("held")).unionByName(present)
    roles = roles.groupBy("target", "key").agg(F.max("asks").alias("asks"), F.max("held").alias("held")).join(grouped.select("key", "n"), "key")
    roles = staged(roles.select("target", "key", "n", "asks", "held"), "roles")
    texts = grouped.select("key", "text_hash")
    roles, known = _without_connected(docs, roles, texts, k, percent)
    links = verified(docs, roles, texts, k, percent)
    final = connected(links if known is None else links.unionByName(known))
    # from sets to documents
    firsts = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first")).join(final.withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("component", "key").alias("label"))
    smallest = firsts.groupBy("label").agg(F.min("first").alias("component_id"))
    by_key = firsts.join(smallest, "label").select("key", "component_id", F.col("label").alias("component"))
    for table in (found, near, roles, grouped, links):
        dropped(table)
    out = rows.join(by_key, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "component")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text_hash", "component")
