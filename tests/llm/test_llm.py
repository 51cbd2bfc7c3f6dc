"""The training-data operators against plain versions of themselves, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lintel.llm import html_text, jaccard, language_id, neighbours, packing, sampled_pieces, sharding, toxicity, warc, winnowing
from lintel.llm.common import rank_within
from lintel.llm.components import connected
from lintel.llm.words import WordMemo, slices

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
EDGES = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n ", None, None, 3), (4, "one", "en", "s", 3), (5, LONG, "de", "s", len(LONG)), (6, "a b c d e f", "en", "s", 11), (6, "a b c d e f", "en", "s", 11), (None, "a b c d e g", "en", "s", 11)]


def edges(spark):
    return spark.createDataFrame(EDGES, DOCS).withColumn("rank", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("key", F.lit("k"))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


# shared


def test_ranks_are_gapless(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 3 == 0).alias("k"))
    got = rank_within(rows, ["k"], ["id"], per_bucket=50).groupBy("k").agg(F.min("rank").alias("a"), F.max("rank").alias("b"), F.count_distinct("rank").alias("n")).collect()
    assert all(r["a"] == 0 and r["b"] + 1 == r["n"] for r in got) and sum(r["n"] for r in got) == 1000


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200 and 300 not in got


# 1 language


def plain_kneser_ney(counts):
    """Probability of a character after a context, straight from the definition, for one language."""
    order = language_id.ORDER
    raw = [Counter() for _ in range(order + 1)]
    for w, c in counts.items():
        s = f" {w} "
        for i in range(1, len(s)):
            for n in range(1, order + 1):
                if i - n + 1 >= 0:
                    raw[n][s[i - n + 1 : i + 1]] += c
    adjusted = [Counter() for _ in range(order + 1)]
    adjusted[order] = raw[order]
    for n in range(1, order):
        left = Counter(g[1:] for g in raw[n + 1])
        for g in raw[n]:
            adjusted[n][g] = raw[n][g] if n > 1 and g[0] == " " else max(1, left[g])
    discount = [0.0] * (order + 1)
    for n in range(1, order + 1):
        ones, twos = sum(v == 1 for v in adjusted[n].values()), sum(v == 2 for v in adjusted[n].values())
        discount[n] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def p(context, c, alphabet, n):
        if n == 0:
            return 1 / alphabet
        h = context[len(context) - n + 1 :] if n > 1 else ""
        if len(h) < n - 1:
            return p(context, c, alphabet, n - 1)
        followers = [v for g, v in adjusted[n].items() if g[:-1] == h]
        lower = p(context, c, alphabet, n - 1)
        if not followers:
            return lower
        return (max(adjusted[n].get(h + c, 0) - discount[n], 0) + discount[n] * len(followers) * lower) / sum(followers)

    return p


def test_word_costs_equal_the_definition():
    counts = Counter({"the": 5, "then": 2, "hat": 1, "that": 3, "a": 4})
    model = language_id.LanguageModel({"x": counts})
    p = plain_kneser_ney(counts)
    for w in ("the", "tha", "zebra", "a", "thenthat"):
        s, cost = f" {w} ", 0.0
        for i in range(1, len(s)):
            cost -= math.log(p(s[:i], s[i], model.alphabet, language_id.ORDER))
        got = model.word_costs([w])[0]
        assert got[0] == len(w) + 1 and got[1] == pytest.approx(cost, rel=1e-4)


def test_probabilities_sum_to_one():
    counts = Counter({"abc": 3, "abd": 1, "bca": 2})
    p = plain_kneser_ney(counts)
    assert sum(p(" ab", c, 5, language_id.ORDER) for c in "abcd ") == pytest.approx(1, abs=1e-6)


def test_languages(spark):
    rng = random.Random(1)
    words = {"en": ["the", "house", "with", "window"], "de": ["das", "haus", "mit", "fenster", "größe"]}
    rows = [(i, prose(rng, words[x], 30), x, "s", 1) for i, x in enumerate(["en", "de"] * 30)]
    docs = spark.createDataFrame(rows + [(900, "1234 %", "en", "s", 1), (901, None, "de", "s", 1), (902, "qxzvk wqxjz " * 20, None, "s", 1)], DOCS)
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert all(got[i]["lang_pred"] == r[2] and not got[i]["rejected"] and 0.5 < got[i]["score"] <= 1 for i, r in enumerate(rows))
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (900, 901))
    assert got[902]["lang_pred"] in ("en", "de")


def test_language_edges(spark):
    got = language_id.identify(edges(spark).drop("score")).collect()
    assert len(got) == len(EDGES) and all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (1, 2, 3))
    assert language_id.identify(empty(spark)).count() == 0


# 2 neighbours


def test_neighbours_recall_ties_and_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[50:150] = x[0]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(700, None, 0), (701, [0.0] * 8, 0), (702, [1.0, None] + [1.0] * 6, 0), (703, [float("nan")] * 8, 0), (704, [1.0], 0), (5, [float(v) for v in x[5]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = neighbours.search(df, df.where("vec_id % 20 = 0"), k=20, leaf_size=40, block=100, per_task=5).toPandas()
    exact = x.astype(np.float64) @ x.T.astype(np.float64)
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g["vec_id"])
        assert np.allclose(g["score"], exact[q, g["vec_id"]])
        assert g.sort_values(["score", "vec_id"], ascending=[False, True])["vec_id"].tolist() == g["vec_id"].tolist()
        order = [i for i in np.lexsort((np.arange(600), -np.round(exact[q], 12))) if i != q][:20]
        hits += len(set(order) & set(g["vec_id"]))
    assert got["query_id"].nunique() == 30 and hits >= 0.9 * 600


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(df, df).orderBy("query_id").collect()] == [(0, 1, 20), (20, 1, 0)]
    assert neighbours.search(df.where("false"), df.where("false")).count() == 0


# 3 Jaccard join


def plain_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_equals_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    common = prose(rng, words, 60)
    rows = []
    for family in range(12):
        base = (common + " " if family % 3 == 0 else "") + prose(rng, words, rng.choice([6, 20, 80, 150]))
        for _ in range(rng.choice([1, 2, 9])):
            w = base.split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.2 else "\t".join(w)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A\nb"), (904, "a"), (905, LONG), (906, LONG + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(docs.select("doc_id", "text", "key")).collect()}
    assert got == plain_components(rows)


def test_jaccard_edges(spark):
    got = jaccard.similar_components(edges(spark).select("doc_id", "text")).collect()
    assert len(got) == len(EDGES) and {r["component_id"] for r in got if r["doc_id"] == 6} == {6}
    assert jaccard.similar_components(empty(spark).select("doc_id", "text")).count() == 0


# 4 sharding


def test_shards_are_even_and_keep_groups(spark):
    rows = [(i, f"text {i // 3}" if i < 90 else "hot" if i < 200 else f"single {i}") for i in range(403)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    counts = got.groupby("shard").size()
    assert len(counts) == 8 and counts.max() - counts.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    text = dict(rows)
    together = got.assign(t=got["doc_id"].map(text)).groupby("t")["shard"].nunique()
    assert (together[[t for t in together.index if t.startswith("text")]] == 1).mean() >= 0.8 and together["hot"] <= 5
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got[["doc_id", "size", "text_crc32"]].itertuples())


def test_shards_take_a_text_of_a_third_of_all_rows(spark):
    n = 24_000
    text = lambda i: "hot" if i < n // 3 else f"pair {i // 2}" if i < n // 3 + n * 3 // 10 else f"single {i}"
    got = sharding.assign_shards(spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id long, text string")).toPandas()
    counts = got.groupby("shard").size()
    assert len(counts) == 8 and counts.max() - counts.min() <= 1
    t = got["doc_id"].map(text)
    hot = got[t == "hot"].groupby("shard").size()
    assert len(hot[hot >= 10]) <= 4 and hot.nlargest(4).sum() >= 0.99 * hot.sum()
    pairs = got[t.str.startswith("pair")]
    assert (pairs.groupby(t)["shard"].nunique() == 1).mean() >= 0.9


def test_shards_of_pairs_only(spark):
    rows = [(i, f"pair {i // 2}") for i in range(8_000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and (got.groupby(got["doc_id"] // 2)["shard"].nunique() == 1).mean() >= 0.9


def test_shard_edges(spark):
    got = sharding.assign_shards(edges(spark)).toPandas()
    assert len(got) == len(EDGES) and got[got.doc_id == 1]["size"].tolist() == [1] and got[["shard", "slot"]].drop_duplicates().shape[0] == len(EDGES)
    assert sharding.assign_shards(empty(spark)).count() == 0


# 5 toxicity


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    words, bad = [f"word{i}" for i in range(200)], ["idiot", "scumbag", "moronic"]
    return [(i, prose(rng, words, 40) + (" " + rng.choice(bad) + " " + prose(rng, words, 5) if i % 4 == 0 else ""), "en" if i % 2 else "de", int(i % 4 == 0)) for i in range(n)]


def test_toxicity_on_held_out_rows(spark):
    rows = spark.createDataFrame(toxic_corpus(600, 5), "doc_id long, text string, lang string, toxic int")
    got = toxicity.classify(rows.select("doc_id", "text"), rows.where("doc_id < 400").drop("toxic"), rows.select("doc_id", "toxic")).join(rows.select("doc_id", F.col("toxic").alias("truth")), "doc_id").where("doc_id >= 400").toPandas()
    assert ((got["toxic"] == 1) == (got["truth"] == 1)).mean() >= 0.97 and got["toxicity"].between(0, 1).all()
    assert ((got["toxicity"] >= 0.7) == (got["toxic"] == 1)).all()


def test_toxicity_edges(spark):
    rows = spark.createDataFrame(toxic_corpus(60, 6), "doc_id long, text string, lang string, toxic int")
    got = toxicity.classify(edges(spark).drop("score"), rows.drop("toxic"), rows).collect()
    assert len(got) == len(EDGES) and all(0 <= r["toxicity"] <= 1 for r in got)
    assert toxicity.classify(empty(spark), rows, rows).count() == 0
    assert {r["toxicity"] for r in toxicity.classify(edges(spark), rows, rows.where("toxic = 0")).collect()} == {0.0}


# 6 WARC


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, "http://c", None), (4, None, ""), (5, "u", "é" * 70_000), (5, "u", "é" * 70_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("path", F.lit("clash"))
    manifest = warc.write_archives(df, str(tmp_path / "w"), roll_bytes=100)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(manifest).collect())
    d = lambda s: warc.digest32(s.encode())
    big = "é" * 70_000
    assert got == [(1, 8, d("<p>x</p>"), "revisit", 2), (2, 8, d("<p>x</p>"), "response", None), (3, 0, d(""), "revisit", 4), (4, 0, d(""), "response", None), (5, 140_000, d(big), "response", None), (5, 140_000, d(big), "response", None)]
    assert warc.quarantined(manifest).count() == 0
    assert warc.read_archives(warc.write_archives(df.where("false"), str(tmp_path / "e"))).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    records = [warc.record_bytes(i, f"http://x/{i}", f"<p>{i}</p>".encode() * 40, compress=compress) for i in range(6)]
    data = b"".join(records)
    rng = random.Random(6)
    assert [w["page_id"] for k, _, _, w in warc.salvage(data) if k == "record"] == list(range(6))
    for _ in range(40):
        victim = rng.randrange(6)
        head = 0 if compress else records[victim].index(b"\r\n\r\n") + 4  # plain headers have no checksum of their own
        at = sum(map(len, records[:victim])) + rng.randrange(head, len(records[victim]))
        damaged = bytearray(data)
        damaged[at] ^= 1 << rng.randrange(8)
        out = list(warc.salvage(bytes(damaged)))
        kept = [w["page_id"] for k, _, _, w in out if k == "record"]
        assert set(kept) >= set(range(6)) - {victim} and kept == sorted(kept)
        assert sum(n for _, _, n, _ in out) == len(data)
    out = list(warc.salvage(b"noise" + data[:-7]))
    assert [k for k, *_ in out] == ["gap"] + ["record"] * 5 + ["gap"] and list(warc.salvage(b"")) == []


# 7 winnowing


def plain_fingerprint(text):
    w = [x for x in re.split(r"[ \t\n\x0B\f\r]+", text) if x]
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in w]
    roll = lambda xs: sum(x * pow(winnowing.BASE, len(xs) - 1 - i, winnowing.PRIME) for i, x in enumerate(xs)) % winnowing.PRIME
    grams = [roll(h[i : i + winnowing.K]) for i in range(len(h) - winnowing.K + 1)] if len(h) >= winnowing.K else [roll(h)] if h else []
    out = []
    for i in range(max(1, len(grams) - winnowing.WINDOW + 1) if grams else 0):
        part = grams[i : i + winnowing.WINDOW]
        p = i + max(j for j, g in enumerate(part) if g == min(part))
        if not out or out[-1] != (grams[p], p):
            out.append((grams[p], p))
    return " ".join(f"{g}@{p}" for g, p in out)


def test_winnowing_equals_the_definition(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, ["a", "b", "cc", "é"], n)) for i, n in enumerate([0, 1, 3, 4, 5, 11, 12, 200])] + [(50, None), (60, "x\x0by\tz"), (None, "first of all"), (7, "a b")]
    got = winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_next", F.lit(1)).drop("_next")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    nexts = {k: (order[(k + 1) % len(order)][1] or "") for k in range(len(order))}
    found = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"] if r["doc_id"] != 7 else -r["n_chars"]))
    for k, (r, (_, t)) in enumerate(zip(found, sorted(order, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or "") if r[0] != 7 else -len(r[1]))), strict=True)):
        t = t or ""
        assert r["n_chars"] == len(t) and r["fingerprint"] == plain_fingerprint(t)
        if r["doc_id"] != 7 and k + 1 < len(found) and found[k + 1]["doc_id"] != 7:
            half = len(t) // 2
            edited = t[: len(t) - half] + nexts[order.index(next(o for o in order if o[0] == r["doc_id"]))][:half]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["edited_fingerprint"] == plain_fingerprint(edited)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_winnowing_over_ranges(spark):
    rows = spark.range(500).select((F.col("id") * 7).alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    ranged = winnowing.with_ranges(rows, rows_per_range=50)
    assert ranged.select("_range").distinct().count() >= 8 and ranged.where("_next").count() == ranged.select("_range").distinct().count()
    got = {r["doc_id"]: r["edited_sha256"] for r in winnowing.fingerprints(rows).collect()}
    assert got[7 * 499] == hashlib.sha256(b"w4" + b"w0").hexdigest() and len(got) == 500
    assert winnowing.fingerprints(rows.where("false")).count() == 0


def test_equal_fingerprints_of_shared_passages():
    rng = random.Random(8)
    shared = prose(rng, [f"v{i}" for i in range(900)], winnowing.K + winnowing.WINDOW - 1)
    a, b = (plain_fingerprint(f"{prose(rng, 'ABCDEFG', 30)} {shared} {prose(rng, 'HIJKLMN', 30)}") for _ in range(2))
    assert {x.split("@")[0] for x in a.split()} & {x.split("@")[0] for x in b.split()}


# 8 SentencePiece

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_sampling_is_lossless_and_reproducible(spark):
    texts = ["  a  b\n\n ▁x \t é\U0001f600   ", " ", "\n", "", None, "word " * 50, "x" * 5000, "日本語 text"]
    s = sampled_pieces.PieceSampler(PIECES)
    once = s.encode(texts, list(range(len(texts))))
    assert [s.decode(x) for x in once] == [t or "" for t in texts]
    again = sampled_pieces.PieceSampler(PIECES).encode(texts[::-1], list(range(len(texts)))[::-1])[::-1]
    assert all((a == b).all() for a, b in zip(once, again, strict=True))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = sampled_pieces.decode(sampled_pieces.encode(docs, PIECES), PIECES).orderBy("doc_id").collect()
    assert [r["decoded"] for r in back] == [t or "" for t in texts] and [r["pieces"] for r in back] == [x.tolist() for x in once]
    assert sampled_pieces.encode(docs.where("false"), PIECES).count() == 0


def test_sampling_follows_the_lattice():
    s = sampled_pieces.PieceSampler(PIECES)
    ways = {}

    def walk(i, weight, ids):
        if i == len(word):
            ways[tuple(ids)] = weight
        for j in range(i + 1, len(word) + 1):
            if hit := s.pieces.get(word[i:j]):
                walk(j, weight * hit[1], [*ids, hit[0]])

    word = " hello"
    walk(0, 1.0, [])
    total, n = sum(ways.values()), 20_000
    seen = Counter(map(lambda x: tuple(x.tolist()), s.encode([word] * n, list(range(n)))))
    for way, c in seen.items():
        p = ways[way] / total
        assert abs(c / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


# 9 packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_chunked_ids_equal_the_library():
    from tokenizers import Tokenizer

    whole, chunked = Tokenizer.from_file(WORDS), packing.ChunkTokenizer(WORDS)
    texts = ["Hello, World's  end!", "a\x1cb c <|endoftext|>x İstanbul ΟΔΟΣ don't I'LL 12²3½", "é ́ ß ẞ ŉ ǅ​", "", "日本語 \x85x", "x" * 3000]
    assert [x.tolist() for x in chunked.encode([t.encode() for t in texts])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    counts = {n: rng.choice([1, 2, 7, 100]) for n in rng.sample(range(1, capacity + 1), min(capacity, 40))}
    runs = packing.plan(dict(counts), capacity)
    used, ranks = defaultdict(list), defaultdict(set)
    for length, rank, n, per, first, offset in runs:
        for k in range(n):
            used[first + k // per].append((offset + k % per * length, length))
            assert rank + k not in ranks[length]
            ranks[length].add(rank + k)
    assert {n: len(r) for n, r in ranks.items()} == counts and all(r == set(range(len(r))) for r in ranks.values())
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * n > capacity for _, n in items) <= 2
    large = sum(c for n, c in counts.items() if 2 * n > capacity)
    assert len(used) <= 1.25 * max(large, math.ceil(sum(n * c for n, c in counts.items()) / capacity)) + 1


def test_packing_edges(spark):
    got = packing.pack_documents(edges(spark), WORDS, capacity=256).toPandas()
    assert (got[got.doc_id.isin([1, 2, 3])]["length"] == 1).all() and len(got[got.doc_id == 6]) == 2
    long = got[got.doc_id == 5].sort_values("piece")
    assert len(long) > 10 and (long["length"][:-1] == 256).all() and (long["start"].diff().dropna() == 256).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 256
    assert packing.pack_documents(empty(spark), WORDS).count() == 0


# 10 HTML


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain, text", "plain, text"), ("<p>a", "a"), ("<p>a&nbsp;&amp;&lt;b&gt; &eacute;&#8364;</p>", "a &<b> é€"),
        ("<script>x<p></script><article><h1>T</h1><p><b>B<br><p>one  two\nthree</p></article><footer>f</footer>", "T\nB\none two three"),
        ("<nav><a href=a>x</a></nav><div class='content'><p>Long enough text, with commas, and words.</p><p>Short.</p></div><div id=sidebar><p>no</p></div><form><p>no</p></form>", "Long enough text, with commas, and words.\nShort."),
        ("<article><p>Body, text.</p><div class='comments'><p>Nice, post, really.</p></div><aside>x</aside><ul><li>a</li><li>b</li></ul></article>", "Body, text.\na\nb"),
        ("<div><div class=cookie-notice>We use cookies, yes.</div><main><p>Main, text here.<p>More</main></div>", "Main, text here.\nMore"),
        ("<article><p>cut off &am", "cut off &am"), ("<article><p>a<!-- <p>hidden</p> -->b</p><style>p{}</style></article>", "ab"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>"), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(pages).orderBy("page_id").collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got] == [(1, "é", 1), (2, "", 0), (2, "", 0)]
    assert html_text.extract(pages.where("false")).count() == 0
    html_text.main_text("<div>" * 20_000 + "deep, text" + "</div>" * 20_000)


# pipeline


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, lang, "s", len(t)) for i, t, lang, _ in toxic_corpus(200, 9)]
    rows += [(1000 + i, rows[1][1] + f" tail{i}", "en", "s", 1) for i in range(3)] + [(2000, None, "en", "s", 0), (2001, "", None, None, 0), (2002, "12 34", "en", "s", 5)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, _, y in toxic_corpus(200, 9)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = set(got["doc_id"])
    assert not kept & {2000, 2001, 2002, 1000, 1001, 1002}
    clean = {i for i, _, _, y in toxic_corpus(200, 9) if not y}
    assert len(kept & clean) >= 0.97 * len(clean) and len(kept - clean) <= 2
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name


def test_words_and_slices():
    assert [b - a for a, b in slices(["a" * 5, None, "b" * 6, "c"], 6)] == [3, 1]
    memo = WordMemo(lambda ws: np.array([[len(w)] for w in ws]), limit=2)
    for words in (["a", "bb"], ["ccc"], ["a", "dddd", "a"]):
        index = memo.index(words)
        assert memo.rows[index][:, 0].tolist() == [len(w) for w in words]
