"""Collocations, decontamination and spelling variants against plain versions on small tables with every edge."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.llm import collocations, decontaminate, spelling

DOC = "doc_id long, text string, lang string"
CLASH = [f"1 AS `{c}`" for c in ("item", "m", "key", "window", "word", "n", "h", "_h", "_text", "class", "first", "phrase", "f", "rank", "a", "root", "run")]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- decontamination


def plain_contamination(docs, items):
    cut = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    windows = defaultdict(set)
    for item, text in items:
        words = cut(text)
        m = min(10, len(words))
        for i in range(len(words) - m + 1 if words else 0):
            windows[tuple(words[i : i + m])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, ids = cut(text), set(), set()
        for m in lengths:
            for i in range(len(words) - m + 1):
                if tuple(words[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    ids |= {str(x) for x in windows[tuple(words[i : i + m])] if x is not None}
        out.append((doc, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def contamination(spark, docs, items):
    d = spark.createDataFrame([(i, t, None) for i, t in docs], DOC).selectExpr("*", *CLASH)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    return sorted((tuple(r) for r in decontaminate.find_contamination(d, b).collect()), key=repr)


def benchmark_and_documents(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") if seed % 2 else rng.choice(["Ab", "ab", "çé", "É", "x1", "y", "z9", "w", "v", "u"])
    text = lambda n: rng.choice([" ", ", ", "-\n"]).join(word() for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 9, 10, 11, 14, 40]) if i % 3 else 12 + i)) for i in range(1, 12)]
    items += [(2, items[3][1]), (None, text(10)), (20, items[0][1]), (21, None), (22, ""), (23, "?!")]
    docs = [(i, text(rng.randrange(60))) for i in range(30)]
    docs += [(100 + i, f"{text(8)} {(items[rng.randrange(len(items))][1] or '').upper()} {text(rng.randrange(12))}") for i in range(25)]
    docs += [docs[40], docs[40], (None, docs[41][1]), (7, None), (8, ""), (9, items[2][1])]
    return docs, [(i, t) for i, t in items]


@pytest.mark.parametrize("seed", range(4))
def test_every_shared_window_is_found(spark, seed):
    docs, items = benchmark_and_documents(seed)
    if seed > 1:  # windows of full length only
        items = [(i, t) for i, t in items if len((t or "").split()) > 9]
    items = [(i, t or None) for i, t in items]
    assert contamination(spark, docs, items) == plain_contamination(docs, items)


def test_windows_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, items = benchmark_and_documents(6)
    assert contamination(spark, docs, items) == plain_contamination(docs, items)


def test_a_long_text_and_no_benchmark(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = [(1, long), (2, "a b"), (3, None)]
    items = [(5, " ".join(f"w{i}" for i in range(59_985, 59_999)))]
    assert contamination(spark, docs, items) == plain_contamination(docs, items)
    assert contamination(spark, docs, []) == plain_contamination(docs, [])
    assert contamination(spark, [], items) == []


# --- collocations


def plain_collocations(docs):
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
            n[lang or "und"] += len(words)
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= 30}
    out = defaultdict(list)
    for (lang, ws), a in found.items():
        score, _, l, r = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        longer = [b for (other, vs), b in found.items() if other == lang and len(vs) > len(ws) and any(vs[i : i + len(ws)] == ws for i in range(len(vs)))]
        if not any(100 * b >= 80 * a for b in longer):
            out[lang].append((-score, -a, " ".join(ws).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:2000], 1))


@pytest.mark.parametrize("seed", range(3))
def test_collocations_equal_plain_counts(spark, seed, monkeypatch):
    if seed == 1:
        monkeypatch.setattr(collocations, "SLICE", 40)
    if seed == 2:  # a set that is nearly full prunes nothing and changes nothing
        monkeypatch.setattr(collocations, "FEWEST_BITS", 64)
        monkeypatch.setattr(collocations, "MOST_BITS", 64)
        monkeypatch.setattr(collocations, "MEMO", 2)
    rng = random.Random(seed)
    words = ["new", "York", "CITY", "É", "é", "of", "the", "a b", "x\x1c", "rare%d"]
    text = lambda: "".join((w := rng.choice(words), w % rng.randrange(900) if "%" in w else w)[1] + rng.choice([" ", " ", "  ", "\t", ". ", "\x0b", ",", " "]) for _ in range(rng.randrange(60)))
    docs = [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(400)] + [("en", None), (None, ""), ("en", "..."), ("fr", "one two three four")] + [("de", "very new York city indeed")] * 45
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(docs)], DOC).selectExpr("*", *CLASH)
    assert sorted(tuple(r) for r in collocations.collocations(df).collect()) == plain_collocations(docs)


def test_collocations_without_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], DOC)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, "one two", "en")], DOC)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, "one. " * 40, "en")], DOC)).collect() == []


def test_hashes_are_those_of_spark(spark):
    pairs = [(5, -7), (0, 0), (2**63 - 1, -(2**63)), (123456789, 987654321)]
    expected = [r[0] for r in spark.createDataFrame(pairs, "a long, b long").select(F.xxhash64("a", "b")).collect()]
    a, b = (np.array([p[i] for p in pairs], np.int64).view(np.uint64) for i in (0, 1))
    assert collocations.joined_hash(a, b).view(np.int64).tolist() == expected
    words = spark.createDataFrame([("en", "größe")], "l string, w string").select(F.xxhash64("l", "w")).first()[0]
    assert np.uint64(collocations.WordHashes(b"en")["größe".encode()]).view(np.int64) == words


def test_scores_beyond_64_bits(spark):
    big = 2**62
    rows = spark.createDataFrame([([big, big - 3], [big - 3, big - 3][::-1])], "begins array<long>, ends array<long>").select(collocations._lowest_cut(2).alias("c")).first()["c"]
    assert rows["score"] == 2_000_000 * (big - 3) // (big + big - 3)


# --- spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    forms = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return sorted(((w, forms[w], root(w), n, len(near[w]), words.get(forms[w])) for w, n in words.items()), key=repr)


@pytest.mark.parametrize("letters, sizes", [("ab", (4, 9)), ("abcdeÉéß", (5, 7)), ("a", (3, 30)), ("xyz÷×", (5, 12))])
def test_variants_equal_all_pairs(spark, letters, sizes):
    rng = random.Random(len(letters))
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(40)]

    def damaged(w):
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
        return w.capitalize() if rng.random() < 0.2 else w

    docs = [(rng.randrange(10**6), " ".join(damaged(rng.choice(base[: rng.randint(1, 40)])) for _ in range(60)) + "1x_y") for _ in range(60)]
    docs += [docs[0], docs[0], (None, docs[1][1]), (5, None), (6, ""), (7, "42 !"), (8, "ab" * 50_000 + " " + ("ab" * 50_000 + "c ") * 4), (8, "ab" * 50_000), (9, "ab" * 50_000)]
    df = spark.createDataFrame([(i, t, None) for i, t in docs], DOC).selectExpr("*", *CLASH)
    got = sorted((tuple(r) for r in spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    assert got == plain_variants(docs)


def test_chains_of_forms_end(spark):
    counts = [("aaaaaaaa"[:i] + "b" * (8 - i), 3 * 2**i) for i in range(9)]
    docs = [(1, " ".join(" ".join([w] * n) for w, n in counts))]
    got = spelling.spelling_variants(spark.createDataFrame([(i, t, None) for i, t in docs], DOC)).collect()
    assert sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got), key=repr) == plain_variants(docs)


def test_no_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOC)).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, "short one", None)], DOC)).collect() == []


def test_a_key_for_every_edit():
    """Each edit of a word leaves one of its keys whole: segments and sub-segments by hand."""
    from itertools import product

    def keys(w, length, longer):
        shift, cut, out = int(longer), length // 2, set()
        for seg, start, whole, edited, size in ((0, 0, cut, cut, length - cut), (1, cut + shift, length - cut, 0, cut)):
            a = w[start : start + whole]
            out |= {(length, seg, 0, a, w[edited : edited + size // 2]), (length, seg, 1, a, w[edited + size // 2 + shift : edited + size + shift])}
        return out

    words = ["".join(w) for n in (5, 6) for w in product("ab", repeat=n)]
    for r in words:
        for s in words:
            if r != s and one_edit(r, s) and len(r) <= len(s):
                assert keys(r, len(r), False) & keys(s, len(r), len(s) > len(r))


def test_words_do_not_pass_through_the_driver(spark, tmp_path):
    """Files of words look small beside the rows made of them."""
    spark.createDataFrame([(f"{a}bcde{b}", 3) for a in "xyz" for b in "xyz"], "word string, n long").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    pairs = spelling.near_pairs(words)
    assert pairs.count() == 18
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().sparkPlan().toString()


# --- the queries, as registered, hold the operators' results on a table of every edge
@pytest.mark.parametrize("name, plain", [("op11_collocations", plain_collocations), ("op12_decontaminate", plain_contamination), ("op13_spelling", plain_variants)])
def test_queries_on_edges(spark, tmp_path, name, plain):
    from lintel.llm import queries

    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["alpha", "alphas", "Beta.", "gamma", "gamme", "delta\t"]) for _ in range(40)), rng.choice(["en", None])) for i in range(60)]
    docs += [(1, None, "en"), (None, docs[0][1], None), (2, "", "de"), docs[3]]
    items = [(1, docs[5][1][20:90]), (2, "beta gamma"), (None, docs[7][1])]
    spark.createDataFrame(docs, DOC).selectExpr("*", *CLASH).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", *CLASH).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    ask = {"op11_collocations": ([(lang, t) for _, t, lang in docs],), "op12_decontaminate": ([(i, t) for i, t, _ in docs], items), "op13_spelling": ([(i, t) for i, t, _ in docs],)}
    assert got == sorted(plain(*ask[name]), key=repr)
