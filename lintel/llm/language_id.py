"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of order 5 over the letters of words (a word is read from its leading to its closing space). Counts of
n-grams that begin a word are raw, those of other lower orders count distinct left neighbours; every order has its discount
n1 / (n1 + 2 n2). The models are kept in sorted arrays of n-gram hashes: for an order, the hashes that any language has seen, with a
column of log probabilities for each language, and likewise the contexts with their log back-off weights. The language with the
lowest cross-entropy per character is chosen; ties go to the first name.

Texts kept out of the counts calibrate the rest. A language's usual entropy is their median, and by chance it is what the same texts have
with their letters in random order. A text is rejected if it lies nearer to chance than to what is usual, with an allowance for few words
that shrinks with the root of their number; so junk, names or codes in a text don't reject it, and texts of other languages, which models
of letters find about as strange as random letters, are. The score is the posterior of the language, its logits divided by a temperature
and multiplied by a power of the text's length, both fitted to the texts kept out with one wrong label in as many texts assumed; times the
chance that the text is of a learnt language at all, which is one half at the bound. So what is rejected never scores above 0.5.

The models are fitted on a bounded sample of labelled rows: `per_language` documents of each language with the smallest hashes of
their ids. Every document is scored whole.

Defined results: null texts and texts without a letter are `und`, score 0 and rejected; ids may repeat or be null (then not held
out, and not learnt from); with no labelled rows all are `und`; an empty table gives no rows; other columns are kept or, if named like
a result, replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm.common import columns_of, small_batches, unused
from lintel.llm.words import WordMemo, give_back, held, letters, slices, sums, word_lists

ORDER = 5
UND = "und"
#: Deviations of single words that few words are allowed.
ALLOWANCE = 2.0
#: Steepness of the chance that a text is of a learnt language: 0.998 at the usual entropy, 0.5 at the bound.
STEEP = 6.0
POWERS, TEMPERATURES = (0.0, 0.25, 0.5, 0.75, 1.0), np.geomspace(1e-4, 1e4, 161)
PREDICTED = "lang_pred string, score double, rejected boolean, entropy double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of the predicted places of words (letters and the closing space): word number, characters since the word's leading
    space, hashes of the n-grams that end there (n = 1 ..), and hashes of their contexts (n = 1 ..: one character less)."""
    chars = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = np.flatnonzero(chars == 32)
    number = np.repeat(np.arange(len(words)), np.diff(space))
    since = np.arange(1, len(chars)) - space[number]
    hashes = [_mix(chars + np.uint64(1))]
    for n in range(2, ORDER + 1):
        older = np.concatenate([np.zeros(n - 1, np.uint64), chars])[: len(chars)]
        hashes.append(_mix(hashes[-1] * np.uint64(0x9E3779B97F4A7C15) + older + np.uint64(n)))
    contexts = [np.zeros(len(chars) - 1, np.uint64), *(h[:-1] for h in hashes[:-1])]
    return number, since, [h[1:] for h in hashes], contexts


def kneser_ney(counts: Counter[str], alphabet: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """One language: for n = 1 .. ORDER the sorted n-grams with log probabilities, and the sorted contexts with log back-off."""
    words = sorted(counts)
    number, since, hashes, contexts = grams(words)
    weight = np.array([counts[w] for w in words], np.float64)[number]
    probs, backs = [], []
    distinct = []
    for n in range(1, ORDER + 1):
        there = since >= n - 1 if n > 1 else since >= 0
        keys, first, group = np.unique(hashes[n - 1][there], return_index=True, return_inverse=True)
        place = np.flatnonzero(there)[first]
        distinct.append((keys, place, np.bincount(group, weight[there], len(keys))))
    for n in range(1, ORDER + 1):
        keys, place, raw = distinct[n - 1]
        adjusted = raw
        if n < ORDER:
            above = hashes[n - 1][distinct[n][1]]  # the n-grams that longer ones end with, once for each left neighbour
            neighbours = np.bincount(np.searchsorted(keys, above), minlength=len(keys)).astype(np.float64)
            adjusted = np.where((since[place] == n - 1) & (n > 1), raw, np.maximum(neighbours, 1))
        ones, twos = (adjusted == 1).sum(), (adjusted == 2).sum()
        discount = float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones else 0.5
        context, member = np.unique(contexts[n - 1][place], return_inverse=True)
        total, kinds = np.bincount(member, adjusted, len(context)), np.bincount(member, minlength=len(context))
        back = discount * kinds / total
        lower = np.full(len(keys), 1.0 / alphabet) if n == 1 else np.exp(probs[-1][1][np.searchsorted(probs[-1][0], hashes[n - 2][place])])
        p = np.maximum(adjusted - discount, 0) / total[member] + back[member] * lower
        probs.append((keys, np.log(p)))
        backs.append((context, np.log(back)))
    return probs, backs


class LanguageModel:
    """The models of all languages side by side."""

    def __init__(self, words: dict[str, Counter[str]]):
        self.names = sorted(words)
        self.alphabet = len({c for x in words.values() for w in x for c in w}) + 2
        fits = [kneser_ney(words[name], self.alphabet) for name in self.names]
        self.probs = [self._beside([f[0][n] for f in fits]) for n in range(ORDER)]
        self.backs = [self._beside([f[1][n] for f in fits]) for n in range(ORDER)]
        self.temperature, self.power, self.usual = 0.1, 0.0, np.zeros((len(self.names), 3))

    @staticmethod
    def _beside(columns: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in columns]))
        table = np.full((len(keys), len(columns)), np.nan, np.float32)
        for j, (k, v) in enumerate(columns):
            table[np.searchsorted(keys, k), j] = v
        return keys, table

    @staticmethod
    def _find(keys: np.ndarray, table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        out = table[at]
        out[keys[at] != wanted] = np.nan
        return out

    def word_costs(self, words: list[str]) -> np.ndarray:
        """For each word: characters, then nats in each language; zeros for what has no letter."""
        words = list(map(letters, words))
        number, since, hashes, contexts = grams(words)
        start = float(self._find(*self.backs[0], np.zeros(1, np.uint64))[0].max()) - np.log(self.alphabet)
        logp = self._find(*self.probs[0], hashes[0])
        logp = np.where(np.isnan(logp), np.float32(start), logp)
        for n in range(2, ORDER + 1):
            on = np.flatnonzero(since >= n - 1)
            seen = self._find(*self.probs[n - 1], hashes[n - 1][on])
            back = np.nan_to_num(self._find(*self.backs[n - 1], contexts[n - 1][on]), nan=0.0)
            logp[on] = np.where(np.isnan(seen), logp[on] + back, seen)
        ends = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1])
        out = np.empty((len(words), 1 + len(self.names)), np.float32)
        out[:, 0] = np.diff(np.concatenate([ends, [len(number)]]))
        out[:, 1:] = -np.add.reduceat(logp, ends, axis=0)
        out[[not w for w in words]] = 0
        return out

    def entropies(self, texts: list[str | None], memo: WordMemo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters, words, and nats a character in each language, of each text."""
        words, bounds = word_lists(texts)
        if not words:
            return np.zeros(len(texts)), np.zeros(len(texts)), np.zeros((len(texts), len(self.names)))
        index = memo.index(words)
        total = sums(memo.rows[index], bounds)
        return total[:, 0], np.diff(bounds), total[:, 1:] / np.maximum(total[:, :1], 1)

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Fit the temperature and the power of lengths, and for each language the usual entropy, that of chance, and the spread of one word."""
        truth = np.array([self.names.index(x) for x in langs])
        chars, words, nats = self.entropies(texts, WordMemo(self.word_costs))
        ok = chars > 0
        truth, words, nats = truth[ok], words[ok], nats[ok]
        if not len(truth):
            self.usual[:] = (2.0, 2 * np.log(self.alphabet), 2.0)
            return
        lengths = chars[ok]
        rows, wrong, best = np.arange(len(nats)), 1 / (len(nats) + 2), np.inf
        for power in POWERS:
            scaled = -nats * lengths[:, None] ** power
            for t in TEMPERATURES:
                z = scaled / t
                z -= z.max(1, keepdims=True)
                logs = z - np.log(np.exp(z).sum(1, keepdims=True))
                loss = -float(np.mean((1 - wrong) * logs[rows, truth] + wrong * logs.mean(1)))
                if loss < best:
                    best, self.temperature, self.power = loss, float(t), power
        own, chance = nats[rows, truth], self.chance(texts)
        for j in range(len(self.names)):
            some = (truth == j) if (truth == j).any() else np.ones(len(truth), bool)
            mine, count = own[some], np.maximum(words[some], 1)
            middle = float(np.median(mine))
            single = float(np.percentile(np.abs(mine - middle) * np.sqrt(count), 90))
            self.usual[j] = middle, max(chance, middle + 0.5), min(single, 10.0)

    def chance(self, texts: list[str]) -> float:
        """The usual lowest entropy of texts whose letters are dealt out anew to their words."""
        order, mixed = np.random.default_rng(3), []
        for text in texts:
            words = [x for w in word_lists([text])[0] if (x := letters(w))]
            pool = order.permutation(list("".join(words)))
            ends = np.cumsum([len(w) for w in words])
            mixed.append(" ".join("".join(pool[e - len(w) : e]) for w, e in zip(words, ends)))
        chars, _, nats = self.entropies(mixed, WordMemo(self.word_costs))
        return float(np.median(nats.min(1)[chars > 0]))

    def strangeness(self, nats: np.ndarray, lang: np.ndarray, words: np.ndarray) -> np.ndarray:
        """An entropy between what is usual in a language for so many words (0) and the bound of rejection (1)."""
        usual, chance, single = self.usual[lang].T
        return (nats - usual) / ((chance - usual) / 2 + ALLOWANCE * single / np.sqrt(np.maximum(words, 1)))

    def predict(self, texts: list[str | None], memo: WordMemo) -> pd.DataFrame:
        chars, words, nats = self.entropies(texts, memo)
        best = nats.argmin(1) if len(self.names) else np.zeros(len(texts), int)
        z = -nats * np.maximum(chars, 1)[:, None] ** self.power / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        rows, some = np.arange(len(texts)), chars > 0
        lowest = nats[rows, best]
        away = self.strangeness(lowest, best, words)
        learnt = 1 / (1 + np.exp(np.clip(STEEP * (away - 1), -STEEP, 50)))
        return pd.DataFrame({
            "lang_pred": np.where(some, np.array(self.names, object)[best], UND), "score": np.where(some, learnt * z[rows, best] / z.sum(1), 0.0),
            "rejected": ~some | (away > 1), "entropy": np.where(some, lowest, np.nan),
        })


def id_class(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; null ids have none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def sample_labelled(docs: DataFrame, label: str, per_label: int, extra: str | None = None, labels: DataFrame | None = None) -> pd.DataFrame:
    """text and label (and one more column) of at most `per_label` documents of each label, those with the smallest hashes of their ids.

    The label is a column of `docs`, or of `labels` (doc_id and label). Ids are picked first, without texts: a bound on the hash, set
    for each label by its number of ids, leaves about twice as many as are wanted, whatever the number of rows. The texts of the picked
    ids are then read from `docs`, so that no text is moved but theirs; of rows with the same id the one with the smallest hash counts."""
    order = F.xxhash64(F.lit(11), "doc_id")
    ids = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = ids.select("doc_id", F.col(label).alias("_label")) if labels is None else ids.select("doc_id").join(labels.select("doc_id", F.col(label).alias("_label")), "doc_id")
    ids = ids.where(F.col("_label").isNotNull()).select("doc_id", "_label", order.alias("_h"))
    empty = pd.DataFrame({"text": [], "label": []} | ({extra: []} if extra else {}))
    counts = ids.groupBy("_label").agg(F.approx_count_distinct("doc_id").alias("n")).collect()  # one row a label
    if not counts:
        return empty
    kind = (docs if labels is None else labels).schema[label].dataType.simpleString()
    spark = docs.sparkSession
    bounds = [(r["_label"], min(2**63 - 1, int((2 * per_label + 100) / r["n"] * 2**64) - 2**63)) for r in counts]
    bounds = F.broadcast(spark.createDataFrame(bounds, f"_label {kind}, _most long"))
    near = ids.join(bounds, "_label").where(F.col("_h") <= F.col("_most")).select("_label", "_h", "doc_id").distinct()
    picked: dict = {}
    for r in sorted(near.collect(), key=lambda r: (r["_h"], r["doc_id"])):  # about 2 * per_label rows of each label
        of = picked.setdefault(r["_label"], [])
        if len(of) < per_label:
            of.append(r["doc_id"])
    keep = spark.createDataFrame([(i, x) for x, of in picked.items() for i in of], f"doc_id long, _label {kind}")
    more = [F.col(extra).alias("_extra")] if extra else []
    own = [F.col(label).alias("_label")] if labels is None else []
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", *own, *more).join(F.broadcast(keep), ["doc_id", "_label"] if own else ["doc_id"])
    first = F.struct(F.xxhash64("text"), "text")
    got = rows.groupBy("doc_id", "_label").agg(F.min_by(F.struct("text", *(["_extra"] if extra else [])), first).alias("row")).collect()  # as many as were picked
    got.sort(key=lambda r: (r["doc_id"], r["row"]["text"], r["_label"]))
    return pd.DataFrame({"text": [r["row"]["text"] for r in got], "label": [r["_label"] for r in got]} | ({extra: [r["row"]["_extra"] for r in got]} if extra else {}))


def fit(sample: pd.DataFrame, hold: int = 5) -> LanguageModel | None:
    """A model from labelled texts; every hold-th text of a language calibrates instead of being counted."""
    counts: dict[str, Counter[str]] = {}
    kept = ([], [])
    for lang, group in sample.groupby("label"):
        texts = group["text"].tolist()
        apart = [t for i, t in enumerate(texts) if len(texts) >= 2 * hold and i % hold == 0]
        counts[lang] = Counter(x for i, t in enumerate(texts) if len(texts) < 2 * hold or i % hold for w in word_lists([t])[0] if (x := letters(w)))
        kept[0].extend(apart)
        kept[1].extend([lang] * len(apart))
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return None
    model = LanguageModel(counts)
    known = [i for i, x in enumerate(kept[1]) if x in counts]
    model.calibrate([kept[0][i] for i in known], [kept[1][i] for i in known])
    return model


def identify(docs: DataFrame, train: DataFrame | None = None, per_language: int = 800, text_col: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with lang_pred, score, rejected and entropy, names led by `prefix`; columns that bore these names are replaced.

    Learnt from `train` (doc_id, text, lang; `docs` itself if not given)."""
    model = fit(sample_labelled(docs if train is None else train, "lang", per_language))
    fields = [c.split()[0] for c in PREDICTED.split(", ")]
    kept = columns_of(docs, *(f"{prefix}{c}" for c in fields))
    if model is None:
        none = {"lang_pred": F.lit(UND), "score": F.lit(0.0), "rejected": F.lit(True), "entropy": F.lit(None).cast("double")}
        return docs.select(*kept, *(v.alias(f"{prefix}{k}") for k, v in none.items()))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTED)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = held(shared.value, lambda: WordMemo(shared.value.word_costs))
        for texts in batches:
            texts = texts.tolist()
            parts = [shared.value.predict(texts[a:b], memo) for a, b in slices(texts, 1 << 18)]
            yield pd.concat(parts, ignore_index=True) if parts else shared.value.predict([], memo)
            give_back()

    found = unused(docs.columns, "_found")
    return docs.withColumn(found, predict(F.col(f"`{text_col}`"))).select(*kept, *(F.col(f"{found}.{c}").alias(f"{prefix}{c}") for c in fields))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_class(4) == 2, F.lit(False))
    found = identify(docs.select("doc_id", "text"), train=docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected", "entropy")
