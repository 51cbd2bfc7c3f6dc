"""Best-fit packing of tokenised documents into sequences, large items by matching.

A document is its token ids and an end id; only documents longer than a sequence are cut, into full pieces and a rest. The plan
needs nothing but the number of pieces of each length, at most `capacity` numbers: pieces above a third of a sequence are
matched greedily, the longest with the longest partner that still fits, so at most two of them share a sequence; shorter
pieces, longest first, go to the fullest sequences that they still fit into. The plan is a list of runs ("the next n pieces of
this length, c to a sequence, from sequence b on, at this offset"); Spark numbers the pieces of each length and looks up runs.

Defined results: null and empty texts are documents with the end id alone; very long texts give many full pieces; repeated rows
are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm.common import rank_within, small_batches, staged
from lintel.llm.words import give_back, held

#: Text is tokenised in slices of about so many characters, and a worker remembers so many chunks and words.
SLICE_CHARS, MEMO, WORD_MEMO = 1 << 21, 400_000, 300_000
# Fixed values of the vocabulary: how it cuts normalised text into words, and byte-level letters. Below U+0300 normalisation is
# lower-casing letter by letter; text beyond, with a letter whose lower case is two, or with special tokens is left to the library.
WORDS = re.compile(r"\n|'(?:s|t|re|ve|m|ll|d)|[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[\d\u00b2\u00b3\u00b9\u00bc-\u00be]|(?:[^\s\w]|_)+")
UNUSUAL = re.compile("[\x1c-\x1f\u0130\u0300-\U0010ffff]|<\\|")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = [chr(b) if b in _PRINTED else chr(256 + sum(x not in _PRINTED for x in range(b))) for b in range(256)]
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


class _Spans:
    """Numbered keys, each with a run of ids."""

    def __init__(self):
        self.at: dict = {}
        self.flat, self.ends = np.empty(1 << 16, "<u4"), np.zeros(1 << 14, np.int64)

    def index(self, keys: list) -> tuple[np.ndarray, list]:
        """The numbers of keys, and the keys that have none yet, whose places hold a number counted from -1 down."""
        out = np.fromiter(map(self.at.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out, []
        lost = [keys[i] for i in missing.tolist()]
        numbers = {k: -1 - i for i, k in enumerate(dict.fromkeys(lost))}
        out[missing] = np.fromiter(map(numbers.__getitem__, lost), np.int64, len(lost))
        return out, list(numbers)

    def learn(self, index: np.ndarray, keys: list, ids: list | np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """Add keys with their ids (a list a key, or all of them and where each key's end); `index` with the new numbers."""
        if ends is None:
            ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            ids = np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1]))
        n = len(self.at)
        used = int(self.ends[n - 1]) if n else 0
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(keys) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used : used + len(ids)], self.ends[n : n + len(keys)] = ids, used + ends
        self.at.update(zip(keys, range(n, n + len(keys)), strict=True))
        return np.where(index < 0, n - 1 - index, index)

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of keys one after the other, and where each key's end."""
        stop = self.ends[index]
        size = stop - np.where(index > 0, self.ends[index - 1], 0)
        ends = np.cumsum(size)
        return self.flat[np.repeat(stop - ends, size) + np.arange(ends[-1] if len(ends) else 0)], ends


class ChunkTokenizer:
    """Token ids of texts through a memo of white-space-separated chunks, and one of the words that chunks are made of.

    No token of the vocabulary crosses ASCII white space and normalisation never joins chunks, so a text's ids are its chunks' ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks, self.words = _Spans(), _Spans()

    def _words(self, lowered: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks, one a line, and where each ends: words are looked up, or merged by the model itself."""
        found = WORDS.findall(lowered)
        if len(self.words.at) > WORD_MEMO:
            self.words = _Spans()
        index, new = self.words.index(["\n", *found])
        if new:
            merge, letters = self.tokenizer.model.tokenize, BYTE_LETTERS
            spelled = [w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]) for w in new]
            index = self.words.learn(index, new, [[t.id for t in merge(x)] if w != "\n" else [] for w, x in zip(new, spelled, strict=True)])
        ids, ends = self.words.gather(index[1:])
        return ids, ends[np.flatnonzero(index[1:] == index[0])]

    def _learn(self, index: np.ndarray, new: list[bytes]) -> np.ndarray:
        """Plain chunks go together; others take the library's whole way, one by one."""
        texts = b"\n".join(new).decode("utf-8", "replace")
        if not UNUSUAL.search(texts):
            return self.chunks.learn(index, new, *self._words(texts.lower() + "\n"))
        each = [c.decode("utf-8", "replace") for c in new]
        odd = [UNUSUAL.search(t) is not None for t in each]
        ids, ends = self._words("".join(f"{t.lower()}\n" for t, o in zip(each, odd, strict=True) if not o))
        plain = iter(np.split(ids, ends[:-1]) if len(ends) else ())
        return self.chunks.learn(index, new, [self.tokenizer.encode(t, add_special_tokens=False).ids if o else next(plain) for t, o in zip(each, odd, strict=True)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text its ids. Arrow splits the texts and numbers their distinct chunks; only those are looked up."""
        if len(self.chunks.at) > MEMO:
            self.chunks = _Spans()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        coded = split.values.dictionary_encode()
        index, new = self.chunks.index(coded.dictionary.cast(pa.binary()).to_pylist())
        if new:
            index = self._learn(index, new)
        ids, ends = self.chunks.gather(index[coded.indices.to_numpy()])
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first, UTF-8 texts) of runs of texts of about SLICE_CHARS characters."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        run.append((t or "").encode("utf-8", "replace"))
        size += len(run[-1])
        if size >= SLICE_CHARS:
            yield first, run
            first, run, size = i + 1, [], 0
    if run:
        yield first, run


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = held(("packing", tokenizer_path), lambda: ChunkTokenizer(tokenizer_path))
        for n, pdf in enumerate(batches):
            doc_ids = pdf["doc_id"].tolist()
            for first, texts in slices(pdf["text"].tolist()):
                rows = []
                for doc_id, ids in zip(doc_ids[first : first + len(texts)], tok.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k in range(0, len(ids), capacity):
                        part = ids[k : k + capacity]
                        rows.append((doc_id, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out
            if n % 4 == 3:
                give_back()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, pieces per sequence, first sequence, offset) that place every piece."""
    left = {n: c for n, c in counts.items() if c > 0}
    rank: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: runs (first sequence, sequences)
    open_gaps: list[int] = []
    runs, next_bin = [], 0

    def put(length: int, n: int, per: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], n, per, first, offset))
        rank[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((first, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for i, n in enumerate(large):
        for p in large[i:]:
            m = left[n] // 2 if p == n else min(left[n], left[p])
            if n + p <= capacity and m:
                put(n, m, 1, next_bin, 0)
                put(p, m, 1, next_bin, n)
                leave(capacity - n - p, next_bin, m)
                next_bin += m
            if not left[n]:
                break
        if m := left[n]:
            put(n, m, 1, next_bin, 0)
            leave(capacity - n, next_bin, m)
            next_bin += m
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect_left(open_gaps, n)
            if k == len(open_gaps):
                per = capacity // n
                bins = max(1, left[n] // per)
                leave(capacity, next_bin, bins)
                next_bin += bins
                continue
            gap = open_gaps[k]
            first, bins = gaps[gap].pop()
            if not gaps[gap]:
                del open_gaps[k]
            per = min(gap // n, left[n])
            used = min(bins, left[n] // per)
            put(n, used * per, per, first, capacity - gap)
            leave(gap - per * n, first, used)
            leave(gap, first + used, bins - used)
    return runs


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to the rows of a (staged) table of pieces."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = sorted(plan(counts, capacity))
    key = np.array([(n << 44) + r for n, r, *_ in runs], np.int64)
    rest = np.array([x[1:] for x in runs], np.int64).reshape(-1, 5)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            first_rank, _, per, first_bin, offset = rest[np.searchsorted(key, (length << 44) + rank, "right") - 1].T
            k = rank - first_rank
            yield pdf.drop(columns="rank").assign(sequence_id=first_bin + k // per, offset=offset + k % per * length)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    ranked = rank_within(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], rows=sum(counts.values()))
    return ranked.select(*pieces.columns, "rank").mapInPandas(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    packed = pack(staged(pieces_of(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
