"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has an edge for every piece of the vocabulary that matches a stretch of it, and byte pieces for characters
without a piece (and for the character that stands for spaces in pieces). Piece probabilities follow the order of the vocabulary
(rank + RANK_SHIFT to the power -1), sharpened by `alpha`. Forward filtering sums the weights of all ways to each place; backward
sampling then draws, from the end, which piece ends there. No piece crosses the limits of segments (a word with its leading space,
a run of further spaces, a line break), so filtering is done once per distinct segment and sampling for all segments at once.
Each draw is a hash of the seed, the row's key and the place in its text: a row's sample is the same wherever and whenever it runs.

Decoding joins pieces and bytes; it gives back the text exactly, white space included.

Defined results: null and empty texts have no pieces and decode to the empty text; rows with equal keys and texts get equal samples;
very long texts and words are encoded whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm.common import small_batches
from lintel.llm.words import held, slices

#: A worker forgets its segments once it holds more of them, or more edges, than this; the second bound holds for texts without spaces.
RANK_SHIFT, MEMO, MEMO_EDGES = 3.0, 400_000, 8_000_000
SEGMENTS = re.compile(r"\n| +(?= [^ \n])| +(?=\n|\Z)| ?[^ \n]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(shorter: np.ndarray | None, chars: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that end at each place, from those of n - 1."""
    if n == 1:
        return _mix(chars + np.uint64(1))
    older = np.concatenate([np.zeros(n - 1, np.uint64), chars])[: len(chars)]
    return _mix(shorter * np.uint64(0x9E3779B97F4A7C15) + older + np.uint64(n))


class PieceSampler:
    def __init__(self, path: str, alpha: float = 1.0, seed: int = 1):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(str(seed)))
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids: list[int] = [0] * 256
        table: list[bytes] = []
        rank = 0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                table.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                table.append(b"")
            else:
                rank += 1
                self.pieces[piece.replace("▁", " ")] = i, (rank + RANK_SHIFT) ** -alpha
                table.append(piece.replace("▁", " ").encode())
        self.longest = max(map(len, self.pieces))
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))]
        for n in range(1, self.longest + 1):
            mine = [(x, v) for x, v in self.pieces.items() if len(x) == n]
            codes = np.array([[ord(c) for c in x] for x, _ in mine], np.uint64).reshape(-1, n)
            h = None
            for k in range(1, n + 1):
                h = _hash(h, codes.reshape(-1), k)
            keys = h.reshape(-1, n)[:, n - 1] if len(mine) else np.zeros(0, np.uint64)
            order = np.argsort(keys)
            self.by_length.append((keys[order], np.array([v[0] for _, v in mine], np.int64)[order], np.log([v[1] for _, v in mine])[order] if mine else np.zeros(0)))
        self.byte_weight = (rank + RANK_SHIFT) ** -alpha / 8
        self.table = np.frombuffer(b"".join(table), np.uint8)
        self.table_size = np.array([len(t) for t in table], np.int64)
        self.table_begin = np.cumsum(self.table_size) - self.table_size
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        #: For each segment the number of the place before its first, and for each place its first edge.
        self.edges, self.starts, self.firsts = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.arrays: list[np.ndarray] | None = None

    def _learn(self, segments: list[str]) -> None:
        """Forward filtering of new segments, all at once: for each place of each, the edges that end there with cumulative probabilities."""
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        start = np.cumsum(size) - size
        level = np.arange(len(chars)) - np.repeat(start, size) + 1
        found, h = [], None
        for n in range(1, self.longest + 1):  # pieces of n characters that end at each place
            at = np.flatnonzero(level >= n)
            if not len(at):
                break
            h = _hash(h, chars, n)
            keys, ids, logs = self.by_length[n]
            k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1) if len(keys) else None
            if k is None:
                continue
            hit = keys[k] == h[at]
            if n == 1:
                single = np.zeros(len(chars), bool)
                single[at[hit]] = True
            found.append((at[hit], np.full(int(hit.sum()), n), ids[k[hit]], logs[k[hit]]))
        spelled = np.flatnonzero(~single | (chars == 0x2581))
        if len(spelled):
            codes, back = np.unique(chars[spelled], return_inverse=True)
            raw = [chr(int(c)).encode("utf-8", "replace") for c in codes]
            packed = np.array([-1 - int.from_bytes(r, "big") for r in raw], np.int64)
            found.append((spelled, np.ones(len(spelled), np.int64), packed[back], (log(self.byte_weight) * np.array([len(r) for r in raw]))[back]))
        place, before, ids, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((before, place, level[place]))
        place, before, ids, weight = place[order], before[order], ids[order], weight[order]
        alpha = np.zeros(len(chars))  # log of the summed weights of all ways to a place
        cum = np.empty(len(place))
        cuts = np.searchsorted(level[place], np.arange(1, int(level.max()) + 2))
        for a, b in zip(cuts, cuts[1:], strict=False):
            node = np.flatnonzero(np.diff(place[a:b], prepend=-1))
            value = weight[a:b] + np.where(before[a:b] < level[place[a:b]], alpha[place[a:b] - before[a:b]], 0.0)
            top = np.maximum.reduceat(value, node)
            width = np.diff(np.append(node, b - a))
            share = np.exp(value - np.repeat(top, width))
            total = np.add.reduceat(share, node)
            alpha[place[a:b][node]] = top + np.log(total)
            run = np.cumsum(share)
            part = (run - np.repeat(run[node] - share[node], width)) / np.repeat(total, width)
            part[np.append(node[1:], b - a) - 1] = 1.0
            cum[a:b] = part
        by_place = np.argsort(place, kind="stable")
        fresh = [cum[by_place], before[by_place].astype(np.int32), ids[by_place]]
        n, m = self.edges, self.edges + len(cum)
        if self.arrays is None or m > len(self.arrays[0]):
            grown = [np.zeros(max(1 << 16, 2 * m), x.dtype) for x in fresh]
            for old, to in zip(self.arrays or (), grown, strict=False):
                to[:n] = old[:n]
            self.arrays = grown
        for x, to in zip(fresh, self.arrays, strict=True):
            to[n:m] = x
        self.at.update(zip(segments, range(len(self.starts), len(self.starts) + len(segments)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.firsts) + start - 1])
        self.firsts = np.concatenate([self.firsts, n + np.searchsorted(place[by_place], np.arange(len(chars)))])
        self.edges = m

    def encode(self, texts: list[str | None], keys: list) -> list[np.ndarray]:
        """A sampled segmentation of each text, as piece ids."""
        if len(self.at) > MEMO or self.edges > MEMO_EDGES:
            self.clear()
        split = [SEGMENTS.findall(t) if t else [] for t in texts]
        flat = [s for x in split for s in x]
        if new := {s for s in flat if s not in self.at}:
            self._learn(sorted(new))
        if not flat:
            return [np.zeros(0, np.int64) for _ in texts]
        cum, before, ids = (x[: self.edges] for x in self.arrays)
        segment = self.starts[np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))]
        length = np.fromiter(map(len, flat), np.int64, len(flat))
        per_text = np.array([len(x) for x in split])
        row = np.repeat(np.arange(len(texts)), per_text)
        ends = np.cumsum(length)  # places in the joined texts
        chars = np.array([len(t) if t else 0 for t in texts])
        text_start = np.cumsum(chars) - chars
        row_key = np.array([xxhash.xxh3_64_intdigest(str(k)) for k in keys], np.uint64) ^ self.seed
        steps, edges = [], []
        left = length.copy()
        active = np.arange(len(flat))
        while len(active):
            place = ends[active] - length[active] + left[active]
            r = row[active]
            draw = _mix(_mix(row_key[r]) + (place - text_start[r]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            u = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.firsts[segment[active] + left[active]]
            over = np.flatnonzero(cum[edge] <= u)
            while len(over):
                edge[over] += 1
                over = over[cum[edge[over]] <= u[over]]
            steps.append(place)
            edges.append(edge)
            left[active] -= before[edge]
            active = active[left[active] > 0]
        place, edge = np.concatenate(steps), np.concatenate(edges)
        order = np.argsort(place, kind="stable")
        place, edge = place[order], edge[order]
        out = ids[edge]
        size = np.ones(len(out), np.int64)
        if (out < 0).any():  # byte pieces, packed into one number
            for i in np.flatnonzero(out < 0).tolist():
                size[i] = max(1, ((-1 - int(out[i])).bit_length() + 7) // 8)
            spread = np.repeat(out, size)
            nth = np.arange(len(spread)) - np.repeat(np.cumsum(size) - size, size)
            value = (-1 - spread) >> np.where(spread < 0, 8 * (np.repeat(size, size) - 1 - nth), 0)
            out = np.where(spread < 0, np.array(self.byte_ids)[value & 255], spread)
        stop = np.cumsum(size)
        cuts = np.concatenate([[0], stop])[np.searchsorted(place, text_start + chars, "right")]
        return np.split(out, cuts[:-1])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        size = self.table_size[ids]
        stop = np.cumsum(size)
        return self.table[np.repeat(self.table_begin[ids] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


def sampler(*parameters) -> PieceSampler:
    return held(("pieces", *parameters), lambda: PieceSampler(*parameters))


def encode(docs: DataFrame, model_path: str, alpha: float = 1.0, seed: int = 1, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with array<int> `pieces`: a segmentation sampled for each row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def sample(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        s = sampler(model_path, alpha, seed)
        for keys, texts in batches:
            keys, texts, out = keys.tolist(), texts.tolist(), []
            for a, b in slices(texts):
                out += s.encode(texts[a:b], keys[a:b])
            yield pd.Series(out, dtype=object)

    return docs.withColumn("pieces", sample(F.col(key_col).cast("string"), F.col(text_col)))


def decode(rows: DataFrame, model_path: str, pieces_col: str = "pieces") -> DataFrame:
    """`rows` with `decoded`, the text that the pieces spell."""

    @F.pandas_udf("string")
    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = sampler(model_path, 1.0, 1)
        for pieces in batches:
            yield pd.Series([s.decode(np.asarray(p, np.int64)) for p in pieces], dtype=object)

    return rows.withColumn("decoded", join(F.col(pieces_col)))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, lossless."""
    import public_tokenizers

    small_batches(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        s = sampler(path, 1.0, 1)
        for pdf in batches:
            ids, texts = pdf["doc_id"].astype("Int64"), pdf["text"].tolist()
            for a, b in slices(texts):
                rows = []
                for text, pieces in zip(texts[a:b], s.encode(texts[a:b], ["" if k is pd.NA else str(k) for k in ids[a:b]]), strict=True):
                    back = s.decode_bytes(pieces)
                    rows.append((len(pieces), zlib.crc32(pieces.astype("<u4").tobytes()), sha256(back).hexdigest(), back == (text or "").encode("utf-8", "replace")))
                out = pd.DataFrame(rows, columns=["n_pieces", "pieces_crc32", "decoded_sha256", "lossless"])
                out.insert(0, "doc_id", ids[a:b].to_numpy())
                yield out.astype({"doc_id": "Int64"})

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInPandas(digest, "doc_id long, n_pieces long, pieces_crc32 long, decoded_sha256 string, lossless boolean")
