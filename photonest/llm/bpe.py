"""Byte-level BPE by corpus-level merge replay, and decoding.

The distinct words of a slice of the corpus are laid end to end as symbols. An inverted index leads
from each merge (token pair) to the positions where it can be applied; merges are taken in rank order
and applied to all their positions at once, and only the pairs of the touched neighbours are looked up
anew. That equals the rank-greedy encoding of each piece by itself: words do not interact, and
overlapping positions are resolved from the left.

A slice is what one task reads at once, and ids of known words are kept from slice to slice, so memory
is bounded and nothing shuffles. Null and empty texts have no ids. Repeated rows get equal ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from photonest.llm.common import map_texts, table
from photonest.llm.pieces import WordCache, ragged

NEVER = np.int64(1 << 40)
DECODED = StructType(
    [StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
)


class Merges:
    """The merges of a rank file and their replay over many words at once."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.find = regex.compile(pattern).findall
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        self.early: set[int] = set()  # tokens whose next merge may rank before the one that made them
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 20) | right] = rank
                    self.early.update(x for x in (left, right) if x > rank and len(self.bytes[x]) > 1)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.size, self.offset = sizes, np.cumsum(sizes) - sizes
        self.buffer = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER if there is none."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NEVER)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct, non-empty pieces end to end, and how many each has."""
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        whole = np.array([self.ranks.get(p, -1) for p in pieces], dtype=np.int64)  # a piece that is a token needs no merges
        n = int(size.sum())
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(pieces)), size)
        symbol = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        alive = np.ones(n, dtype=bool)
        known = whole[word] >= 0
        alive[known] = False
        alive[first[whole >= 0]] = True
        symbol[first[whole >= 0]] = whole[whole >= 0]
        # Neighbours by position; n and -1 stand for the end of a word.
        place = np.arange(n)
        after = np.where((place + 1 < n) & (np.append(word[1:], -1) == word) & ~known, place + 1, n)
        before = np.where(np.append(-1, word[:-1]) == word, place - 1, -1)
        rank = np.full(n + 1, NEVER)
        has = np.flatnonzero(after < n)
        rank[has] = self.rank_of(symbol[has], symbol[after[has]])
        can = np.flatnonzero(rank[:n] < NEVER)
        can = can[np.argsort(rank[can], kind="stable")]
        kinds, starts = np.unique(rank[can], return_index=True)
        # Nothing to merge (whole tokens and single bytes only) leaves no part at all, where split would give an empty one.
        index = {int(r): [p] for r, p in zip(kinds, np.split(can, starts[1:]) if len(can) else [], strict=True)}
        queue = [int(r) for r in kinds]
        heapq.heapify(queue)
        while queue:
            r = heapq.heappop(queue)
            at = index.pop(r, None)
            if at is None:
                continue
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            while True:
                at = at[rank[at] == r]
                if not len(at):
                    break
                back = before[at]
                now = at[(back < 0) | (rank[back] != r)]  # of overlapping positions the leftmost
                if r in self.early:
                    now = now[np.unique(word[now], return_index=True)[1]]
                nxt = after[now]
                symbol[now] = r
                alive[nxt] = False
                rank[nxt] = NEVER
                far = after[nxt]
                after[now] = far
                inner = far < n
                before[far[inner]] = now[inner]
                rank[now] = NEVER
                rank[now[inner]] = self.rank_of(symbol[now[inner]], symbol[far[inner]])
                prior = before[now]
                left = prior[prior >= 0]
                rank[left] = self.rank_of(symbol[left], symbol[after[left]])
                touched = np.concatenate([now, left])
                touched = touched[rank[touched] < NEVER]
                fresh = rank[touched]
                if len(touched):
                    order = np.argsort(fresh, kind="stable")
                    touched, fresh = touched[order], fresh[order]
                    cuts = np.flatnonzero(np.diff(fresh)) + 1
                    for part, k in zip(np.split(touched, cuts), fresh[np.concatenate([[0], cuts])].tolist(), strict=True):
                        if k == r:
                            continue
                        if k in index:
                            index[k].append(part)
                        else:
                            index[k] = [part]
                            heapq.heappush(queue, k)
                    at = np.unique(np.concatenate([at, touched[fresh == r]]))
                if r in self.early and queue and queue[0] < r:
                    index.setdefault(r, []).append(at)
                    heapq.heappush(queue, r)
                    break
        return symbol[alive].astype(np.uint32), np.bincount(word[alive], minlength=len(pieces))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that may hold several pieces each."""
        split = [[w] if w[1:].isalpha() and (w[0] == " " or w[0].isalpha()) else self.find(w) for w in words]
        flat = [p for x in split for p in x]
        distinct = sorted(set(flat))
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        ids, counts = self.encode_pieces([p.encode() for p in distinct]) if distinct else (np.empty(0, np.uint32), np.empty(0, np.int64))
        at = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
        start = np.cumsum(counts) - counts
        ends = np.concatenate([[0], np.cumsum(counts[at])])
        return ids[ragged(start[at], counts[at])], np.diff(ends[np.cumsum([0, *map(len, split)])])

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return self.buffer[ragged(self.offset[ids], self.size[ids])].tobytes()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> tuple[Merges, WordCache]:
    """One per worker and rank file."""
    merges = Merges(path, pattern)
    return merges, WordCache(pattern, merges.encode_words, most=400_000)


def encode_texts(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` with ids as little-endian unsigned 32-bit integers."""
    schema = StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("ids", BinaryType())])

    def kernel(batch: pa.RecordBatch) -> dict:
        ids, counts = codec(path, pattern)[1].encode_texts(batch.column("text"))
        raw = ids.astype("<u4").tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        return {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts), "ids": [raw[a:b] for a, b in zip([0, *ends], ends)]}  # noqa: B905

    return map_texts(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, schema, limit=8 << 20)


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of encoded documents."""

    def kernel(batch: pa.RecordBatch) -> dict:
        merges = codec(path, pattern)[0]
        raw = batch.column("ids").to_pylist()
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": batch.column("n_tokens"),
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in raw],
            "decoded_sha256": [hashlib.sha256(merges.decode(np.frombuffer(x, dtype="<u4"))).hexdigest() for x in raw],
        }

    return map_texts(encoded, kernel, DECODED, text="ids")


def tokenizer_file(name: str) -> tuple[str, str]:
    """Path of a public vocabulary file, and the splitting pattern that goes with it."""
    import public_tokenizers

    return str(public_tokenizers.path(name)), public_tokenizers.PATTERN


def bpe_round_trip(df: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: texts encoded, and decoded again from the ids, in one pass."""
    path, pattern = tokenizer_file(vocabulary)

    def kernel(batch: pa.RecordBatch) -> dict:
        merges, cache = codec(path, pattern)
        ids, counts = cache.encode_texts(batch.column("text"))
        ends = np.cumsum(counts).tolist()
        parts = [ids[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array(counts),
            "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in parts],
            "decoded_sha256": [hashlib.sha256(merges.decode(x)).hexdigest() for x in parts],
        }

    return map_texts(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, DECODED, limit=4 << 20)


def op6_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))
