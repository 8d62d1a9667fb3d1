"""Splitting texts into words that repeat, so that each distinct word is tokenised once.

A split at each space is a split between pieces of the tokenizers' pattern wherever the space is
followed by something other than white space: a piece takes at most the last space before a word.
Texts with white space after a space are split by the pattern itself.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of ``counts`` each, one run after another."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(before - starts, counts)


class WordCache:
    """Token ids of distinct words, laid end to end; beyond ``most`` words the rare ones are forgotten.

    ``encode`` takes strings and gives the ids of all of them end to end, and how many each has.
    """

    def __init__(self, pattern: str, encode, most: int = 600_000) -> None:
        self.find, self.encode, self.most = regex.compile(pattern).findall, encode, most
        self.spaced, self.spaced_no = pa.array([], pa.string()), np.empty(0, dtype=np.int64)  # words after a space
        self.bare: dict[str, int] = {}  # those without
        self.ids = np.empty(0, dtype=np.uint32)
        self.start, self.count, self.hits = (np.empty(0, dtype=np.int64) for _ in range(3))

    def _forget(self) -> None:
        keep = self.hits > 1
        if 2 * int(keep.sum()) > self.most:
            keep[:] = False
        old = np.flatnonzero(keep)
        new_no = np.cumsum(keep) - 1
        stays = keep[self.spaced_no]
        self.spaced, self.spaced_no = self.spaced.filter(pa.array(stays)), new_no[self.spaced_no[stays]]
        self.bare = {w: int(new_no[i]) for w, i in self.bare.items() if keep[i]}
        self.count, starts = self.count[old], self.start[old]
        self.ids = self.ids[ragged(starts, self.count)]
        self.start = np.cumsum(self.count) - self.count
        self.hits = np.zeros(len(old), dtype=np.int64)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Numbers of new words."""
        base = len(self.count)
        ids, counts = self.encode(words)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.hits = np.concatenate([self.hits, np.zeros(len(words), dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids])
        return np.arange(base, base + len(words))

    def _spaced_numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words that follow a space, those not yet known being encoded."""
        place = pc.fill_null(pc.index_in(words, value_set=self.spaced), -1).to_numpy()
        number = np.full(len(words), -1, dtype=np.int64)
        known = place >= 0
        number[known] = self.spaced_no[place[known]]
        if not known.all():
            new = words.filter(pa.array(~known))
            number[~known] = self._learn([" " + w for w in new.to_pylist()])
            self.spaced = pa.concat_arrays([self.spaced, new])
            self.spaced_no = np.concatenate([self.spaced_no, number[~known]])
        self.hits[number] += 1
        return number

    def _bare_numbers(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.bare]
        if new:
            self.bare.update(zip(new, self._learn(new).tolist(), strict=True))
        number = np.fromiter(map(self.bare.__getitem__, words), dtype=np.int64, count=len(words))
        self.hits[number] += 1
        return number

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has. Null is empty."""
        if len(self.count) > self.most:
            self._forget()
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary
        index = words.indices.to_numpy().astype(np.int64)
        size = pc.list_value_length(split).to_numpy().astype(np.int64)
        ends = np.cumsum(size)
        first = ends - size
        doc = np.repeat(np.arange(len(size)), size)
        # White space after a space: the whole text is split by the pattern.
        head = pc.utf8_slice_codeunits(distinct, 0, 1)
        odd = pc.or_(pc.utf8_is_space(head), pc.equal(head, "")).to_numpy(zero_copy_only=False)[index]
        odd[first] = False
        by_pattern = np.unique(doc[odd])
        rest = np.ones(len(index), dtype=bool)
        rest[first] = False
        if len(by_pattern):
            rest &= ~np.isin(doc, by_pattern)
        number = np.zeros(len(distinct), dtype=np.int64)
        wanted = np.zeros(len(distinct), dtype=bool)
        wanted[index[rest]] = True
        used = np.flatnonzero(wanted)
        number[used] = self._spaced_numbers(distinct.take(pa.array(used)))
        at, of = number[index[rest]], doc[rest]
        # First words, and the pieces of texts split by the pattern.
        bare = [[w] if w else [] for w in distinct.take(pa.array(index[first])).to_pylist()]
        for i in by_pattern.tolist():
            bare[i] = self.find(texts[i].as_py())
        flat = list(chain.from_iterable(bare))
        if flat:
            at = np.concatenate([self._bare_numbers(flat), at])
            of = np.concatenate([np.repeat(np.arange(len(bare)), list(map(len, bare))), of])
            order = np.argsort(of, kind="stable")  # a first word comes before the others of its text
            at, of = at[order], of[order]
        counts = self.count[at]
        ids = self.ids[ragged(self.start[at], counts)]
        return ids, np.bincount(of, counts, minlength=len(size)).astype(np.int64)
