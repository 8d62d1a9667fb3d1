"""Merge replay against tiktoken: tables of a word, slices without merges, and random texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from photonest.llm import bpe


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, pattern = bpe.tokenizer_file("byte_bpe_multi_50k.tiktoken")
    merges = bpe.Merges(path, pattern)
    return merges, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges.ranks, special_tokens={})


def encoded(merges, *slices):
    cache = bpe.WordCache("unused", merges.encode_words)
    cache.find = merges.find
    out = []
    for texts in slices:
        ids, counts = cache.encode_texts(pa.array(texts, pa.string()))
        ends = np.cumsum(counts).tolist()
        out += [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]  # noqa: B905
    return out


def test_nothing_to_merge(library):
    merges, own = library
    for text in ("a", "the", "!", "\x00", " ", "é"):
        assert encoded(merges, [text]) == [own.encode_ordinary(text)]
    # A later slice whose new words are whole tokens or single bytes.
    for second in (["the"], ["!"], ["a", None, ""], ["\x07"]):
        slices = ["some odd wordzz here"], second
        assert encoded(merges, *slices) == [own.encode_ordinary(t or "") for part in slices for t in part]


def test_random_texts(library):
    merges, own = library
    rng = random.Random(5)
    letters = ["abcdefgh", "aé日ß😀", "  \n\t 　", "0123456789.,", "'sStTvVeErR", "".join(map(chr, range(32, 127)))]
    for _ in range(60):
        slices = []
        for _ in range(3):
            slices.append(["".join(rng.choice(rng.choice(letters)) for _ in range(rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(rng.randint(1, 8))])
        assert encoded(merges, *slices) == [own.encode_ordinary(t) for part in slices for t in part]


def test_one_word_table(spark):
    rows = spark.createDataFrame([(1, "the")], "doc_id long, text string")
    assert [(r["doc_id"], r["n_tokens"]) for r in bpe.bpe_round_trip(rows).collect()] == [(1, 1)]
