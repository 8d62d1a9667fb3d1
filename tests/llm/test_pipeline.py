"""The whole pipeline, stage by stage, against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from tests.llm.test_similar import expected

from photonest.llm import bpe, mixing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, h string, taken string, c0 string"


def rows():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [None, "", " ", "the", "!", "a", "Tab\tand\nnew \x0b line", " ".join(make(5000))]
    for _ in range(60):
        base = make(rng.randint(3, 120))
        texts.append(" ".join(base))
        if rng.random() < 0.3:  # a near copy
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
        if rng.random() < 0.3:  # an exact copy but for case
            texts.append(texts[-1].upper() if texts[-1].isascii() else texts[-1])
    clean = len(texts)
    for _ in range(60):
        base = make(rng.randint(10, 60))
        for _ in range(3):
            base[rng.randrange(len(base))] = rng.choice(["vilezz", "vilewort", "blaggard"])
        texts.append(" ".join(base) + ".")
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), None, "k", "s", "h", "t", "c") for i, t in enumerate(texts)]
    labels = [(i, 1, int(i >= clean)) for i in range(len(texts)) if i % 7]
    return [*out, out[20], out[20]], [*labels, labels[3], (None, None, None), (99_999, 1, 1)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = rows()
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def drawn(doc_id, size, seed=17):
    """The seeded hash of the mix: XXH64 over the values' bytes, each with the hash before it as its seed."""
    h = xxhash.xxh64_intdigest(np.int32(seed).tobytes(), 42)
    for v in (doc_id, size):
        h = xxhash.xxh64_intdigest(np.int64(v).tobytes(), h)
    return int(np.uint64(h).view(np.int64))


def plain_mix(docs):
    by_source = defaultdict(list)
    for r in docs:
        by_source[r[3]].append((len((r[1] or "").split()), r))
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    goal = mixing.shared_targets([sum(n for n, _ in by_source[s]) for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2.0)
    out = []
    for s, g in zip(order, goal, strict=True):
        total = sum(n for n, _ in by_source[s])
        full, rest, before = round(g) // total, round(g) % total, 0
        for n, r in sorted(by_source[s], key=lambda x: (drawn(x[1][0], x[0]), x[1][0])):
            taken = full * n + max(0, min(n, rest - before))
            before += n
            out += [r] * int(taken / n + 0.5) if n else []
    return out


def test_every_stage(spark, tables):
    import tiktoken

    docs, _ = rows()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe_encoding"]
    have = spark.read.parquet(f"{tables}/documents.parquet")
    tagger = toxicity.tagger_of(have, spark.read.parquet(f"{tables}/labels.parquet"))

    def step(name, df, want):
        got = stages[name](spark, df, tables)
        assert got.columns == df.columns
        assert Counter(map(tuple, got.collect())) == Counter(want), name
        return spark.createDataFrame(want, df.schema).repartition(3)

    want = [r for r in docs if tagger.score(r[1] or "", tagger.tag(r[1] or "")) < toxicity.THRESHOLD]
    clean = [r for r in docs if "vile" not in (r[1] or "") and "blaggard" not in (r[1] or "")]
    assert set(clean) == set(want)
    now = step("toxicity", have, want)
    last = {}
    for r in want:
        last[lowered(r[1])] = max(last.get(lowered(r[1]), r), r, key=lambda x: x[0])
    want = list(last.values())
    now = step("exact_dedup", now, want)
    group = expected([(r[0], r[1]) for r in want])
    want = [r for r in want if group[r[0]] == r[0]]
    now = step("near_dedup", now, want)
    want = plain_mix(want)
    now = step("mixing", now, want)
    path, pattern = bpe.tokenizer_file("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern)[0].ranks, special_tokens={})
    ids = [np.array(library.encode_ordinary(r[1] or ""), dtype="<u4") for r in want]
    want = [(r[0], len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r, x in zip(want, ids, strict=True)]
    assert Counter(map(tuple, stages["bpe_encoding"](spark, now, tables).collect())) == Counter(want)
    assert Counter(map(tuple, corpus_pipeline.run(spark, tables).collect())) == Counter(want)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
