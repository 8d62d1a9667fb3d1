"""The near copies of the pipeline against all pairs in plain Python."""

import random

from corpus_pipeline import near
from photonest.llm import simhash, similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    line, out = make(12), [None, "", "  ", "one", "One", "one two three four", "one two three four five"]
    for _ in range(40):
        base = make(rng.randint(5, 150))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
        out.append(" ".join(line + make(rng.randint(0, 30))))
    base = make(100)  # a dense group
    out += [" ".join([*base[:i], rng.choice(words), *base[i + 1 :]]) for i in range(60)]
    rng.shuffle(out)
    return [*enumerate(out), (3, out[3])]


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}

    def top(i):
        return i if group[i] == i else top(group[i])

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and (x == y or x and y and 5 * len(x & y) >= 4 * len(x | y)):
                lo, hi = sorted((top(a), top(b)))
                group[hi] = lo
    return {i: top(i) for i in sets}


def test_stage_drops_every_near_copy(spark, monkeypatch):
    rows = texts()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(5)
    want = expected(rows)
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_classes(df).collect()} == want
    got = near(spark, df, "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows if want[i] == i)
    # The fingerprints of three-word shingles at three bits leave near copies.
    assert simhash.drop_near_duplicates(df).count() > len(got)
    monkeypatch.setattr(similar, "SAMPLE", 7)
    monkeypatch.setattr(similar, "LONG", 2)
    monkeypatch.setattr(similar, "HOT", 3)
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_classes(df).collect()} == want
    assert near(spark, df.limit(0), "").count() == 0
