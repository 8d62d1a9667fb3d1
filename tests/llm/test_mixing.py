"""Flows against exhaustive search, and mixes of sources that share texts."""

import json
import random
from collections import defaultdict
from itertools import product

from photonest.llm import mixing


def price(steps, n):
    """What n words cost, cheapest steps first; None if there is no room."""
    total = 0
    for words, cost in steps:
        used = min(words, n)
        total, n = total + used * cost, n - used
    return total if n == 0 else None


def exhaustive(supply, arcs, quota):
    """(words, least cost) of the greatest flows."""
    keys, best = sorted(arcs), (0, 0)
    for amounts in product(*(range(min(sum(w for w, _ in arcs[k]), quota[k[1]]) + 1) for k in keys)):
        into, out, cost = defaultdict(int), defaultdict(int), 0
        for (p, s), n in zip(keys, amounts, strict=True):
            into[s] += n
            out[p] += n
            cost += price(arcs[p, s], n)
        if any(into[s] > quota[s] for s in into):
            continue
        prices = [price(supply[p], n) for p, n in out.items()]
        if None not in prices:
            best = min(best, (-sum(amounts), cost + sum(prices)))
    return best


def test_flow_equals_exhaustive_search():
    rng = random.Random(7)
    for _ in range(120):
        sources = "abc"[: rng.randint(2, 3)]
        patterns = [p for n in range(1, 4) for p in [tuple(sorted(rng.sample(sources, min(n, len(sources)))))]]
        supply = {p: [(rng.randint(0, 2), 0), (rng.randint(0, 2), 1), (rng.choice([0, 3]), 2)] for p in patterns}
        arcs = {(p, s): [(rng.randint(0, 2), 0), (rng.randint(0, 1), 1)] for p in supply for s in p}
        quota = {s: rng.randint(0, 4) for s in sources}
        flow = mixing.cheapest_flow(supply, arcs, quota)
        out = defaultdict(int)
        for (p, _), n in flow.items():
            out[p] += n
        cost = sum(price(arcs[k], n) for k, n in flow.items()) + sum(price(supply[p], n) for p, n in out.items())
        assert all(sum(n for (_, s), n in flow.items() if s == x) <= quota[x] for x in sources)
        assert (-sum(flow.values()), cost) == exhaustive(supply, arcs, quota)


def mixed(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(5)
    got = mixing.mix_documents(df, **more).collect()
    assert sorted(got) == sorted(mixing.mix_documents(df.repartition(2), **more).collect())
    own = {i: (t, s) for i, t, s, _ in rows}
    by_source = defaultdict(lambda: [0, 0, 0])
    for r in got:
        x = by_source[own[r["doc_id"]][1]]
        x[0] += r["size"]
        x[1] += r["taken"]
        x[2] = r["target"]
        assert r["size"] == len((own[r["doc_id"]][0] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
    for size, taken, target in by_source.values():
        assert abs(taken - target) <= 1 and target <= 2 * size
    return got, own


def test_shared_texts(spark):
    rng = random.Random(3)
    say = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 30)))
    rows = [(i, say(), rng.choice(["s1", "s2", "s3", None]), "x") for i in range(150)]
    rows += [(1000 + 10 * i + j, text, source, "x") for i in range(60) for text in [say()] for j, source in enumerate(rng.sample(["s1", "s2", "s3", None], rng.randint(2, 3)))]
    rows += [(5000 + i, "one text in many copies", rng.choice(["s1", "s2"]), "x") for i in range(300)]
    rows += [(9000, None, "s1", "x"), (9001, "", None, "x"), rows[0], rows[0]]
    for more in ({}, {"docs_per_bucket": 3}, {"max_patterns": 2}, {"max_patterns": 0}):
        mixed(spark, rows, **more)


def test_sources_take_different_texts_while_there_are_any(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(20)) + f" {i}" for i in range(400)]
    rows = [(2 * i + j, t, f"s{j}", "x") for i, t in enumerate(texts) for j in (0, 1)]
    # Each source wants a quarter of the texts, which all stand in both.
    got, own = mixed(spark, rows, weights=(1, 1), share=0.25)
    uses = defaultdict(int)
    for r in got:
        assert r["pattern"] == '["s0","s1"]'
        uses[own[r["doc_id"]][0]] += r["taken"] > 0
    assert sum(n > 1 for n in uses.values()) <= 2
    # With a source of its own texts beside it, the shared ones are left to who has nothing else.
    rows = [(i, t, "s0", "x") for i, t in enumerate(texts[:100])] + [(1000 + i, t, "s1", "x") for i, t in enumerate(texts[:100])] + [(2000 + i, t, "s1", "x") for i, t in enumerate(texts[100:])]
    got, own = mixed(spark, rows, weights=(1, 1), share=0.4)
    shared = sum(r["taken"] for r in got if own[r["doc_id"]][1] == "s1" and r["pattern"] != '["s1"]')
    assert shared == 0


def test_mix_without_words(spark):
    assert {r["taken"] for r in mixed(spark, [(1, None, "a", "x"), (2, " ", None, "x")])[0]} == {0}
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_documents(empty).count() == 0 and mixing.take_mix(empty).count() == 0


def test_every_pattern_takes_part(spark):
    """More patterns than were once let in: sources in many combinations, of which none is taken apart."""
    rng = random.Random(8)
    rows = []
    for i in range(2300):
        sources = sorted(f"s{j:02d}" for j in range(12) if (i + 3 >> j) & 1)
        text = " ".join(rng.choice("abcdefgh") for _ in range(1 + i % 3)) + f" {i}"
        rows += [(100 * i + j, text, s, "x") for j, s in enumerate(sources)]
    got, own = mixed(spark, rows, share=0.3)
    holders = defaultdict(set)
    for _, t, s, _ in rows:
        holders[t].add(s)
    assert len({tuple(sorted(x)) for x in holders.values() if len(x) > 1}) > 2000
    assert all(r["pattern"] == json.dumps(sorted(holders[own[r["doc_id"]][0]]), separators=(",", ":")) for r in got)
    got, own = mixed(spark, rows[:2000], max_patterns=1)
    assert all(json.loads(r["pattern"]) == sorted(s for _, t, s, _ in rows[:2000] if t == own[r["doc_id"]][0]) for r in got)
