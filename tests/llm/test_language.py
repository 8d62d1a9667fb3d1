"""Mixture inference: the maximum against a grid search, and awkward tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from photonest.llm import language


def model():
    rng = random.Random(2)
    syllables = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["tsch", "ung", "lich", "ver"], "cc": ["ción", "ando", "ella", "que"]}
    say = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(n))
    counts = np.zeros((3, language.BUCKETS))
    for i, lang in enumerate(syllables):
        at, n = language.counted(say(lang, 3000))
        counts[i, at] = n
    return language.LanguageModel(list(syllables), counts), say


def test_shares_are_those_of_greatest_likelihood():
    m, say = model()
    for parts in ([("aa", 60)], [("aa", 40), ("bb", 40)], [("aa", 60), ("bb", 20), ("cc", 30)]):
        text = " ".join(say(lang, n) for lang, n in parts)
        got = m.infer(text)
        assert set(got) == {lang for lang, _ in parts} and abs(sum(got.values()) - 1) < 1e-6
        grams, n = language.counted(text)
        p = m.p[grams]
        likelihood = lambda share: float(n @ np.log(np.maximum(p @ share, 1e-300)))
        grid = [np.array([a, b, 100 - a - b]) / 100 for a in range(101) for b in range(101 - a)]
        best = max(grid, key=likelihood)
        mine = np.array([got.get(x, 0.0) for x in m.languages])
        assert np.abs(best - mine).max() < 0.04 and likelihood(mine) >= likelihood(best) - 0.5
        # Of all sets, the chosen one has the least penalised likelihood.
        costs = {}
        for size in range(1, 8):
            chosen = [i for i in range(3) if size >> i & 1]
            top = max((s for s in grid if s[[i for i in range(3) if i not in chosen]].sum() == 0), key=likelihood)
            costs[size] = -2 * likelihood(top) + len(chosen) * np.log(n.sum())
        assert min(costs, key=costs.get) == sum(1 << m.languages.index(x) for x in got)


def test_awkward_tables(spark):
    m, say = model()
    texts = [None, "", "123 !", "\x00", "a", "日本", "😀", say("aa", 30_000), say("bb", 3), say("bb", 3)]
    rows = [(i, t, "aa" if i % 2 else None, "s", "x", "y") for i, t in enumerate(texts)]
    rows += [(100 + i, say("aa", 20) if i % 2 else say("bb", 20), "aa" if i % 2 else "bb", "s", "x", "y") for i in range(60)]
    rows += [rows[7], rows[20], rows[20]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bucket string, mixture string").withColumn("held_out", F.lit(False))
    fitted = language.fit_language_model(df.where("doc_id >= 100"))
    got = language.identify_languages(df, fitted).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], set()).add((r["lang_pred"], r["score"], r["mixture"]))
    assert all(len(x) == 1 for x in found.values())
    assert all(next(iter(found[i]))[:2] == ("und", 0.0) for i in (0, 1, 2, 3, 6)) and next(iter(found[7]))[0] == "aa"
    none = df.limit(0)
    assert language.identify_languages(none, language.fit_language_model(none)).count() == 0
    assert {r["lang_pred"] for r in language.identify_languages(df, language.fit_language_model(none)).collect()} == {"und"}
