"""Language identification as mixture inference.

Each language is a multinomial over hashed character trigrams whose middle is a letter (letters in
lower case, all else a space). A document is a mixture: expectation-maximisation estimates what
share of its trigrams each language made, and languages join the set while the penalised likelihood
(-2 log L + languages * log n, the Bayesian criterion) falls. The prediction is the largest share,
the score is that share.

The models are fitted on a bounded sample: about ``DOCS_PER_LANG`` documents of each language, those
of least id hash. Ties between languages go to the first in code point order. A text that is null or
has no letter, and any text if nothing could be learned, is ``und`` with score 0. Texts are read
whole. Repeated rows get equal results.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from photonest.llm.common import map_texts, table

DOCS_PER_LANG = 2000
BUCKETS = 1 << 15
ROUNDS = 12
SMOOTHING = 0.5


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: itself if a letter, else the space."""
    codes = np.arange(0x110000, dtype=np.uint32)
    return np.where([chr(i).isalpha() for i in range(0x110000)], codes, np.uint32(32))


def trigrams(text: str) -> np.ndarray:
    """Bucket of each trigram of ``text`` that has a letter in the middle."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = _letters()[np.concatenate(([np.uint32(32)], codes, [np.uint32(32)]))]
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(32 - 15))[codes[1:-1] != 32]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    grams = trigrams(text)
    if len(grams) < 1000:
        found, n = np.unique(grams, return_counts=True)
        return found.astype(np.int64), n.astype(np.float64)
    n = np.bincount(grams, minlength=BUCKETS)
    found = np.flatnonzero(n)
    return found, n[found].astype(np.float64)


class LanguageModel:
    """Trigram likelihoods of the learned languages, and the inference of mixtures."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smooth = counts + SMOOTHING
        self.p = (smooth / smooth.sum(axis=1, keepdims=True)).T.copy() if languages else np.empty((BUCKETS, 0))
        self.log_p = np.log(self.p)

    def _shares(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of the languages in the columns of ``p``, and the log likelihood."""
        total = n.sum()
        share = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(ROUNDS):
            mix = p @ share
            now = share * ((n / mix) @ p) / total
            if np.abs(now - share).max() < 1e-4:
                share = now
                break
            share = now
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str | None) -> dict[str, float]:
        """Languages of the chosen set with their shares, largest first; empty if there is nothing to tell."""
        if not text or not self.languages:
            return {}
        grams, n = counted(text)
        if not len(grams):
            return {}
        alone = n @ self.log_p[grams]
        chosen = [int(alone.argmax())]
        penalty = np.log(n.sum())
        best, shares = -2 * alone[chosen[0]] + penalty, np.ones(1)
        if len(self.languages) > 1:
            p = self.p[grams]
            share, _ = self._shares(p, n)
            for extra in np.argsort(-share, kind="stable"):
                if extra in chosen or share[extra] < 1e-3:
                    continue
                tried = [*chosen, int(extra)]
                now, log_l = self._shares(p[:, tried], n)
                if -2 * log_l + len(tried) * penalty >= best:
                    break
                best, chosen, shares = -2 * log_l + len(tried) * penalty, tried, now
        ranked = sorted(zip(chosen, shares.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
        return {self.languages[i]: min(1.0, max(0.0, s)) for i, s in ranked}


def _gram_counts(batch: pa.RecordBatch) -> dict:
    total: dict[str, np.ndarray] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        at, n = counted(text)
        total.setdefault(lang, np.zeros(BUCKETS))[at] += n
    out: dict = {"lang": [], "bucket": [], "n": []}
    for lang, n in total.items():
        at = np.flatnonzero(n)
        out["lang"] += [lang] * len(at)
        out["bucket"] += at.tolist()
        out["n"] += n[at].astype(np.int64).tolist()
    return out


def fit_language_model(df: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> LanguageModel:
    """Fit on ``(doc_id, text, lang)`` rows: about ``docs_per_lang`` documents of each language."""
    rows = df.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((0, BUCKETS)))
    odds = df.sparkSession.createDataFrame([(k, min(1.0, docs_per_lang / n)) for k, n in sizes.items()], "lang string, _odds double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(odds), "lang").where(place < F.col("_odds"))
    schema = StructType([StructField("lang", StringType()), StructField("bucket", IntegerType()), StructField("n", LongType())])
    found = map_texts(sample.select("lang", "text"), _gram_counts, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in found["lang"]] if len(found) < 1000 else np.searchsorted(languages, found["lang"].to_numpy()), found["bucket"]] = found["n"]
    return LanguageModel(languages, counts)


def identify_languages(df: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, mixture)`` for rows ``(doc_id, text, held_out)``."""
    schema = StructType(
        [StructField("doc_id", LongType()), StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("mixture", StringType())]
    )

    def kernel(batch: pa.RecordBatch) -> dict:
        found = [model.infer(t) for t in batch.column("text").to_pylist()]
        return {
            "doc_id": batch.column("doc_id"),
            "held_out": batch.column("held_out"),
            "lang_pred": [next(iter(x), "und") for x in found],
            "score": [next(iter(x.values()), 0.0) for x in found],
            "mixture": [",".join(f"{k}:{v:.4f}" for k, v in x.items()) for x in found],
        }

    return map_texts(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out"), kernel, schema)


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    return identify_languages(docs, fit_language_model(docs.where("not held_out")))
