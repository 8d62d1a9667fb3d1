"""Toxic spans by a linear-chain conditional random field.

The field has two states, emission weights for words, prefixes and upper case, and transition weights.
Labels tell only which documents are toxic, so the labels of tokens are hidden: a clean document's tokens
are all of state 0, and of a toxic document's at least one is of state 1. The field is trained by gradient
ascent on the penalised likelihood of that (with a small chance that a label is wrong); forward-backward
gives the expectations. Candidates for weights are words and prefixes that toxic documents have more often
than clean ones by a likelihood-ratio test; a feature of clean documents too gets what weight the training
leaves it. All pieces of all sampled documents take part.

Forward-backward gives each token's marginal; runs of marginals of 0.5 or more are the offending spans
(code point offsets). A logistic curve over the largest marginal, the number and the sum of those over 0.05
and that sum against the length gives the document's score; it is fitted on documents that its field has
not seen (two halves).

Labels are learned from a bounded sample: about ``DOCS_PER_CLASS`` labelled documents and ``BYTES_PER_CLASS``
bytes of text of each class, those of least id hash. Every text is scored whole. A sentence
is skipped only where its marginals are known to stay under 0.05: if its largest emission throughout a
chain would not reach that (marginals of an attractive chain grow with every emission). A null or empty text, and any text if there is nothing to learn
from, gets the score of a text without offending tokens. Repeated rows get equal scores. Other columns never
take part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from photonest.llm.common import map_texts, slices, table
from photonest.session import materialize

DOCS_PER_CLASS = 2000
BYTES_PER_CLASS = 16 << 20
THRESHOLD = 0.7
#: Tokens of a training chain; longer sentences are cut into such pieces for training only.
CHAIN = 24
#: Prefix lengths that serve as features beside the whole word.
PREFIXES = (3, 4, 5, 6, 7)
#: Likelihood-ratio test that a feature must pass to be a candidate, and the most candidates (those of highest tests).
LEAST_TEST, MOST_FEATURES = 25.0, 20_000
#: Chance that a document's label is wrong.
DOUBT = 0.05
#: Marginals that count.
FLOOR = 0.05
_WORD = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.!?\n]")


def features(word: str) -> list[str]:
    """The word itself (marked by ``=``) and its prefixes."""
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


def _ratio_test(k: int, n: int, c: int, m: int) -> float:
    """Twice the log likelihood ratio of k in n against c in m; 0 if k is not the more frequent."""
    if k * m <= c * n:
        return 0.0
    q = (k + c) / (n + m)
    cells = ((k, q * n), (c, q * m), (n - k, (1 - q) * n), (m - c, (1 - q) * m))
    return 2 * sum(o * math.log(o / e) for o, e in cells if o > 0 and e > 0)


def candidate_features(toxic: list[list[str]], clean: list[list[str]]) -> dict[str, float]:
    """Features that mark toxic documents with their log odds, given the words of each document in order.

    A feature counts once for each different pair of neighbours in a toxic text, so that near copies of
    one text support nothing.
    """
    n, m = len(toxic), len(clean)
    distinct = [[list(set(words)) for words in x] for x in (toxic, clean)]
    base: dict[str, int] = {}
    seen: dict[str, int] = {}
    for i in range(1 + len(PREFIXES)):  # one kind of feature at a time, for memory
        size = PREFIXES[i - 1] if i else 0
        counts = [Counter(chain.from_iterable({w[:size] if size else "=" + w for w in words if len(w) >= size} for words in x)) for x in distinct]
        likely = {f for f, k in counts[0].items() if k >= 3 and _ratio_test(k, n, counts[1][f], m) >= LEAST_TEST}
        seen |= {f: counts[0][f] for f in likely}
        base |= {f: counts[1][f] for f in likely}
    likely = set(seen)
    around: dict[str, set] = {f: set() for f in likely}
    marks = {w: found for w in set(chain.from_iterable(distinct[0])) if (found := [f for f in features(w) if f in likely])}
    for words in toxic:
        for i, w in enumerate(words):
            for f in marks.get(w, ()):
                around[f].add((words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))
    tests = []
    for f in likely:
        k = min(seen[f], len(around[f]))
        test = _ratio_test(k, n, base[f], m)
        if k >= 3 and test >= LEAST_TEST:
            tests.append((-test, f, math.log((k + 0.5) / (n + 1)) - math.log((base[f] + 0.5) / (m + 1))))
    return {f: odds for _, f, odds in sorted(tests)[:MOST_FEATURES]}


def sentences(text: str) -> list[list[re.Match]]:
    """Tokens of each sentence."""
    out: list[list[re.Match]] = [[]]
    last = 0
    for m in _WORD.finditer(text):
        if out[-1] and _STOP.search(text, last, m.start()):
            out.append([])
        out[-1].append(m)
        last = m.end()
    return [x for x in out if x]


def batch_marginals(emit: np.ndarray, trans: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded chains with log-odds ``emit`` [chains, tokens]: marginals of state 1, pair marginals summed along each chain, log of the sum over all paths."""
    chains, n = emit.shape
    live = np.arange(n)[None, :] < length[:, None]
    up = np.exp(trans)
    odds = np.exp(np.clip(emit, -30, 30))
    forward = np.zeros((n, 2, chains))
    backward = np.ones((n, 2, chains))
    forward[0] = np.stack([np.ones(chains), odds[:, 0]])
    total = forward[0].sum(axis=0)
    forward[0] /= total
    log_z = np.log(total)
    for t in range(1, n):
        step = up.T @ forward[t - 1]
        step[1] *= odds[:, t]
        total = step.sum(axis=0)
        log_z += np.where(live[:, t], np.log(total), 0.0)
        forward[t] = np.where(live[:, t], step / total, forward[t - 1])
    for t in range(n - 2, -1, -1):
        ahead = backward[t + 1].copy()
        ahead[1] *= odds[:, t + 1]
        step = up @ ahead
        step /= step.sum(axis=0)
        backward[t] = np.where(live[:, t + 1], step, 1.0)
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2, chains))
    for t in range(1, n):
        ahead = backward[t].copy()
        ahead[1] *= odds[:, t]
        joint = forward[t - 1][:, None] * up[:, :, None] * ahead[None, :]
        pairs += np.where(live[:, t], joint / joint.sum(axis=(0, 1)), 0.0)
    return both[:, 1].T * live, pairs.transpose(2, 0, 1), log_z


def chain_marginals(emit: list[float], trans: np.ndarray) -> list[float]:
    """Marginals of state 1 along one chain of any length, by scaled forward-backward."""
    (t00, t01), (t10, t11) = np.exp(trans).tolist()
    odds = [math.exp(max(-30.0, min(30.0, e))) for e in emit]
    ahead = []
    a, b = 1.0, odds[0]
    for i, o in enumerate(odds):
        if i:
            a, b = a * t00 + b * t10, (a * t01 + b * t11) * o
        a, b = a / (a + b), b / (a + b)
        ahead.append(b)
    out = [0.0] * len(odds)
    a, b = 1.0, 1.0
    for i in range(len(odds) - 1, -1, -1):
        p, q = (1 - ahead[i]) * a, ahead[i] * b
        out[i] = q / (p + q)
        b *= odds[i]
        a, b = a * t00 + b * t01, a * t10 + b * t11
        a, b = a / (a + b), b / (a + b)
    return out


class SpanTagger:
    """Log-odds weights of the features for state 1 (toxic) against 0, a bias, upper case, and transitions."""

    #: Words whose weights a worker remembers before it starts afresh.
    REMEMBER = 400_000

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.weight = np.zeros(2)
        self.trans = np.zeros((2, 2))
        self.curve = np.array([-4.0, 0.0, 0.0, 0.0, 0.0])
        self.quiet = -math.inf
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def _active(self, token: str) -> tuple[int, ...]:
        """Weights that a token adds up beside the bias (0); 1 is upper case."""
        own = tuple(self.ids[f] for f in features(token.lower()) if f in self.ids)
        return (1, *own) if own and token.isupper() and len(token) > 1 else own

    def _chains(self, text: str, known: dict[str, tuple[int, ...]]) -> Counter:
        """The text's pieces by what their tokens add up, and how often each occurs; a piece without features is its length."""
        out: Counter = Counter()
        for s in _STOP.split(text):
            words = _WORD.findall(s)
            for at in range(0, len(words), CHAIN):
                row = []
                for w in words[at : at + CHAIN]:
                    own = known.get(w)
                    if own is None:
                        own = known[w] = self._active(w)
                    row.append(own)
                out[tuple(row) if any(row) else len(row)] += 1
        return out

    def fit(self, toxic: list[str], clean: list[str], curve: bool = True) -> SpanTagger:
        """Learn from the texts of toxic and of clean documents; equal texts count once."""
        toxic, clean = (sorted(set(x)) for x in (toxic, clean))
        if curve:  # each half is judged by the field of the other
            halves = [[x[i::2] for x in (toxic, clean)] for i in (0, 1)]
            seen = [SpanTagger().fit(*halves[1 - i], curve=False)._summaries(*halves[i]) for i in (0, 1)]
        once: dict[str, str] = {}  # each word is held once, however often it occurs
        odds = candidate_features(*[[[once.setdefault(w, w) for w in _WORD.findall(t.lower())] for t in x] for x in (toxic, clean)])
        if odds:
            self.ids = {f: i + 2 for i, f in enumerate(sorted(odds))}
            self._train(toxic, clean, odds)
        if curve:
            x, y = (np.concatenate([a, b]) for a, b in zip(*seen, strict=True))
            self._fit_curve(x, y)
        return self

    def _train(self, toxic: list[str], clean: list[str], odds: dict[str, float], rounds: int = 50, rate: float = 0.4, ridge: float = 0.3) -> None:
        number: dict = {}
        known: dict[str, tuple[int, ...]] = {}
        doc, which, times = [], [], []
        for d, text in enumerate([*toxic, *clean]):
            for piece, n in self._chains(text, known).items():
                doc.append(d)
                which.append(number.setdefault(piece, len(number)))
                times.append(n)
        doc, which, times = np.array(doc, dtype=np.int64), np.array(which, dtype=np.int64), np.array(times, dtype=np.float64)
        bad = np.arange(len(toxic) + len(clean)) < len(toxic)
        length = np.array([p if isinstance(p, int) else len(p) for p in number])
        cells, feats = [], []
        for i, piece in enumerate(number):
            if not isinstance(piece, int):
                for j, own in enumerate(piece):
                    cells += [i * CHAIN + j] * len(own)
                    feats += own
        cells, feats = np.array(cells, dtype=np.int64), np.array(feats, dtype=np.int64)
        live = np.arange(CHAIN)[None, :] < length[:, None]
        self.weight = np.array([-5.0, 0.0, *(0.5 * odds[f] for f in sorted(odds))])
        square, square_t = np.zeros_like(self.weight), np.zeros((2, 2))
        for _ in range(rounds):
            emit = self.weight[0] + np.bincount(cells, self.weight[feats], minlength=live.size).reshape(live.shape)
            token, pairs, log_z = batch_marginals(emit, self.trans, length)
            none = np.exp(np.minimum(0.0, np.bincount(doc, times * ((length - 1) * self.trans[0, 0] - log_z)[which], minlength=len(bad))))
            # How the likelihood of a document's label moves with the log chance that none of its tokens is toxic.
            chance = np.where(bad, 1 - none, none)
            pull = np.where(bad, 1.0, -1.0) * (1 - 2 * DOUBT) * none / (DOUBT + (1 - 2 * DOUBT) * chance)
            share = np.bincount(which, times * pull[doc], minlength=len(number))
            gap = (share[:, None] * token).ravel()
            grad = np.bincount(feats, gap[cells], minlength=len(self.weight))
            grad[0] = gap.sum()
            grad[1:] -= ridge * self.weight[1:]
            grad_t = (share[:, None, None] * pairs).sum(axis=0) - ridge * self.trans
            grad_t[0, 0] -= (share * (length - 1)).sum()
            square, square_t = square + grad**2, square_t + grad_t**2
            self.weight = self.weight + rate * grad / (np.sqrt(square) + 1e-8)
            self.trans = self.trans + rate * grad_t / (np.sqrt(square_t) + 1e-8)
        # Emissions up to ``quiet`` beside the bias cannot lift any marginal to FLOOR, whatever the length.
        (t00, t01), (t10, t11) = self.trans.tolist()
        tops = [e for e in np.arange(0.0, 10.0, 0.05).tolist() if max(chain_marginals([float(self.weight[0]) + e] * 200, self.trans)) < FLOOR]
        self.quiet = max(tops, default=-math.inf) if t00 + t11 >= t01 + t10 else -math.inf

    def _summaries(self, toxic: list[str], clean: list[str]) -> tuple[np.ndarray, np.ndarray]:
        x = np.array([self._summary(t, self.tag(t)) for t in [*toxic, *clean]]).reshape(-1, 5)
        return x, np.array([1.0] * len(toxic) + [0.0] * len(clean))

    def _fit_curve(self, x: np.ndarray, y: np.ndarray) -> None:
        curve = np.zeros(5)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(5)
            curve += np.linalg.solve(hess, x.T @ (y - p) - 0.05 * curve)
        self.curve = curve

    def _weights(self, tokens: set[str]) -> dict[str, float]:
        """Of the tokens that have features: what they add to the bias."""
        if len(self.known) > self.REMEMBER:
            self.known.clear()
        known = self.known
        for w in [w for w in tokens if w not in known]:
            own = self._active(w)
            known[w] = float(self.weight[list(own)].sum()) if own else 0.0
        return {w: known[w] for w in tokens if known[w]}

    def tag(self, text: str) -> list[tuple[int, int, float]]:
        """Tokens with a marginal over 0.05: start, end (code points), marginal."""
        if not self.ids:
            return []
        hot = self._weights(set(_WORD.findall(text)))
        if max(hot.values(), default=0.0) <= self.quiet:
            return []
        out = []
        bias = float(self.weight[0])
        for s in sentences(text):
            emit = [hot.get(m[0], 0.0) for m in s]
            if max(emit) > self.quiet:
                out += [(m.start(), m.end(), p) for m, p in zip(s, chain_marginals([bias + e for e in emit], self.trans), strict=True) if p > FLOOR]
        return out

    @staticmethod
    def _summary(text: str, tokens: list[tuple[int, int, float]]) -> tuple[float, ...]:
        """One, the largest marginal, the logs of their number and their sum, and the sum against the length."""
        total = sum(p for *_, p in tokens)
        return 1.0, max((p for *_, p in tokens), default=0.0), math.log1p(len(tokens)), math.log1p(total), min(5.0, 600 * total / (600 + len(text)))

    def score(self, text: str, tokens: list[tuple[int, int, float]]) -> float:
        z = float(self.curve @ np.array(self._summary(text, tokens)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def spans(self, tokens: list[tuple[int, int, float]]) -> str:
        return ",".join(f"{a}:{b}" for a, b, p in tokens if p >= 0.5)


def fit_span_tagger(labelled: DataFrame) -> SpanTagger:
    """Fit on sampled ``(doc_id, text, toxic)`` rows."""
    sample = labelled.where("text is not null and toxic in (0, 1)").select("text", "toxic").collect()
    texts = [[r["text"] for r in sample if r["toxic"] == y] for y in (1, 0)]
    return SpanTagger().fit(*texts) if all(texts) else SpanTagger()


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _share(salt: int, most: int, sizes: dict) -> Column:
    """Whether a document is among those of least salted id hash that make up about ``most`` of its class's size."""
    place = F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return place < F.when(F.col("toxic") == 1, most / max(1, sizes.get(1, 0))).otherwise(most / max(1, sizes.get(0, 0)))


def tagger_of(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS, bytes_per_class: int = BYTES_PER_CLASS) -> SpanTagger:
    """Learn from the labels of documents that are not held out; each labelled document counts once."""
    known = labels.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # The sample of ids is bounded before it meets the texts, that of texts before it comes to the driver.
    known = F.broadcast(known.where(_share(1, docs_per_class, sizes)))
    sample = materialize(docs.select("doc_id", "text").where("text is not null").join(known, "doc_id"), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.sum(F.octet_length("text").cast("long")).alias("n")).collect()}
    return fit_span_tagger(sample.where(_share(2, bytes_per_class, sizes)))


def score_toxicity(df: DataFrame, tagger: SpanTagger) -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)``, one row per row of ``df``."""
    schema = StructType(
        [StructField("doc_id", LongType()), StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("spans", StringType())]
    )

    def kernel(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        tokens = [tagger.tag(t) for t in texts]
        scores = [tagger.score(t, x) for t, x in zip(texts, tokens, strict=True)]
        return {
            "doc_id": batch.column("doc_id"),
            "held_out": batch.column("held_out"),
            "score": scores,
            "predicted": [int(s >= THRESHOLD) for s in scores],
            "spans": [tagger.spans(x) for x in tokens],
        }

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return map_texts(rows, kernel, schema)


def drop_toxic(df: DataFrame, tagger: SpanTagger, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose score stays under the threshold, with all their columns."""
    names = [f"c{i}" for i in range(len(df.columns))]
    text = names[df.columns.index(text_col)]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                keep = [tagger.score(t, tagger.tag(t)) < THRESHOLD for t in (x or "" for x in part.column(text).to_pylist())]
                yield part.filter(pa.array(keep))

    plain = df.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def op10_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, tagger_of(docs, table(spark, sf_dir, "labels")))
