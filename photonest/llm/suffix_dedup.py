"""Removal of passages that repeat: distributed prefix doubling over sampled positions.

Sorting a rank for every byte position would take many times the input in shuffles, so positions are
sampled without loss. Every window of ``LENGTH`` bytes has an anchor: the least hashed ``GRAM``-byte
string in it (the leftmost of equals). Equal windows have equal anchors at equal places, so a window
can only repeat if its anchor does, at the same distance ``l`` from the window's start. One row stands
for an anchor and the run of windows it serves, ``l_lo <= l <= l_hi``.

The doubling runs over these rows. The first rank is the anchor's string. A row whose rank is unique
drops out; the others are reranked by the pair (rank, longer string): the windows of a row are dealt
into ranges of 64, 16, 4 and 1 values of ``l``, and the string that all windows of a range share grows
from 32 to 137, 185, 197 and at last 200 bytes, past which equal rank means a repeated window. Rows that
agree in all bytes their windows cover are settled at once, and one of them stays as a partner for the
rest, so long copies end in the first round and only the rims of passages go all the way.

Ranks are 128 bits of hash. Equal texts count as one text whose every window repeats. Null is empty;
texts shorter than the length lose nothing. Removed bytes are those covered by a repeated window.
Repeated rows are copies of each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from photonest.llm.bitmap import Bitmap
from photonest.llm.common import map_texts, table, utf8
from photonest.session import materialize

LENGTH, GRAM = 200, 32
WIDTHS = (64, 16, 4, 1)
_PLACE = 31  # bits of a position in a slice; no text has more bytes

_ANCHOR = StructType(
    [StructField("doc_id", LongType()), StructField("digest", BinaryType()), StructField("khash", LongType()), StructField("hull", LongType())]
    + [StructField(c, IntegerType()) for c in ("p", "s_lo", "s_hi")]
)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    out += (b ^ (b >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(32)
    return out


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each string of ``gram`` bytes (a power of two) in ``data``."""
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    span = 1
    while span < gram:
        h = _mix(h[:-span], h[span:])
        span *= 2
    return h


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each run of ``width`` keys."""
    n = len(keys)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    rows[:n] = keys
    rows = rows.reshape(-1, width)
    from_left = np.minimum.accumulate(rows, axis=1).ravel()
    from_right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_right[: n - width + 1], from_left[width - 1 : n])


def _anchors(length: int, gram: int):
    seen: set[bytes] = set()  # of one task; equal texts give equal rows

    def kernel(batch: pa.RecordBatch) -> dict | None:
        texts, owners, digests = [], [], []
        for i, t in enumerate(utf8(batch.column("text"))):
            if len(t) >= length:
                d = hashlib.md5(t).digest()
                if d not in seen:
                    seen.add(d)
                    texts.append(t)
                    owners.append(i)
                    digests.append(d)
        if not texts:
            return None
        joined = b"".join(texts)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        h = gram_hashes(np.frombuffer(joined, dtype=np.uint8), gram)
        mask = np.uint64((1 << _PLACE) - 1)
        least = sliding_least((h & ~mask) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        anchor = (least & mask).astype(np.int64)
        # Windows that lie in one text.
        window = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
        anchor = anchor[window]
        cuts = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(window) != 1)) + 1
        first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(window)]]) - 1
        lo, hi, p = window[first], window[last], anchor[first]
        doc = np.searchsorted(ends, lo, side="right")
        digest = xxhash.xxh3_64_intdigest
        hulls = np.array([digest(joined[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], dtype=np.uint64)
        hulls ^= ((p - lo) * 1000 + (p - hi)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        base = begins[doc]
        ids = batch.column("doc_id").take(pa.array(owners))
        return {
            "doc_id": ids.take(pa.array(doc)),
            "digest": pa.array(digests, pa.binary()).take(pa.array(doc)),
            "khash": pa.array(h[p].view(np.int64)),
            "hull": pa.array(hulls.view(np.int64)),
            "p": pa.array((p - base).astype(np.int32)),
            "s_lo": pa.array((lo - base).astype(np.int32)),
            "s_hi": pa.array((hi - base).astype(np.int32)),
        }

    return kernel


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _round(rows: DataFrame, width: int, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """One reranking: (windows found to repeat, rows for the next round).

    rows: r1, r2 (rank), digest, p, l_lo, l_hi (windows left), top (l_hi at first), need, ctx (bytes from p - top on).
    """
    steps = F.sequence(F.floor(F.col("l_lo") / width), F.floor(F.col("l_hi") / width))
    cut = rows.withColumn("lo", F.explode(F.transform(steps, lambda i: (i * width).cast("int")))).withColumn("hi", F.least(F.col("lo") + width - 1, F.lit(length - gram)))
    cut = cut.withColumn("l_lo", F.greatest("l_lo", "lo")).withColumn("l_hi", F.least("l_hi", "hi"))
    shared = F.substring("ctx", F.col("top") - F.col("lo") + 1, F.lit(length) - F.col("hi") + F.col("lo"))
    hull = F.substring("ctx", F.col("top") - F.col("l_hi") + 1, F.lit(length) + F.col("l_hi") - F.col("l_lo"))
    cut = cut.withColumn("hull", F.xxhash64(hull, "l_lo", "l_hi"))
    cut = cut.withColumn("shared", shared).withColumn("r2", F.xxhash64(F.lit(width), "r2", "lo", F.sha1("shared")))
    cut = cut.withColumn("r1", F.xxhash64("r1", "lo", "shared")).drop("shared", "lo", "hi")
    cut = materialize(cut, "ranked")
    who = F.struct("digest", "p")
    classes = cut.groupBy("r1", "r2", "hull").agg(F.min(who).alias("a"), F.max(who).alias("b"), F.max("need").alias("need"))
    classes = classes.withColumn("repeats", F.col("a") != F.col("b")).withColumn("open", F.col("need") & ~F.col("repeats")).drop("b", "need")
    classes = materialize(classes, "classes")
    ranks = classes.groupBy("r1", "r2").agg(F.max("open").alias("go_on"), F.count("*").alias("n")).where("go_on and n > 1").select("r1", "r2")
    ranks = materialize(ranks, "open-ranks", thin=True)
    found = cut.where("need").join(classes.where("repeats").select("r1", "r2", "hull"), ["r1", "r2", "hull"], "left_semi")
    found = found.select("digest", (F.col("p") - F.col("l_hi")).alias("s_lo"), (F.col("p") - F.col("l_lo")).alias("s_hi"))
    if width == 1:
        return found, found.limit(0)
    live = classes.join(ranks, ["r1", "r2"], "left_semi").select(
        "r1", "r2", "hull", F.col("a.digest").alias("digest"), F.col("a.p").alias("p"), F.col("open")
    )
    rest = cut.drop("need").join(live, ["r1", "r2", "hull", "digest", "p"]).withColumnRenamed("open", "need")
    return found, rest


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(digest, s_lo, s_hi)``: starts of windows of ``docs(doc_id, text)`` that also start in another place.

    Copies of one text are one place; their windows are not reported for that alone.
    """
    anchors = materialize(map_texts(docs.select("doc_id", "text"), _anchors(length, gram), _ANCHOR, limit=512 << 10), "anchors")
    often = anchors.groupBy("khash").agg(F.count("*").alias("n")).where("n > 1")
    anchors = Bitmap(materialize(often.select("khash"), "repeated-grams", thin=True), "khash").keep(anchors, "khash")
    # The rank of an anchor's string is its hash; the string itself joins the rank in the next round.
    who = F.struct("digest", "p")
    classes = anchors.groupBy("khash", "hull").agg(F.min(F.struct("digest", "p", "doc_id", "s_lo", "s_hi")).alias("a"), F.max(who).alias("b"))
    repeats = (F.col("a.digest") != F.col("b.digest")) | (F.col("a.p") != F.col("b.p"))
    classes = materialize(classes.select("khash", "hull", "a", repeats.alias("repeats")), "classes")
    found = [
        materialize(
            anchors.join(classes.where("repeats").select("khash", "hull"), ["khash", "hull"], "left_semi").select("digest", "s_lo", "s_hi").distinct(), "repeats", thin=True
        )
    ]
    ranks = classes.groupBy("khash").agg(F.count("*").alias("n"), F.max(~F.col("repeats")).alias("open")).where("n > 1 and open").select("khash")
    live = classes.join(materialize(ranks, "open-ranks", thin=True), "khash", "left_semi").select("khash", "a.*", (~F.col("repeats")).alias("need"))
    wanted = live.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("khash", "p", "s_lo", "s_hi", "need")).alias("rows"))
    wanted = materialize(wanted.withColumn("h", F.xxhash64("digest")), "wanted", thin=True)
    source = docs.select("doc_id", _digest(F.col("text")).alias("digest"), F.col("text").cast("binary").alias("bytes"))
    source = Bitmap(wanted.select("h"), "h").keep(source.withColumn("h", F.xxhash64("digest")), "h")
    on = source["doc_id"].eqNullSafe(wanted["doc_id"]) & (source["digest"] == wanted["digest"])
    cut = F.transform(
        wanted["rows"],
        lambda r: F.struct(
            r["khash"].alias("khash"), r["p"].alias("p"), (r["p"] - r["s_hi"]).alias("l_lo"), (r["p"] - r["s_lo"]).alias("l_hi"), r["need"].alias("need"),
            F.substring(source["bytes"], r["s_lo"] + 1, r["s_hi"] - r["s_lo"] + length).alias("ctx"),
        ),
    )
    rows = source.join(wanted, on).select(wanted["digest"], F.explode(cut).alias("r")).select("digest", "r.*")
    # Repeated rows of one doc_id and text give a row each; one is enough.
    rows = rows.dropDuplicates(["digest", "p", "l_lo"])
    rows = rows.withColumn("top", F.col("l_hi")).withColumn("r1", F.col("khash")).withColumn("r2", F.lit(0).cast("long")).drop("khash")
    for width in WIDTHS:
        more, rows = _round(rows, width, length, gram)
        found.append(materialize(more, "repeats", thin=True))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def covered(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows that start in any of the ranges."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def _removal(length: int):
    def kernel(batch: pa.RecordBatch) -> dict:
        out: dict = {"digest": batch.column("digest"), "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, starts in zip(batch.column("bytes").to_pylist(), batch.column("starts").to_pylist(), strict=True):
            runs = covered([(x["s_lo"], x["s_hi"]) for x in starts], length)
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            out["n_removed"].append(sum(b - a for a, b in runs))
            out["n_spans"].append(len(runs))
            out["kept_sha256"].append(kept.hexdigest())
        return out

    return kernel


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per row of ``df(doc_id, text)``."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    thin = docs.select(
        "doc_id", _digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")
    )
    thin = materialize(thin, "texts")
    copies = materialize(thin.where(F.col("n_bytes") >= length).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest", F.lit(True).alias("copied")), "copies", thin=True)
    starts = repeated_windows(docs, length, gram).join(copies, "digest", "left_anti")
    starts = starts.groupBy("digest").agg(F.collect_set(F.struct("s_lo", "s_hi")).alias("starts"))
    starts = materialize(starts.withColumn("h", F.xxhash64("digest")), "starts", thin=True)
    source = docs.select(_digest(F.col("text")).alias("digest"), F.col("text").cast("binary").alias("bytes"))
    source = Bitmap(starts.select("h"), "h").keep(source.withColumn("h", F.xxhash64("digest")), "h").drop("h")
    schema = StructType(
        [StructField("digest", BinaryType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())]
    )
    done = map_texts(source.join(starts.drop("h"), "digest"), _removal(length), schema, text="bytes")
    done = materialize(done, "removals", thin=True)
    empty = hashlib.sha256(b"").hexdigest()
    all_of = thin.join(copies, "digest", "left").join(done, "digest", "left")
    return all_of.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copied"), F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
