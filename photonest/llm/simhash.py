"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: a 64-bit majority over the XXH64 (seed 42) of the 3-word shingles of a text. Equal
fingerprints collapse first, so copies never multiply. The distinct fingerprints are then compared
exactly, tile against tile, with numpy exclusive-or and bit counts.

A tile is the set of fingerprints that agree in the population counts of their four 16-bit quarters.
Two fingerprints at distance d have counts whose differences add up to at most d, so tile pairs
beyond that are skipped, and nothing else is. Of a pair of tiles the greater key visits the lesser.
A tile of more than ``TILE_ROWS`` fingerprints is split, and every visitor sees each part. A task
holds one part of a tile (8 bytes a fingerprint) while its visitors stream past, and hands on only
a spanning forest of the links it finds, so a dense group costs one edge per member and tile.

Null text has no words: fingerprint zero, linked like any other. Repeated rows share everything.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from photonest.llm.bitmap import Bitmap
from photonest.llm.common import map_texts, salted_join, table, utf8
from photonest.operators.components import connected_components
from photonest.session import materialize

RADIUS = 3
SHINGLE = 3
TILE_ROWS = 8192
#: Fingerprint pairs compared by one numpy call.
BLOCK = 1 << 20


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of a UTF-8 text; bytes.lower and bytes.split know ASCII only, as the definition does."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    begins = (ends - size)[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(begins, stops, strict=True)], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text."""
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    if not n:
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, n, 1 << 16):
        part = hashes[start : start + (1 << 16)].astype(">u8").view(np.uint8)
        votes += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n).view(">u8")[0])


def _fingerprints(batch: pa.RecordBatch) -> dict:
    prints = np.array([fingerprint(t) for t in utf8(batch.column("text"))], dtype=np.uint64).view(np.int64)
    return {"doc_id": batch.column("doc_id"), "fp": pa.array(prints)}


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType([StructField("doc_id", LongType()), StructField("fp", LongType())])
    return map_texts(rows, _fingerprints, schema)


def _offsets(radius: int) -> list[list[int]]:
    """Differences of quarter counts that a pair may have, the lesser half: zero, and first non-zero entry negative."""
    span = range(-radius, radius + 1)
    every = [(a, b, c, d) for a in span for b in span for c in span for d in span if abs(a) + abs(b) + abs(c) + abs(d) <= radius]
    return [list(x) for x in every if x <= (0, 0, 0, 0)]


def _quarter(i: int) -> Column:
    return F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)))


class _Forest:
    """Union-find over fingerprints of one tile part; members hang on the first seen."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, residents, forest = None, [], _Forest()
        held = np.empty(0, dtype=np.int64)
        src: list[int] = []
        dst: list[int] = []
        for batch in batches:
            tile = batch.column("tile").to_numpy()
            part = batch.column("part").to_numpy()
            visits = batch.column("visits").to_numpy()
            fp = batch.column("fp").to_numpy()
            cuts = np.flatnonzero(np.diff(tile) | np.diff(part) | np.diff(visits)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                if hi <= lo:
                    continue
                if (tile[lo], part[lo]) != key:
                    key, residents, forest = (tile[lo], part[lo]), [], _Forest()
                if not visits[lo]:
                    residents.append(fp[lo:hi].copy())
                    held = np.concatenate(residents)
                    continue
                if not residents:
                    continue
                step = max(1, BLOCK // len(held))
                for at in range(lo, hi, step):
                    guest = fp[at : min(hi, at + step)]
                    apart = (guest[:, None] ^ held[None, :]).view(np.uint64)  # of signed numbers the absolute value would count
                    near = np.bitwise_count(apart) <= radius
                    g, h = np.nonzero(near)
                    for a, b in zip(guest[g].tolist(), held[h].tolist(), strict=True):
                        if a != b and forest.link(a, b):
                            src.append(a)
                            dst.append(b)
            if len(src) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
                src, dst = [], []
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(src, dst)`` links among distinct ``fp`` that connect all pairs at ``radius`` bits or fewer."""
    spark = distinct.sparkSession
    key = lambda c: c[0] * 17**3 + c[1] * 17**2 + c[2] * 17 + c[3]
    counted = distinct.withColumn("q", F.array(*[_quarter(i) for i in range(4)]))
    counted = counted.withColumn("tile", key([F.col("q")[i] for i in range(4)]).cast("int"))
    # At most 17^4 tiles exist, so this table is bounded and may be broadcast.
    tiles = counted.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("parts"))
    tiles = F.broadcast(materialize(tiles, "tiles", thin=True))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    residents = counted.join(tiles, "tile").select("tile", part.alias("part"), F.lit(0).alias("visits"), "fp")
    near = F.explode(F.array(*[F.array(*[F.lit(x) for x in o]) for o in _offsets(radius)]))
    guests = counted.select("fp", "q", near.alias("o"))
    guests = guests.withColumn("t", F.array(*[F.col("q")[i] + F.col("o")[i] for i in range(4)]))
    guests = guests.where(F.forall("t", lambda x: (x >= 0) & (x <= 16)))
    guests = guests.select("fp", key([F.col("t")[i] for i in range(4)]).cast("int").alias("tile"))
    guests = guests.join(tiles, "tile").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("visits"), "fp"
    )
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = residents.unionByName(guests).repartition(n, "tile", "part").sortWithinPartitions("tile", "part", "visits")
    schema = StructType([StructField("src", LongType()), StructField("dst", LongType())])
    return dealt.mapInArrow(_compare(radius), schema)


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the smallest doc_id that links reach)."""
    prints = materialize(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    distinct = materialize(distinct, "distinct-fingerprints")
    links = materialize(near_links(distinct.select("fp"), radius), "links", thin=True)
    groups = materialize(connected_components(links), "components", thin=True).withColumnRenamed("node", "fp")
    named = distinct.join(groups, "fp", "left").where("component is not null or n > 1").withColumn("g", F.coalesce("component", "fp"))
    named = materialize(named.select("fp", "least", "g"), "named-fingerprints", thin=True)
    of_group = named.groupBy("g").agg(F.min("least").alias("component_id"))
    by_print = materialize(named.join(of_group, "g").select("fp", "component_id"), "print-ids", thin=True)
    # A fingerprint of one document without links is its own class; the others may be hot (no words, boilerplate).
    maybe, alone = Bitmap(by_print.withColumn("h", F.xxhash64("fp")), "h").split(prints.withColumn("h", F.xxhash64("fp")), "h")
    maybe = salted_join(maybe, by_print, "fp", "doc_id").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))
    return alone.select("doc_id", "fp", F.col("doc_id").alias("component_id")).unionByName(maybe)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with the smallest doc_id of their group (repeated rows of that doc_id all stay)."""
    return drop_all_but_least(df, near_duplicate_classes(df, id_col, text_col), id_col)


def drop_all_but_least(df: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id is a ``component_id`` of ``classes(doc_id, component_id)``.

    Only rows whose id may be among those to go (a broadcast bitmap tells) move to be looked up; the rest
    pass in place. A row without an id stays.
    """
    classes = materialize(classes, "near-classes")
    kept = classes.select(F.col("component_id").alias("doc_id")).distinct()
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct().join(kept, "doc_id", "left_anti")
    gone = materialize(gone.select(F.col("doc_id").alias("_gone"), F.xxhash64("doc_id").alias("_h")), "gone-ids", thin=True)
    names = [f"c{i}" for i in range(len(df.columns))]
    own = F.col(names[df.columns.index(id_col)]).cast("long")
    rows = df.toDF(*names).withColumn("_h", F.xxhash64(own))
    maybe, stay = Bitmap(gone, "_h").split(rows, "_h")
    maybe = maybe.join(gone.select("_gone"), own == F.col("_gone"), "left_anti")
    return stay.select(*names).unionByName(maybe.select(*names)).toDF(*df.columns)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
