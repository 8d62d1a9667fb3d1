"""Exact deduplication behind a two-pass Bloom filter, in DataFrame operations only.

Pass 1 hashes every normalised text once. Block ``b`` of the filter is 64 bits; a text sets one
bit of one block. A block in which the rows outnumber the bits set holds a possibly repeated hash,
and its place in a bitmap over all blocks is set. Pass 2 tests each row against that bitmap:
rows in unmarked blocks are unique and pass straight through, only the others shuffle by hash.

To build the filter, pass 1 adds up (block, bits) pairs, of twelve bytes or less a text, over an exchange; neither
texts nor digests move in it. Filters that each task fills by itself and that are merged by their bits would be
(tasks x filter) bytes instead, which is more as soon as a task has fewer texts than the filter has words.

The bitmap has at most ``MAX_BLOCKS`` bits, so it can be broadcast. More texts than that are taken in ranges of
their hashes, one after another, each with a filter of its own, so that no filter is ever overfull.

Null text counts as empty. Texts are equal if they are after lower-casing A-Z. Of equal texts the
row with the largest doc_id stays; among repeated rows with that doc_id too, exactly one does (a
null doc_id counts as smallest). Other columns never take part, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photonest.llm.bitmap import is_set, page_of, pages_of
from photonest.llm.common import table
from photonest.session import materialize, new_path

#: Bits of the broadcast bitmap: 2^28 bits are 32 MB.
MAX_BLOCKS = 1 << 28
MIN_BLOCKS = 1 << 12


def normalized(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is; null is empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(blocks - 1))


def _marked_blocks(hashed: DataFrame, blocks: int) -> DataFrame:
    """Pages of the bitmap in which a block's bit is set if it has more rows than bits."""
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    per_block = hashed.select(_block(F.col("h"), blocks).alias("__spot"), bit.alias("bit")).groupBy("__spot").agg(
        F.count("*").alias("n"), F.bit_or("bit").alias("bits")
    )
    return materialize(pages_of(per_block.where(F.col("n") > F.bit_count("bits")).select("__spot")), "bloom", thin=True)


def _tested(rows: DataFrame, h: str, marked: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``_hit``: whether the block of hash ``h`` is marked."""
    rows = rows.withColumn("__spot", _block(F.col(h), blocks)).withColumn("__page", page_of(F.col("__spot")))
    return rows.join(F.broadcast(marked), "__page", "left").withColumn("_hit", is_set(F.col("__spot"))).drop("__spot", "__page", "__words")


def blocks_for(rows: int, most: int = MAX_BLOCKS) -> int:
    """A power of two of at least the row count, within the bounds."""
    return min(most, max(MIN_BLOCKS, 1 << max(0, int(rows) - 1).bit_length()))


def _classes(hashed: DataFrame, blocks: int) -> DataFrame:
    tested = _tested(hashed, "h", _marked_blocks(hashed, blocks), blocks)
    alone = tested.where("not _hit").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", F.lit(False).alias("possibly_repeated"),
    )
    hits = tested.where("_hit").select("doc_id", "text_sha256", "row")
    best = hits.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")
    )
    best = materialize(best, "groups", thin=True)
    grouped = hits.join(best, "text_sha256").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", F.lit(True).alias("possibly_repeated"),
    )
    return alone.unionByName(grouped)


def duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, possibly_repeated."""
    spark = df.sparkSession
    digest = F.sha2(normalized(F.col(text_col)).cast("binary"), 256)
    hashed = df.select(F.col(id_col).alias("doc_id"), digest.alias("text_sha256"))
    hashed = hashed.withColumn("h", F.xxhash64("text_sha256")).withColumn("row", F.monotonically_increasing_id())
    hashed = materialize(hashed, "text-hashes")
    rows = hashed.count()
    ranges = max(1, -(-rows // max_blocks))
    if ranges == 1:
        return _classes(hashed, blocks_for(rows, max_blocks))
    # The top bits of the hash choose the range, lower ones the block. Files by range are read once each.
    parted, path = new_path(spark, "hash-ranges"), new_path(spark, "classes")
    hashed.withColumn("_range", F.pmod(F.shiftrightunsigned("h", 40), F.lit(ranges))).write.partitionBy("_range").parquet(parted)
    every = spark.read.schema(hashed.schema.add("_range", "long")).parquet(parted)
    for i in range(ranges):
        _classes(every.where(F.col("_range") == i).drop("_range"), max_blocks).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Unmarked rows pass in place; only the full rows of marked blocks move, dealt by hash and doc_id,
    so that no group of copies meets in one task.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    doc_id, text = (F.col(names[df.columns.index(c)]) for c in (id_col, text_col))
    plain = plain.withColumn("_sha", F.sha2(normalized(text).cast("binary"), 256)).withColumn("_id", doc_id)
    plain = plain.withColumn("_h", F.xxhash64("_sha"))
    hashed = materialize(plain.select("_id", "_sha", F.col("_h").alias("h")), "text-hashes")
    blocks = blocks_for(hashed.count())  # with more texts than that more rows move, to the same end
    marked = _marked_blocks(hashed, blocks)
    keepers = _tested(hashed, "h", marked, blocks).where("_hit").groupBy("_sha").agg(
        F.max(F.struct("_id")).alias("k"), F.count("*").alias("n")
    )
    keepers = materialize(keepers.select(F.col("_sha").alias("k_sha"), F.col("k._id").alias("k_id")), "keepers", thin=True)
    rows = _tested(plain, "_h", marked, blocks)
    alone = rows.where("not _hit").select(*names)
    stay = rows.where("_hit").join(
        keepers, (F.col("_sha") == F.col("k_sha")) & F.col("_id").eqNullSafe(F.col("k_id")), "left_semi"
    )
    # Repeated rows share hash and doc_id; all but one of them go.
    one = Window.partitionBy("_sha", "_id").orderBy(F.xxhash64(*names))
    stay = stay.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*names)
    return alone.unionByName(stay).toDF(*df.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(table(spark, sf_dir, "documents")).drop("possibly_repeated")


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
