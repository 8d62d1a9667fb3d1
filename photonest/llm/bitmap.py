"""A bitmap over hashes, small enough to broadcast, that lets most rows without a partner stay where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonest.session import materialize

#: 2^28 bits are 32 MB, sent as at most 8192 pages of 4 KB; beyond that more rows pass the test than need to.
MOST_BITS = 1 << 28
#: Words of 64 bits in a page.
PAGE = 512


def bits_for(keys: int) -> int:
    """Sixteen bits a key, a power of two within the bounds."""
    return min(MOST_BITS, 1 << max(12, (16 * max(1, keys) - 1).bit_length()))


def pages_of(spots: DataFrame) -> DataFrame:
    """``(__page, __words)``: the bits at ``__spot`` of ``spots`` set, ``PAGE`` words of 64 bits a row; pages without a bit are left out."""
    words = spots.groupBy(F.expr("shiftrightunsigned(__spot, 6)").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__spot & 63 as int))")).alias("__bits"))
    slot = (F.col("__word") % PAGE).cast("int")
    # At most PAGE words meet in a row.
    rows = words.groupBy(F.shiftrightunsigned("__word", PAGE.bit_length() - 1).alias("__page")).agg(F.map_from_entries(F.collect_list(F.struct(slot.alias("k"), "__bits"))).alias("__m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(PAGE - 1)), lambda i: F.coalesce(F.element_at("__m", i), F.lit(0).cast("long")))
    return rows.select("__page", dense.alias("__words"))


def page_of(spot: Column) -> Column:
    return F.shiftrightunsigned(spot, (64 * PAGE).bit_length() - 1)


def is_set(spot: Column) -> Column:
    """Whether the bit of a row joined (left) with its page is set."""
    word = F.get("__words", (F.shiftrightunsigned(spot, 6) % PAGE).cast("int"))
    return F.coalesce(F.call_function("shiftrightunsigned", word, spot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


class Bitmap:
    """Set of the hashes in column ``h`` of ``keys``, without misses."""

    def __init__(self, keys: DataFrame, h: str) -> None:
        self.bits = bits_for(keys.count())
        self.pages = materialize(pages_of(keys.select(self._spot(h).alias("__spot"))), "bitmap", thin=True)

    def _spot(self, h: str) -> Column:
        return F.col(h).bitwiseAND(F.lit(self.bits - 1))

    def _tested(self, df: DataFrame, h: str) -> DataFrame:
        rows = df.withColumn("__spot", self._spot(h)).withColumn("__page", page_of(F.col("__spot")))
        return rows.join(F.broadcast(self.pages), "__page", "left").withColumn("__hit", is_set(F.col("__spot")))

    def split(self, df: DataFrame, h: str) -> tuple[DataFrame, DataFrame]:
        """The rows of ``df`` whose hash may be in the set, and those whose hash is not; a null hash is not."""
        rows = self._tested(df, h)
        return rows.where("__hit").select(*df.columns), rows.where("not __hit").select(*df.columns)

    def keep(self, df: DataFrame, h: str) -> DataFrame:
        """The rows of ``df`` whose hash may be in the set."""
        return self._tested(df, h).where("__hit").select(*df.columns)
