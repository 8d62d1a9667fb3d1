"""Moments (time, distance, likeness) and places (distance) as joins plus connected components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photonest.functions.expressions import EARTH_METRES, hamming, haversine
from photonest.operators.components import connected_components, contracted
from photonest.operators.order import numbered
from photonest.session import materialize

#: Rows of the time order that one window partition holds.
BLOCK = 4096


def time_order() -> list[Column]:
    return [F.col("ts").isNull().asc(), F.col("ts").asc(), F.col("idx").asc()]


def candidate_pairs(photos: DataFrame, window: int = 40, threshold_s: float = 120.0) -> DataFrame:
    """``(a, b)`` structs of photos at most ``window`` places apart in time order, cut at window x threshold.

    The order is cut into blocks; each block also gets the first rows of the next, so one frame per block
    sees all followers. ``photos``: id, idx, ts, lat, lon, phash.
    """
    row = F.struct("id", "idx", "ts", "lat", "lon", "phash")
    placed = numbered(photos.select("id", "idx", "ts", "lat", "lon", "phash"), time_order(), "pos")
    placed = placed.select("pos", row.alias("a"))
    block = F.floor((F.col("pos") - 1) / BLOCK)
    guest = placed.where((F.col("pos") - 1) % BLOCK < window).select("pos", "a", (block - 1).alias("block"), F.lit(True).alias("guest"))
    home = placed.select("pos", "a", block.alias("block"), F.lit(False).alias("guest"))
    ahead = Window.partitionBy("block").orderBy("pos").rowsBetween(1, window)
    seen = home.unionByName(guest).withColumn("next", F.collect_list("a").over(ahead)).where("not guest")
    last = F.broadcast(photos.agg(F.max("ts").alias("last")))
    pairs = seen.select("a", F.explode("next").alias("b")).join(last)
    gap = F.expr("timestampdiff(MICROSECOND, a.ts, coalesce(b.ts, last))")
    return pairs.where(F.col("a.ts").isNull() | (gap <= F.lit(int(threshold_s * window * 1e6)))).select("a", "b")


def same_moment(seconds: float = 120.0, metres: float = 100.0, bits: int = 10) -> Column:
    """Close in time (and in space, if both know where), or alike."""
    near_time = F.expr(f"timestampdiff(MICROSECOND, a.ts, b.ts) <= {int(seconds * 1e6)}")
    both = F.col("a.lat").isNotNull() & F.col("b.lat").isNotNull()
    near = haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= metres
    alike = hamming(F.col("a.phash"), F.col("b.phash")) <= bits
    return F.coalesce(near_time & F.when(both, near).otherwise(True), F.lit(False)) | F.coalesce(alike, F.lit(False))


def moment_edges(photos: DataFrame, seconds: float = 120.0, metres: float = 100.0, bits: int = 10, window: int = 40) -> DataFrame:
    return candidate_pairs(photos, window, seconds).where(same_moment(seconds, metres, bits)).select(F.col("a.idx").alias("src"), F.col("b.idx").alias("dst"))


def moments(photos: DataFrame, **limits) -> DataFrame:
    """``(id, idx, ts, moment_no, moment_id)``; moments are numbered by first time, then first index.

    ``limits`` are those of ``moment_edges``.
    """
    edges = materialize(contracted(moment_edges(photos, **limits)), "moment-edges")
    roots = connected_components(edges).withColumnRenamed("node", "idx")
    rows = photos.select("id", "idx", "ts").join(roots, "idx", "left").withColumn("root", F.coalesce("component", "idx")).drop("component")
    rows = materialize(rows, "moment-rows")
    groups = rows.groupBy("root").agg(F.min("ts").alias("t"), F.min("idx").alias("i"))
    groups = numbered(groups, [F.col("t").isNull().asc(), F.col("t").asc(), F.col("i").asc()], "n").select("root", (F.col("n") - 1).alias("moment_no"))
    return rows.join(groups, "root").select("id", "idx", "ts", "moment_no", F.format_string("moment-%04d", "moment_no").alias("moment_id"))


def _cells(metres: float) -> tuple:
    """Band of a latitude, cells of a band, and cell of a longitude, as Columns."""
    height = math.degrees(metres / EARTH_METRES)
    s = math.sin(metres / (2 * EARTH_METRES))
    band = lambda lat: F.floor((lat + 90.0) / height).cast("long")

    def cells(b: Column) -> Column:
        low, high = F.abs(b.cast("double") * height - height - 90.0), F.abs((b + 2).cast("double") * height - 90.0)
        c = F.cos(F.radians(F.least(F.lit(90.0), F.greatest(low, high))))
        n = F.floor(F.lit(360.0) / (2 * F.degrees(F.asin(F.least(F.lit(1.0), F.lit(s) / F.greatest(c, F.lit(1e-12)))))))
        return F.when((c <= s) | (n < 3), F.lit(1)).otherwise(n).cast("long")

    def cell(lon: Column, n: Column) -> Column:
        return F.pmod(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) * n / 360.0).cast("long"), n)

    return band, cells, cell


def near_points(points: DataFrame, metres: float) -> DataFrame:
    """Pairs ``(p, q, d)``, p < q, of distinct ``points(p, lat, lon)`` at most ``metres`` apart.

    A point is stored under its cell; as a probe it visits the neighbouring cells of three bands. Only points that
    share a cell neighbourhood meet.
    """
    band, cells, cell = _cells(metres)
    stored = points.withColumn("b", band(F.col("lat"))).withColumn("n", cells(F.col("b")))
    stored = stored.withColumn("k", cell(F.col("lon"), F.col("n"))).select(F.col("p").alias("q"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "b", "k")
    probe = points.withColumn("b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: band(F.col("lat")) + d)))
    probe = probe.withColumn("n", cells(F.col("b"))).withColumn("c", cell(F.col("lon"), F.col("n")))
    probe = probe.withColumn("k", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("c") + d, F.col("n"))))))
    d = haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    pairs = probe.join(stored, ["b", "k"]).where("p < q").withColumn("d", d)
    return pairs.where(F.col("d") <= metres).select("p", "q", "d")


#: Spots up to which all pairs of a neighbourhood are taken.
FEW_SPOTS = 10_000
#: Up to this radius and this latitude, cells of ``SIDE`` times the radius have diagonals below it and reach no further than ``REACH`` cells.
MOST_METRES, MOST_LATITUDE, SIDE, REACH = 5000.0, 85.0, 0.65, 2


def near_links(points: DataFrame, metres: float) -> DataFrame:
    """``(p, q)`` links that connect what the pairs of ``near_points(p, lat, lon)`` connect, without all pairs of dense spots.

    Cells are so small that all points of one are near each other: they hang on the first of them, the hub. Hubs then meet
    the points of the cells around; only where two cells in reach are not connected by that do their points meet each
    other. Near the poles, where cells are no squares, and for large radii all pairs are taken.
    """
    if metres > MOST_METRES:
        return near_points(points, metres).select("p", "q")
    polar = near_points(points.where(F.abs("lat") > MOST_LATITUDE - 0.1), metres).select("p", "q")
    band, cells, cell = _cells(metres * SIDE)
    placed = points.where(F.abs("lat") <= MOST_LATITUDE).withColumn("b", band(F.col("lat")))
    placed = placed.withColumn("k", cell(F.col("lon"), cells(F.col("b")))).select("b", "k", F.struct("p", "lat", "lon").alias("at"))
    hubs = placed.groupBy("b", "k").agg(F.min("at").alias("hub"))
    placed = materialize(placed.join(hubs, ["b", "k"]), "cells")
    hubs = placed.select("b", "k", "hub").distinct()
    apart = lambda x, y: haversine(F.col(f"{x}.lat"), F.col(f"{x}.lon"), F.col(f"{y}.lat"), F.col(f"{y}.lon")) <= metres

    def around(rows: DataFrame) -> DataFrame:
        """The cells of ``rows`` as ``b0, k0``, once for each other cell ``b, k`` in reach of their hub's cell."""
        steps = F.transform(F.sequence(F.lit(-REACH), F.lit(REACH)), lambda d: F.col("b0") + d)
        seen = rows.withColumnsRenamed({"b": "b0", "k": "k0", "hub": "guest"}).withColumn("b", F.explode(steps)).withColumn("n", cells(F.col("b")))
        # Cells of another band are others in number, so all of those that the guest's cell and its reach touch are seen.
        wide = F.lit(360.0) / cells(F.col("b0"))
        first = F.floor(F.pmod(F.col("k0") * wide, F.lit(360.0)) * F.col("n") / 360.0).cast("long")
        reach = F.transform(F.sequence(F.lit(-REACH), F.lit(REACH + 2)), lambda d: F.pmod(first + d, F.col("n")))
        return seen.withColumn("k", F.explode(F.array_distinct(reach))).where("b <> b0 or k <> k0").drop("n")

    own = placed.where("at.p <> hub.p").select(F.col("at.p").alias("p"), F.col("hub.p").alias("q"))
    visits = around(hubs).join(placed, ["b", "k"]).where(apart("guest", "at")).select(F.col("guest.p").alias("p"), F.col("hub.p").alias("q"))
    links = materialize(own.unionByName(visits.distinct()).unionByName(polar), "hub-links", thin=True)
    groups = connected_components(links, "p", "q")
    grouped = hubs.join(groups, F.col("hub.p") == F.col("node"), "left").select("b", "k", "hub", F.coalesce("component", "hub.p").alias("g"))
    grouped = materialize(grouped, "grouped-cells", thin=True)
    open_cells = around(grouped.withColumnRenamed("g", "g0")).join(grouped.select("b", "k", "g"), ["b", "k"]).where("g0 < g").select("b0", "k0", "g0", "b", "k", "g")
    spots = placed.select("b", "k", "at")
    met = open_cells.join(spots, ["b", "k"]).join(spots.select(F.col("b").alias("b0"), F.col("k").alias("k0"), F.col("at").alias("other")), ["b0", "k0"])
    more = met.where(apart("at", "other")).select(F.col("g0").alias("p"), F.col("g").alias("q")).distinct()
    return links.unionByName(more)


def places(photos: DataFrame, metres: float = 300.0) -> DataFrame:
    """``(id, idx, place_id)``; places are numbered by first appearance, photos without position stand alone."""
    located = photos.where("lat is not null")
    spots = located.groupBy("lat", "lon").agg(F.min("idx").alias("p"))
    spots = materialize(spots, "spots", thin=True)
    # Of few spots all pairs are cheaper than the rounds that spare them; both give the same places.
    links = near_points if spots.count() <= FEW_SPOTS else near_links
    roots = connected_components(links(spots.select("p", "lat", "lon"), metres), "p", "q").withColumnRenamed("node", "p")
    spots = spots.join(roots, "p", "left").withColumn("root", F.coalesce("component", "p"))
    # A root is the least first index of its place, so it orders the places.
    order = numbered(spots.select("root").distinct(), [F.col("root").asc()], "n").select("root", F.format_string("place-%04d", F.col("n") - 1).alias("place_id"))
    named = spots.join(order, "root").select("lat", "lon", "place_id")
    known = located.join(named, ["lat", "lon"]).select("id", "idx", "place_id")
    unknown = photos.where("lat is null").select("id", "idx", F.concat(F.lit("place-unknown-"), F.col("id")).alias("place_id"))
    return known.unionByName(unknown)


def time_sessions(photos: DataFrame, seconds: float = 120.0) -> DataFrame:
    """``(idx, session)``: runs of timestamped photos with gaps of at most ``seconds``; session is the first idx."""
    placed = numbered(photos.where("ts is not null").select("idx", "ts"), [F.col("ts").asc(), F.col("idx").asc()], "pos")
    placed = materialize(placed, "placed")
    before = placed.select((F.col("pos") + 1).alias("pos"), F.col("ts").alias("prior"))
    gap = F.expr("timestampdiff(MICROSECOND, prior, ts)")
    starts = placed.join(before, "pos", "left").withColumn("new", (F.col("prior").isNull() | (gap > int(seconds * 1e6))).cast("long"))
    from photonest.operators.order import running_total

    runs = running_total(starts.select("idx", "pos", "new"), [F.col("pos").asc()], F.col("new"), "run")
    first = runs.groupBy("run").agg(F.min_by("idx", "pos").alias("session"))
    return runs.join(first, "run").select("idx", "session")


def scenic_scores(photos: DataFrame, moment_of: DataFrame, place_of: DataFrame) -> DataFrame:
    """``(id, scenic)``: places seen in more moments score higher; 0.5 where that cannot be told."""
    located = photos.where("lat is not null").select("id").join(place_of.select("id", "place_id"), "id").join(moment_of.select("id", "moment_no"), "id")
    notable = located.select("place_id", "moment_no").distinct().groupBy("place_id").agg(F.count("*").alias("k"))
    most = F.broadcast(notable.agg(F.max("k").alias("m")))
    score = F.when(F.col("m") <= 1, 0.5).otherwise(0.3 + 0.7 * (F.col("k") - 1) / (F.col("m") - 1))
    scored = located.join(notable, "place_id").join(most).select("id", score.alias("scenic"))
    return photos.select("id").join(scored, "id", "left").select("id", F.coalesce("scenic", F.lit(0.5)).alias("scenic"))
