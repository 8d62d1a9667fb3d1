"""Representatives of moments and the diverse selection, as windows and bounded top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photonest.functions.expressions import hamming
from photonest.operators.order import numbered
from photonest.session import materialize


#: Parts in which a day is cut down.
PARTS = 16


def representatives(scored: DataFrame, least_size: int = 8, ratio: float = 0.92, bits: int = 12) -> DataFrame:
    """``(moment_no, id, pick_no)``: the best of each moment, and of large ones a second that is good and different.

    ``scored``: moment_no, id, idx, ts, composite, phash.
    """
    # Larger is better: the score, then the earlier time (none is last), then the lower index.
    merit = F.struct("composite", F.col("ts").isNotNull(), -F.unix_micros(F.coalesce(F.col("ts").cast("timestamp"), F.lit(0).cast("timestamp"))), -F.col("idx"))
    # Sums over a moment, so that no moment is sorted in one task.
    best = scored.groupBy("moment_no").agg(F.count("*").alias("size"), F.max_by(F.struct("composite", "phash", "id", "idx"), merit).alias("best"))
    close = F.when(F.col("best.composite") <= 0, True).otherwise(F.try_divide("composite", "best.composite") >= ratio)
    later = scored.join(best.where(F.col("size") >= least_size), "moment_no").where(F.col("idx") != F.col("best.idx"))
    second = later.where(close & (hamming(F.col("phash"), F.col("best.phash")) >= bits)).groupBy("moment_no").agg(F.max_by("id", merit).alias("id"))
    first = best.select("moment_no", F.col("best.id").alias("id"), F.lit(1).alias("pick_no"))
    return first.unionByName(second.select("moment_no", "id", F.lit(2).alias("pick_no")))


def candidates(scored: DataFrame, picks: DataFrame, target: int) -> DataFrame:
    """``(id, pos)``: picks in moment order, filled up to ``target`` with the best of the others."""
    ordered = materialize(numbered(picks, [F.col("moment_no").asc(), F.col("pick_no").asc()], "pos").select("id", "pos"), "picks")
    have = ordered.count()
    want = max(0, min(max(target, 0), scored.count()) - have)
    rest = scored.join(ordered, "id", "left_anti").orderBy(F.desc("composite"), "idx").limit(want)
    # At most ``target`` rows.
    fill = rest.select("id", (F.row_number().over(Window.orderBy(F.desc("composite"), "idx")) + have).cast("long").alias("pos"))
    return ordered.unionByName(fill)


def day_quotas(cands: DataFrame, target: int) -> DataFrame:
    """``(day, day_n, quota)``: an even share for each day, the remainder to the days with the best photos."""
    days = cands.groupBy("day").agg(F.count("*").alias("day_n"), F.max("composite").alias("top"), F.min("pos").alias("first"))
    # One row a day.
    everything = Window.partitionBy()
    goal = F.least(F.lit(max(0, target)).cast("long"), F.sum("day_n").over(everything))
    n = F.count("*").over(everything)
    rank = F.row_number().over(Window.orderBy(F.desc("top"), "first"))
    days = days.select("day", "day_n", goal.alias("goal"), n.alias("n"), rank.alias("rank"))
    quota = F.expr("goal div n") + F.when(F.col("rank") <= F.col("goal") % F.col("n"), 1).otherwise(0)
    return days.select("day", "day_n", "goal", quota.cast("long").alias("quota"))


def select_diverse(cands: DataFrame, target: int = 100, ceiling: float = 1.6) -> DataFrame:
    """Rows of ``cands(id, day, place_id, composite, pos, ts)`` chosen, with ``rank`` from 1."""
    quotas = materialize(day_quotas(cands, target), "quotas", thin=True)
    goal = quotas.agg(F.max("goal")).first()[0] or 0
    by_score = [F.desc("composite"), F.col("pos")]
    # Of a day no more than the best of ``goal`` places and the best 3 * goal + 3 photos can be chosen or decide who is; a day is
    # cut down to those in parts, so that one without dates is not one task's work.
    part = lambda column: F.pmod(F.xxhash64(column), F.lit(PARTS))
    top = lambda rows, column, k: rows.withColumn("_part", part(column)).withColumn(
        "_n", F.row_number().over(Window.partitionBy("day", "_part").orderBy(*by_score))).where(F.col("_n") <= k).drop("_part", "_n")
    every = F.struct(*cands.columns)
    champions = cands.groupBy("day", "place_id").agg(F.max_by(every, F.struct("composite", -F.col("pos"))).alias("r")).select("r.*")
    champions = materialize(top(champions, "place_id", goal + 1), "champions", thin=True)
    others = top(cands, "id", 3 * goal + 3).join(champions.select("id"), "id", "left_anti").select(cands.columns)
    rows = champions.withColumn("_best", F.lit(True)).unionByName(others.withColumn("_best", F.lit(False)))
    rows = rows.join(F.broadcast(quotas.drop("goal")), "day")
    rows = rows.withColumn("_rk", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("_best"), *by_score)))
    rows = rows.withColumn("_s12", F.col("_rk") <= F.col("quota"))
    most = F.greatest(F.col("quota"), F.floor(F.lit(ceiling) * F.col("quota")) + 1)
    left = F.row_number().over(Window.partitionBy("day", "_s12").orderBy(*by_score))
    rows = rows.withColumn("_elig", ~F.col("_s12") & (left <= most - F.least("quota", "day_n")))
    rows = materialize(rows, "selection")
    first = rows.where("_s12")
    have = quotas.agg(F.sum(F.least("quota", "day_n"))).first()[0] or 0
    more = materialize(rows.where("_elig").orderBy(*by_score).limit(max(0, goal - have)), "top-up", thin=True)
    have += more.count()
    rest = rows.where("not _s12").join(more.select("id"), "id", "left_anti").orderBy(*by_score).limit(max(0, goal - have))
    chosen = first.unionByName(more).unionByName(rest.select(first.columns))
    # At most ``target`` rows.
    final = Window.orderBy(F.desc("composite"), F.col("ts").isNull(), "ts", "id")
    return chosen.select(*cands.columns, F.row_number().over(final).alias("rank"))
