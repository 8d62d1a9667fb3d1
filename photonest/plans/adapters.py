"""Photo-shaped relations from the test tables, which hold no images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, idx, ts, lat, lon, width, height, phash)`` from events; the hash is the signs of an embedding, taken in turn."""
    events, vectors = table(spark, sf_dir, "events"), table(spark, sf_dir, "embeddings")
    sign = F.aggregate(
        F.sequence(F.lit(0), F.lit(35)), F.lit(0).cast("long"),
        lambda s, i: s + F.when(F.get("embedding", i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")),
    )
    hashes = vectors.select(F.col("vec_id").alias("_v"), sign.alias("phash"))
    k = F.get_json_object("props", "$.k").cast("int")
    u = F.col("user_id")
    known = u % 10 != 9
    rows = events.join(hashes, F.col("event_id") % max(1, vectors.count()) == F.col("_v"))
    return rows.select(
        F.format_string("p%08d", "event_id").alias("id"),
        F.col("event_id").alias("idx"),
        F.when(F.col("event_id") % 17 != 0, F.col("ts")).alias("ts"),
        F.when(known, F.lit(48.80) + F.lit(0.004) * (u % 15)).alias("lat"),
        F.when(known, F.lit(2.30) + F.lit(0.003) * F.expr("user_id div 15") + F.lit(0.01) * F.expr("user_id div 45")).alias("lon"),
        (F.lit(800) + 40 * k).alias("width"),
        (F.lit(600) + 30 * k).alias("height"),
        "phash",
    )


#: Feature name: multiplier and modulus of the index.
MEASURES = {
    "sharpness": (37, 101), "exposure_penalty": (53, 97), "contrast": (29, 89), "colorfulness": (41, 103),
    "color_cast": (59, 107), "composition": (61, 109), "subject_isolation": (67, 113),
}


def features(shots: DataFrame) -> DataFrame:
    """``shots`` with made-up measures in [0, 1], faces and eye states."""
    i = F.col("idx")
    measures = [((i * a % m) / F.lit(m - 1.0)).alias(c) for c, (a, m) in MEASURES.items()]
    face = lambda f: F.struct(
        ((i * 7 + f * 13) % 60 / F.lit(100.0)).alias("x"), ((i * 11 + f * 17) % 50 / F.lit(100.0)).alias("y"),
        (F.lit(0.1) + (i + f) % 5 / F.lit(20.0)).alias("width"), (F.lit(0.1) + (i + f) % 7 / F.lit(20.0)).alias("height"),
        (F.lit(0.6) + (i * 3 + f) % 40 / F.lit(100.0)).alias("confidence"),
    )
    n = (i % 4).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    eyes = F.transform(numbers, lambda f: F.when((i + f) % 3 != 0, (i * 5 + f) % 11 / F.lit(10.0)))
    return shots.select("*", *measures, F.transform(numbers, face).alias("faces"), eyes.alias("eye_openness"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, idx, ts, day, place_id, composite)`` straight from events, for selection alone."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.format_string("p%08d", "event_id").alias("id"), F.col("event_id").alias("idx"), "ts",
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").alias("place_id"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("composite"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(img_id, height, width, rgb)``: 8 x 8 images whose channels are three embeddings, that of ``vec_id`` and the next two, in a ring."""
    level = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v.cast("double") + 0.55) / 1.1)) * 255).cast("int")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", level).alias("g"))
    n = max(1, e.count())
    rows = e.select(F.col("vec_id").alias("img_id"), F.col("g").alias("g0"))
    for i in (1, 2):
        rows = rows.join(e.select(F.col("vec_id").alias(f"v{i}"), F.col("g").alias(f"g{i}")), (F.col("img_id") + i) % n == F.col(f"v{i}"))
    rgb = F.flatten(F.zip_with(F.zip_with("g0", "g1", lambda a, b: F.array(a, b)), "g2", lambda ab, c: F.concat(ab, F.array(c))))
    return rows.select("img_id", F.lit(8).alias("height"), F.lit(8).alias("width"), rgb.alias("rgb"))
