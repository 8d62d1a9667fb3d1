"""The whole curation: features in, scored photos and a ranked selection out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonest.functions import expressions as X
from photonest.operators.cluster import moments, places, scenic_scores
from photonest.operators.order import percentile_ranks
from photonest.operators.select import candidates, representatives, select_diverse
from photonest.functions.vision import model_bytes
from photonest.operators.measure import measure_files
from photonest.session import materialize
from photonest.sources.exif import read_exif
from photonest.sources.geocode import name_places
from photonest.sources.images import EXTENSIONS, load_images, plain_path, scan_images

Progress = Callable[[float, str], None]


@dataclass(frozen=True)
class Config:
    """Settings of a run. ``fetch`` looks up places (see ``name_places``); models are paths of ONNX files."""

    target: int = 100
    moment_seconds: float = 120.0
    moment_metres: float = 100.0
    moment_bits: int = 10
    moment_window: int = 40
    place_metres: float = 300.0
    scoring: X.ScoringConfig = field(default_factory=X.ScoringConfig)
    second_from: int = 8
    second_ratio: float = 0.92
    second_bits: int = 12
    ceiling: float = 1.6
    face_model: str | None = None
    eye_model: str | None = None
    fetch: Callable[[float, float], str | None] | None = None
    strict: bool = True


@dataclass(frozen=True)
class Curation:
    """Tables of one run."""

    scored: DataFrame
    moments: DataFrame
    places: DataFrame
    representatives: DataFrame
    selected: DataFrame
    names: DataFrame


def scored_photos(feats: DataFrame, scenic: DataFrame, c: X.ScoringConfig = X.ScoringConfig()) -> DataFrame:
    """``feats`` with ranks, appeal, people, gate, composite and reasons."""
    ranked = percentile_ranks(percentile_ranks(feats, "sharpness", "sharp_rank"), "colorfulness", "color_rank")
    rows = ranked.join(scenic, "id")
    f = {name: F.col(name) for name in (*feats.columns,)}
    rows = rows.withColumn("appeal", X.appeal(f, F.col("sharp_rank"), F.col("color_rank"), c))
    rows = rows.withColumn("people", X.people_score(F.col("faces")) * X.expression_factor(F.col("eye_openness")))
    rows = rows.withColumn("printability", X.printability(X.resolution_score(F.col("width"), F.col("height")), F.col("sharpness"), c))
    rows = rows.withColumn("composite", X.composite(F.col("people"), F.size("faces") > 0, F.col("scenic"), F.col("appeal"), F.col("printability"), c))
    return rows.withColumn("reasons", X.reasons(f, F.col("people"), F.col("scenic"), F.col("printability"), F.col("sharp_rank"), F.col("color_rank")))


def curate(feats: DataFrame, target: int | None = None, config: Config = Config(), progress: Progress | None = None) -> Curation:
    """Features (one row a photo) to a selection of at most ``target``; an empty input selects nothing.

    ``progress`` is told the share done, in [0, 1], before each stage.
    """
    c, target = config, config.target if target is None else target
    tell = progress or (lambda share, message: None)
    tell(0.20, "Measuring photos")
    feats = materialize(feats, "features")
    tell(0.76, "Clustering moments")
    limits = dict(seconds=c.moment_seconds, metres=c.moment_metres, bits=c.moment_bits, window=c.moment_window)
    moment_of = materialize(moments(feats, **limits), "moments")
    tell(0.82, "Scoring places")
    place_of = materialize(places(feats, c.place_metres), "places")
    names = name_places(place_of, feats, c.fetch)
    if c.fetch is not None:
        names = materialize(names, "names", thin=True)
    tell(0.90, "Combining scores")
    scored = materialize(scored_photos(feats, scenic_scores(feats, moment_of, place_of), c.scoring), "scored")
    tell(0.95, "Choosing photos")
    ranked = scored.join(moment_of.select("id", "moment_no"), "id")
    picks = materialize(representatives(ranked, c.second_from, c.second_ratio, c.second_bits), "picks", thin=True)
    pool = candidates(scored, picks, target).join(scored, "id").join(place_of.select("id", "place_id"), "id")
    pool = pool.select("id", "ts", "place_id", "composite", "pos", X.day_key(F.col("ts")).alias("day"))
    selected = materialize(select_diverse(materialize(pool, "pool"), target, c.ceiling), "selected", thin=True)
    tell(1.0, "Done")
    return Curation(scored, moment_of, place_of, picks, selected, names)


def folder_features(spark: SparkSession, folder: str, config: Config = Config()) -> DataFrame:
    """Features of the image files under ``folder``; files are decoded once, and only small rows are joined."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select(plain_path(F.col("path")).alias("path"), "content").where(F.col("path").rlike(EXTENSIONS))
    measured = measure_files(load_images(spark, folder), model_bytes(config.face_model), model_bytes(config.eye_model), config.strict)
    measured = materialize(measured, "measured")
    return scan_images(spark, folder).select("id", "idx", "path").join(measured, "path").join(read_exif(files), "path")


def curate_folder(spark: SparkSession, folder: str, config: Config = Config(), progress: Progress | None = None) -> Curation | None:
    """The whole run over a folder; None if it holds no supported image."""
    tell = progress or (lambda share, message: None)
    tell(0.05, "Loading images")
    found = scan_images(spark, folder).count()
    tell(0.15, f"Found {found} image(s)")
    if not found:
        tell(1.0, "Done")
        return None
    return curate(folder_features(spark, folder, config), config=config, progress=progress)


def summary(run: Curation) -> DataFrame:
    """One row of counts."""
    counts = [
        run.scored.agg(F.count("*").alias("total_photos")), run.moments.agg(F.countDistinct("moment_no").alias("moments")),
        run.places.agg(F.countDistinct("place_id").alias("places")), run.selected.agg(F.count("*").alias("selected")),
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.join(more)
    return out
