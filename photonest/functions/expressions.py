"""Scalar measures of photos as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000.0


@dataclass(frozen=True)
class ScoringConfig:
    people: float = 0.30
    scenic: float = 0.20
    appeal: float = 0.50
    sharpness: float = 0.22
    exposure: float = 0.18
    contrast: float = 0.13
    colorfulness: float = 0.10
    color_cast: float = 0.10
    composition: float = 0.12
    isolation: float = 0.15
    rank_weight: float = 0.35
    gate_floor: float = 0.15


def clip01(x: Column) -> Column:
    """x within [0, 1]; NaN counts as above, as Spark orders it."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_METRES) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def day_key(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("unknown-day"))


def photo_id(path: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the path, without the scheme Spark puts before local paths."""
    return F.substring(F.sha1(F.regexp_replace(path, "^file:(//)?", "")), 1, 16)


def dms_to_degrees(dms: Column, ref: Column) -> Column:
    """Signed degrees of [degrees, minutes, seconds] and a hemisphere letter; null unless there are three parts."""
    value = F.get(dms, F.lit(0)) + F.get(dms, F.lit(1)) / 60.0 + F.get(dms, F.lit(2)) / 3600.0
    south_or_west = F.coalesce(F.upper(F.trim(ref)).rlike("^[SW]"), F.lit(False))
    return F.when(F.size(dms) == 3, F.when(south_or_west, -value).otherwise(value))


def exif_timestamp(tags: list[Column]) -> Column:
    """The first tag that parses, in order; each in either of the two date forms."""
    forms = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(F.trim(t), F.lit(f)).cast("timestamp_ntz") for t in tags for f in forms])


def resolution_score(width: Column, height: Column) -> Column:
    megapixels = width.cast("double") * height / 1e6
    longest, shortest = F.greatest(width, height), F.greatest(F.least(width, height), F.lit(1))
    shape = clip01(F.lit(1.0) - F.greatest(F.lit(0.0), longest / shortest - 1.8))
    return clip01((megapixels - 0.7) / (6.0 - 0.7)) * (F.lit(0.85) + 0.15 * shape)


def blended(absolute: Column, rank: Column | None, weight: float) -> Column:
    """The absolute score mixed with its rank in the batch; without a rank the score itself."""
    if rank is None:
        return absolute
    return F.when(rank.isNull(), absolute).otherwise(clip01((1.0 - weight) * absolute + weight * rank))


def appeal(f: dict[str, Column], sharp_rank: Column | None = None, color_rank: Column | None = None, c: ScoringConfig = ScoringConfig()) -> Column:
    return clip01(
        c.sharpness * blended(f["sharpness"], sharp_rank, c.rank_weight)
        + c.exposure * (1.0 - f["exposure_penalty"])
        + c.contrast * f["contrast"]
        + c.colorfulness * blended(f["colorfulness"], color_rank, c.rank_weight)
        + c.color_cast * f["color_cast"]
        + c.composition * f["composition"]
        + c.isolation * f["subject_isolation"]
    )


def printability(resolution: Column, sharpness: Column, c: ScoringConfig = ScoringConfig()) -> Column:
    factor = clip01(sharpness / c.gate_floor) if c.gate_floor > 0 else F.lit(1.0)
    return clip01(resolution * (F.lit(0.5) + 0.5 * factor))


def expression_factor(openness: Column) -> Column:
    """From the mean of the known eye states; 1 if none is known."""
    known = F.filter(openness, lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)
    return F.when(F.coalesce(F.size(known), F.lit(0)) > 0, F.greatest(F.lit(0.6), F.least(F.lit(1.0), F.lit(0.6) + 0.4 * mean))).otherwise(1.0)


def _face(face: Column) -> Column:
    area = clip01(face["width"] * face["height"] / 0.06)
    off = F.hypot(face["x"] + face["width"] / 2 - 0.5, face["y"] + face["height"] / 2 - 0.5)
    centred = F.lit(0.6) + 0.4 * (1.0 - clip01(off / (0.5**0.5)))
    margin = F.least(face["x"], face["y"], 1.0 - (face["x"] + face["width"]), 1.0 - (face["y"] + face["height"]))
    cropped = F.when(margin < 0, clip01(-margin * 4)).otherwise(0.0)
    return face["confidence"] * area * centred * (1.0 - cropped)


def overlap(a: Column, b: Column) -> Column:
    """Shared area of two boxes over the area of their union; 0 if that is empty."""
    side = lambda at, size: F.greatest(F.lit(0.0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))
    shared = side("x", "width") * side("y", "height")
    union = a["width"] * a["height"] + b["width"] * b["height"] - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def distinct_faces(faces: Column, limit: float = 0.4) -> Column:
    """Faces, most confident first, that overlap no better kept face by more than ``limit``."""
    ranked = F.array_sort(faces, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0))
    clash = lambda kept, f: F.exists(kept, lambda k: overlap(k, f) > limit)
    return F.aggregate(ranked, F.slice(faces, 1, 0), lambda kept, f: F.when(clash(kept, f), kept).otherwise(F.concat(kept, F.array(f))))


def people_score(faces: Column) -> Column:
    n = F.coalesce(F.size(faces), F.lit(0))
    mean = F.aggregate(faces, F.lit(0.0), lambda s, x: s + _face(x)) / n
    return F.when(n > 0, clip01(mean * (F.lit(0.85) + 0.15 * (F.least(n, F.lit(6)) - 1) / 5.0))).otherwise(0.0)


def composite(people: Column, has_faces: Column, scenic: Column, appeal_: Column, gate: Column, c: ScoringConfig = ScoringConfig()) -> Column:
    component = F.when(has_faces, people).otherwise(appeal_)
    return clip01(gate * (c.people * component + c.scenic * scenic + c.appeal * appeal_))


def reasons(f: dict[str, Column], people: Column, scenic: Column, gate: Column, sharp_rank: Column, color_rank: Column) -> Column:
    """The four reasons of highest priority; equals stay in the order of the ladder."""
    n = F.size(f["faces"])
    known = F.filter(f["eye_openness"], lambda x: x.isNotNull())
    eyes = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)
    blink = (F.coalesce(F.size(known), F.lit(0)) > 0) & (eyes < 0.4)
    top = F.coalesce(sharp_rank >= 0.85, F.lit(False))
    vivid = F.coalesce(color_rank >= 0.85, F.lit(False))
    # Priorities and texts shown to users.
    ladder = [
        F.when(n > 0, F.when(blink, _why(3.5, 0, "eyes look closed in at least one face — likely a blink frame"))
               .when(people >= 0.6, _why(3.0, 0, F.concat(n.cast("string"), F.lit(" well-framed face(s) — strong people shot"))))
               .otherwise(_why(1.5, 0, F.concat(n.cast("string"), F.lit(" face(s) detected, but small or off-center"))))),
        F.when(scenic >= 0.7, _why(2.5, 1, "taken at a frequently-revisited location — likely a trip highlight"))
        .when((scenic <= 0.35) & (scenic > 0), _why(0.5, 1, "taken at a one-off spot, not a major trip focal point")),
        F.when(f["sharpness"] >= 0.6, _why(2.0, 2, "sharp focus"))
        .when((f["sharpness"] < 0.25) & top, _why(2.5, 2, "one of the sharpest shots from this batch, even if softer overall"))
        .when(f["sharpness"] < 0.25, _why(4.0, 2, "noticeably soft / blurry")),
        F.when(f["exposure_penalty"] <= 0.15, _why(1.0, 3, "well exposed"))
        .when(f["exposure_penalty"] >= 0.5, _why(3.5, 3, "poor exposure (too dark, blown out, or heavily clipped)")),
        F.when(f["colorfulness"] >= 0.6, _why(1.0, 4, "vivid, colorful scene"))
        .when(vivid, _why(1.0, 4, "one of the most vivid shots from this batch")),
        F.when(f["color_cast"] < 0.4, _why(2.0, 5, "noticeable color cast (white balance looks off)")),
        F.when(f["composition"] >= 0.7, _why(1.0, 6, "well-composed (interest near the rule-of-thirds points)")),
        F.when(f["subject_isolation"] >= 0.7, _why(1.5, 7, "clear, in-focus subject set apart from its surroundings"))
        .when(f["subject_isolation"] < 0.3, _why(0.5, 7, "no clear focal point — interest is scattered or background-sharp")),
        F.when(gate < 0.5, _why(4.5, 8, "limited print quality (low resolution and/or soft focus)")),
    ]
    found = F.filter(F.array(*ladder), lambda x: x.isNotNull())
    texts = F.transform(F.slice(F.array_sort(found), 1, 4), lambda x: x["text"])
    return F.when(F.size(found) > 0, texts).otherwise(F.array(F.lit("average technical quality across the board")))


def _why(priority: float, order: int, text: str | Column) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(F.lit(-priority).alias("low"), F.lit(order).alias("ord"), text.alias("text"))
