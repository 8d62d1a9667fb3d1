"""The photo queries on the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonest.functions import expressions as X
from photonest.operators import cluster, select
from photonest.operators.measure import measure_images
from photonest.operators.order import numbered, percentile_ranks
from photonest.plans import adapters as A
from photonest.plans.curation import Curation, curate, scored_photos, summary
from photonest.session import materialize
from photonest.sinks import report

TARGET = 100
r9 = lambda c: F.round(c, 9)


def _feats(spark: SparkSession, sf: str) -> DataFrame:
    return A.features(A.photos(spark, sf))


def percentile_rank_ties(spark: SparkSession, sf: str) -> DataFrame:
    docs = A.table(spark, sf, "documents").select("doc_id", "n_chars")
    return percentile_ranks(docs, "n_chars", "r").select("doc_id", r9("r").alias("rank"))


def percentile_rank_events(spark: SparkSession, sf: str) -> DataFrame:
    return percentile_ranks(A.table(spark, sf, "events").select("event_id", "value"), "value", "r").select("event_id", r9("r").alias("rank"))


def _spots(spark: SparkSession, sf: str) -> DataFrame:
    return A.photos(spark, sf).where("lat is not null").groupBy("lat", "lon").agg(F.min("idx").alias("p"))


def haversine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.near_points(_spots(spark, sf), 1000.0).select("p", "q", F.round("d", 6).alias("metres"))


def hamming_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = A.photos(spark, sf).select("idx", "phash")
    q = p.select((F.col("idx") - 1).alias("idx"), F.col("phash").alias("other"))
    return p.join(q, "idx").select("idx", X.hamming(F.col("phash"), F.col("other")).cast("long").alias("bits"))


def resolution_score(spark: SparkSession, sf: str) -> DataFrame:
    return A.photos(spark, sf).select("idx", r9(X.resolution_score(F.col("width"), F.col("height"))).alias("resolution"))


def _cols(df: DataFrame) -> dict:
    return {c: F.col(c) for c in df.columns}


def printability(spark: SparkSession, sf: str) -> DataFrame:
    f = _feats(spark, sf)
    return f.select("idx", r9(X.printability(X.resolution_score(F.col("width"), F.col("height")), F.col("sharpness"))).alias("gate"))


def appeal(spark: SparkSession, sf: str) -> DataFrame:
    f = _feats(spark, sf)
    return f.select("idx", r9(X.appeal(_cols(f))).alias("appeal"))


def people_score(spark: SparkSession, sf: str) -> DataFrame:
    return _feats(spark, sf).select("idx", r9(X.people_score(F.col("faces"))).alias("people"))


def expression_factor(spark: SparkSession, sf: str) -> DataFrame:
    return _feats(spark, sf).select("idx", r9(X.expression_factor(F.col("eye_openness"))).alias("factor"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    f = _feats(spark, sf)
    scenic = f.select("id", (F.lit(0.3) + (F.col("idx") * 71 % 127) / 126.0 * 0.7).alias("scenic"))
    return scored_photos(f, scenic)


def composite(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("idx", r9("composite").alias("composite"))


def reasons_top4(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("idx", F.array_join("reasons", "; ").alias("reasons"))


def moment_candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.candidate_pairs(A.photos(spark, sf)).select(F.col("a.idx").alias("a"), F.col("b.idx").alias("b"))


def moment_edges(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.moment_edges(A.photos(spark, sf)).select(F.col("src").alias("a"), F.col("dst").alias("b"))


def moments(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.moments(A.photos(spark, sf)).select("idx", "moment_id")


def places(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.places(A.photos(spark, sf)).select("idx", "place_id")


def time_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.time_sessions(A.photos(spark, sf))


def scenic_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = A.photos(spark, sf)
    m = p.select("id", F.expr("idx div 7").alias("moment_no"))
    place = p.where("lat is not null").select("id", F.concat(F.lit("c"), F.round(F.col("lat") * 1000).cast("long").cast("string"), F.lit("_"), F.round(F.col("lon") * 1000).cast("long").cast("string")).alias("place_id"))
    return p.select("id", "idx").join(cluster.scenic_scores(p, m, place), "id").select("idx", r9("scenic").alias("scenic"))


def _toy_groups(spark: SparkSession, sf: str) -> DataFrame:
    s = A.scores(spark, sf).join(A.photos(spark, sf).select("id", "phash"), "id")
    return s.withColumn("moment_no", F.expr("idx div 12"))


def representatives(spark: SparkSession, sf: str) -> DataFrame:
    return select.representatives(_toy_groups(spark, sf)).select("moment_no", "id", "pick_no")


def candidates_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Picks of every group, filled up to a quarter of all rows."""
    rows = _toy_groups(spark, sf)
    return select.candidates(rows, select.representatives(rows), rows.count() // 4).select("id", F.col("pos").cast("long").alias("pos"))


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    return A.scores(spark, sf).withColumn("pos", F.col("idx"))


def day_quotas(spark: SparkSession, sf: str) -> DataFrame:
    return select.day_quotas(_pool(spark, sf), TARGET).select("day", "day_n", "quota")


def diverse_selection(spark: SparkSession, sf: str) -> DataFrame:
    return select.select_diverse(_pool(spark, sf), TARGET).select("id", F.col("rank").cast("long").alias("rank"))


def places_summary(spark: SparkSession, sf: str) -> DataFrame:
    pool = _pool(spark, sf)
    chosen = select.select_diverse(pool, TARGET).select("id", F.lit(1).alias("hit"))
    counts = pool.join(chosen, "id", "left").groupBy("place_id")
    return counts.agg(F.count("*").alias("photo_count"), F.count("hit").alias("selected_count"))


def _images(spark: SparkSession, sf: str) -> DataFrame:
    return measure_images(A.images(spark, sf))


def _measure(*names: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _images(spark, sf).select("img_id", *[F.round(n, 9).alias(n) for n in names])

    return query


def saliency_and_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _images(spark, sf).select("img_id", F.round("subject_isolation", 6).alias("subject_isolation"), "phash")


def saliency_8(spark: SparkSession, sf: str) -> DataFrame:
    return measure_images(A.images(spark, sf), 8).select("img_id", F.round("subject_isolation", 6).alias("subject_isolation"))


def perceptual_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _images(spark, sf).select("img_id", "phash")


def dms_to_degrees(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    dms = F.when(u % 5 != 4, F.array((u % 90).cast("double"), (u * 7 % 60).cast("double"), (u * 13 % 6000) / 100.0))
    ref = F.when(u % 3 == 0, F.lit(" s")).when(u % 3 == 1, F.lit("North"))
    return A.table(spark, sf, "events").select("event_id", (r9(X.dms_to_degrees(dms, ref)) + F.lit(0.0)).alias("degrees"))


def exif_timestamp_parse(spark: SparkSession, sf: str) -> DataFrame:
    i, ts = F.col("event_id"), F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    first = F.when(i % 3 == 0, F.lit("not a date")).when(i % 3 == 1, F.date_format(ts, "yyyy:MM:dd HH:mm:ss"))
    second = F.when(i % 5 != 0, F.concat(F.lit(" "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" ")))
    parsed = X.exif_timestamp([first, second])
    return A.table(spark, sf, "events").select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("taken"))


def photo_ids(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "pages").select("page_id", X.photo_id(F.col("url")).alias("id"))


def global_row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return numbered(c, [F.col("c_acctbal").desc(), F.col("c_custkey").asc()], "n").select("c_custkey", F.col("n").cast("long").alias("n"))


def geocode_label_pick(spark: SparkSession, sf: str) -> DataFrame:
    from photonest.sources.geocode import label_of

    n = A.table(spark, sf, "nation").join(A.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in ("country", "locality", "neighborhood", "route")]), (k % 4 + 1).cast("int"))
    result = lambda name, types: F.struct(name.alias("formatted_address"), types.alias("types"))
    results = F.array(result(F.col("r_name"), F.array(F.lit("political"), F.lit("country"))), result(F.col("n_name"), F.array(kind)))
    payload = F.to_json(F.struct(F.when(k % 5 == 4, "ZERO_RESULTS").otherwise("OK").alias("status"), results.alias("results")))
    return n.select("n_nationkey", label_of(payload).alias("label"))


def final_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    run = curate(_feats(spark, sf), TARGET)
    return run.selected.select("id", r9("composite").alias("composite"), F.col("place_id"), F.col("rank").cast("long").alias("rank"))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary(curate(_feats(spark, sf), TARGET))


def distinct_faces(spark: SparkSession, sf: str) -> DataFrame:
    kept = X.distinct_faces(F.col("faces"))
    sure = F.aggregate("kept", F.lit(0.0), lambda s, f: s + f["confidence"])
    return _feats(spark, sf).select("idx", kept.alias("kept")).select("idx", F.size("kept").cast("long").alias("n"), r9(sure).alias("confidence"))


def named_places(spark: SparkSession, sf: str) -> DataFrame:
    from photonest.sources.geocode import name_places

    def lookup(lat: float, lon: float) -> str | None:
        x, y = math.floor(lat * 100 + 0.2371), math.floor(lon * 100 + 0.2371)
        status = "ZERO_RESULTS" if x % 4 == 0 else "OK"
        return json.dumps({"status": status, "results": [{"formatted_address": "land", "types": ["country"]}, {"formatted_address": f"{x}/{y}", "types": ["locality"]}]})

    shots = materialize(A.photos(spark, sf), "shots")
    return name_places(materialize(cluster.places(shots), "places"), shots, lookup)


def _run(spark: SparkSession, sf: str) -> Curation:
    return curate(_feats(spark, sf), TARGET)


def moment_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.moment_table(_run(spark, sf)).select("moment_id", "photo_count", "representative_count", "first_id")


def place_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.place_table(_run(spark, sf)).select("place_id", "photo_count", "selected_count", "first_idx")


def selected_report(spark: SparkSession, sf: str) -> DataFrame:
    scores = [r9(c).alias(c) for c in report.SCORES]
    taken, rank = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("rank").cast("long")
    return report.selected_table(_run(spark, sf)).select("id", rank.alias("rank"), taken.alias("taken"), "place_id", *scores, F.array_join("reasons", "|").alias("reasons"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        percentile_rank_ties, percentile_rank_events, haversine_pairs, hamming_pairs, resolution_score, printability, appeal,
        people_score, expression_factor, composite, reasons_top4, moment_candidate_pairs, moment_edges, moments, places,
        time_sessions, scenic_scores, representatives, candidates_filled, day_quotas, diverse_selection, places_summary,
        saliency_and_hash, dms_to_degrees, exif_timestamp_parse, photo_ids, global_row_numbers, geocode_label_pick, final_pipeline, run_summary,
        saliency_8, perceptual_hash, distinct_faces, named_places, moment_report, place_report, selected_report,
    )
} | {
    "laplacian_variance": _measure("sharpness"),
    "exposure": _measure("brightness", "contrast", "clipping", "exposure_penalty"),
    "colorfulness": _measure("colorfulness"),
    "color_cast": _measure("color_cast"),
    "composition_grid": _measure("composition"),
}

# --- SQL -------------------------------------------------------------------------------------------------

_PHOTOS = """h AS (
  SELECT vec_id, CAST(list_sum([CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << i) ELSE 0 END FOR i IN range(36)]) AS BIGINT) AS phash
  FROM embeddings),
photos AS (
  SELECT printf('p%08d', event_id) AS id, event_id AS idx, CASE WHEN event_id % 17 <> 0 THEN ts END AS ts,
    CASE WHEN user_id % 10 <> 9 THEN 48.80::DOUBLE + 0.004::DOUBLE * (user_id % 15) END AS lat,
    CASE WHEN user_id % 10 <> 9 THEN 2.30::DOUBLE + 0.003::DOUBLE * (user_id // 15) + 0.01::DOUBLE * (user_id // 45) END AS lon,
    800 + 40 * CAST(json_extract_string(props, '$.k') AS INT) AS width, 600 + 30 * CAST(json_extract_string(props, '$.k') AS INT) AS height, phash
  FROM events JOIN h ON event_id % (SELECT count(*) FROM embeddings) = vec_id)"""
_MEASURES = ", ".join(f"(idx * {a} % {m}) / {m - 1}.0::DOUBLE AS {c}" for c, (a, m) in A.MEASURES.items())
_C01 = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))".format
_RES = (
    _C01("(width::DOUBLE * height / 1e6 - 0.7::DOUBLE) / (6.0::DOUBLE - 0.7::DOUBLE)")
    + " * (0.85::DOUBLE + 0.15::DOUBLE * " + _C01("1.0::DOUBLE - greatest(0.0::DOUBLE, greatest(width, height) / greatest(least(width, height), 1) - 1.8::DOUBLE)") + ")"
)
_GATE = _C01(f"({_RES}) * (0.5::DOUBLE + 0.5::DOUBLE * {_C01('sharpness / 0.15::DOUBLE')})")
_FEATS = f"{_PHOTOS}, feats AS (SELECT *, {_MEASURES} FROM photos)"


def _appeal_sql(sharp: str, color: str) -> str:
    return _C01(
        f"0.22::DOUBLE * {sharp} + 0.18::DOUBLE * (1 - exposure_penalty) + 0.13::DOUBLE * contrast + 0.10::DOUBLE * {color}"
        " + 0.10::DOUBLE * color_cast + 0.12::DOUBLE * composition + 0.15::DOUBLE * subject_isolation"
    )


_FACES = f"""faces AS (
  SELECT idx, f, (idx * 7 + f * 13) % 60 / 100.0::DOUBLE AS x, (idx * 11 + f * 17) % 50 / 100.0::DOUBLE AS y,
    0.1::DOUBLE + (idx + f) % 5 / 20.0::DOUBLE AS w, 0.1::DOUBLE + (idx + f) % 7 / 20.0::DOUBLE AS hh, 0.6::DOUBLE + (idx * 3 + f) % 40 / 100.0::DOUBLE AS conf,
    CASE WHEN (idx + f) % 3 <> 0 THEN (idx * 5 + f) % 11 / 10.0::DOUBLE END AS eye
  FROM (SELECT idx, unnest(range(idx % 4)) AS f FROM photos)),
face_scores AS (
  SELECT idx, count(*) AS n, avg(eye) AS eyes, avg(conf * {_C01('w * hh / 0.06::DOUBLE')}
      * (0.6::DOUBLE + 0.4::DOUBLE * (1 - {_C01('sqrt(pow(x + w / 2 - 0.5, 2) + pow(y + hh / 2 - 0.5, 2)) / sqrt(0.5::DOUBLE)')}))
      * (1 - CASE WHEN least(x, y, 1 - (x + w), 1 - (y + hh)) < 0 THEN {_C01('-4 * least(x, y, 1 - (x + w), 1 - (y + hh))')} ELSE 0 END)) AS m
  FROM faces GROUP BY idx),
people AS (
  SELECT p.idx, coalesce(n, 0) AS n, eyes, CASE WHEN n > 0 THEN {_C01('m * (0.85::DOUBLE + 0.15::DOUBLE * (least(n, 6) - 1) / 5.0)')} ELSE 0.0::DOUBLE END AS people,
    CASE WHEN eyes IS NULL THEN 1.0::DOUBLE ELSE greatest(0.6::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE + 0.4::DOUBLE * eyes)) END AS factor
  FROM photos p LEFT JOIN face_scores USING (idx))"""


def _rank_sql(value: str, over: str = "") -> str:
    return f"(rank() OVER (ORDER BY {value}) - 1 + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0) / (count(*) OVER () - 1)"


def _scored_sql(scenic: str) -> str:
    blend = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.65::DOUBLE * {0} + 0.35::DOUBLE * {1}))".format
    return f"""ranked AS (SELECT *, {_rank_sql('sharpness')} AS sr, {_rank_sql('colorfulness')} AS cr FROM feats),
scored AS (
  SELECT *, {_C01("gate * (0.30::DOUBLE * CASE WHEN n > 0 THEN ppl ELSE appeal END + 0.20::DOUBLE * scenic + 0.50::DOUBLE * appeal)")} AS composite
  FROM (SELECT r.*, p.n, p.eyes, p.people * p.factor AS ppl, {scenic} AS scenic, {_GATE} AS gate, {_appeal_sql(blend('sharpness', 'sr'), blend('colorfulness', 'cr'))} AS appeal
        FROM ranked r JOIN people p USING (idx)))"""


_TOY_SCENIC = "0.3::DOUBLE + (idx * 71 % 127) / 126.0::DOUBLE * 0.7::DOUBLE"
_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))".format
_PAIRS = """placed AS (SELECT *, row_number() OVER (ORDER BY ts IS NULL, ts, idx) AS pos, max(ts) OVER () AS last FROM photos),
pairs AS (
  SELECT a.idx AS a, b.idx AS b, a.ts AS ta, b.ts AS tb, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon, a.phash AS ha, b.phash AS hb
  FROM (SELECT *, unnest(range(pos + 1, pos + 41)) AS nxt FROM placed) a JOIN placed b ON b.pos = a.nxt
  WHERE a.ts IS NULL OR coalesce(b.ts, a.last) - a.ts <= INTERVAL 4800 SECOND)"""
_EDGES = f"""{_PAIRS}, edges AS (
  SELECT a, b FROM pairs WHERE (ta IS NOT NULL AND tb IS NOT NULL AND tb - ta <= INTERVAL 120 SECOND
    AND (alat IS NULL OR blat IS NULL OR {_HAV(a='a', b='b')} <= 100)) OR bit_count(xor(ha, hb)) <= 10)"""
_MOMENTS = f"""{_EDGES}, links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT p.idx, p.id, p.ts, coalesce(m.root, p.idx) AS root FROM photos p LEFT JOIN (SELECT a, min(b) AS root FROM reach GROUP BY a) m ON m.a = p.idx),
moment_no AS (SELECT root, row_number() OVER (ORDER BY min(ts) IS NULL, min(ts), min(idx)) - 1 AS moment_no FROM roots GROUP BY root),
moments AS (SELECT idx, id, moment_no, printf('moment-%04d', moment_no) AS moment_id FROM roots JOIN moment_no USING (root))"""


def _spots_sql(metres: int) -> str:
    return f"""spots AS (SELECT lat, lon, min(idx) AS p FROM photos WHERE lat IS NOT NULL GROUP BY lat, lon),
spairs AS (SELECT a.p, b.p AS q, {_HAV(a='a.', b='b.')} AS d FROM spots a JOIN spots b ON a.p < b.p WHERE {_HAV(a='a.', b='b.')} <= {metres})"""


_PLACES = f"""{_spots_sql(300)}, slinks AS (SELECT p, q FROM spairs UNION SELECT q, p FROM spairs),
sreach(p, q) AS (SELECT p, p FROM spots UNION SELECT r.p, l.q FROM sreach r JOIN slinks l ON l.p = r.q),
sroots AS (SELECT p, min(q) AS root FROM sreach GROUP BY p),
places AS (
  SELECT ph.idx, ph.id, printf('place-%04d', dense_rank() OVER (ORDER BY root) - 1) AS place_id FROM photos ph JOIN spots s ON ph.lat = s.lat AND ph.lon = s.lon JOIN sroots r ON r.p = s.p
  UNION ALL SELECT idx, id, 'place-unknown-' || id FROM photos WHERE lat IS NULL)"""
_SCORES = """pool AS (SELECT printf('p%08d', event_id) AS id, event_id AS idx, event_id AS pos, ts, strftime(ts, '%Y-%m-%d') AS day, user_id AS place_id, least(1.0, value / 500) AS composite FROM events)"""
_REPS = """byrank AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY moment_no) AS size, first_value(composite) OVER w AS bs, first_value(phash) OVER w AS bh
  FROM {rows} WINDOW w AS (PARTITION BY moment_no ORDER BY composite DESC, ts IS NULL, ts, idx)),
reps AS (
  SELECT moment_no, id, 1 AS pick_no FROM byrank WHERE rn = 1
  UNION ALL SELECT moment_no, id, 2 FROM (
    SELECT moment_no, id, row_number() OVER (PARTITION BY moment_no ORDER BY rn) AS k FROM byrank
    WHERE size >= 8 AND rn > 1 AND (bs <= 0 OR composite / bs >= 0.92::DOUBLE) AND bit_count(xor(phash, bh)) >= 12) WHERE k = 1)""".format
_TOY = f"{_PHOTOS}, {_SCORES}, toy AS (SELECT pool.*, photos.phash, pool.idx // 12 AS moment_no FROM pool JOIN photos USING (idx))"


def _fill_sql(rows: str, target: str = str(TARGET)) -> str:
    return f"""first_pos AS (SELECT id, row_number() OVER (ORDER BY moment_no, pick_no) AS pos FROM reps),
cands AS (SELECT id, pos FROM first_pos UNION ALL
  SELECT id, pos FROM (SELECT id, row_number() OVER (ORDER BY composite DESC, idx) + (SELECT count(*) FROM first_pos) AS pos FROM {rows} WHERE id NOT IN (SELECT id FROM first_pos))
  WHERE pos <= least({target}, (SELECT count(*) FROM {rows})))"""


_QUOTAS = f"""days AS (SELECT day, count(*) AS day_n, max(composite) AS top, min(pos) AS first FROM pool GROUP BY day),
goal AS (SELECT least({TARGET}, count(*)) AS t FROM pool),
quotas AS (SELECT day, day_n, t // (count(*) OVER ()) + CASE WHEN row_number() OVER (ORDER BY top DESC, first) <= t % (count(*) OVER ()) THEN 1 ELSE 0 END AS quota FROM days, goal)"""
_SELECT = f"""{_QUOTAS},
s1 AS (SELECT p.*, quota, day_n, row_number() OVER (PARTITION BY p.day, place_id ORDER BY composite DESC, pos) = 1 AS best FROM pool p JOIN quotas USING (day)),
s2 AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY best DESC, composite DESC, pos) <= quota AS s12 FROM s1),
s3 AS (SELECT *, NOT s12 AND row_number() OVER (PARTITION BY day, s12 ORDER BY composite DESC, pos) <= greatest(quota, floor(1.6::DOUBLE * quota)::BIGINT + 1) - least(quota, day_n) AS elig FROM s2),
s4 AS (SELECT *, elig AND row_number() OVER (PARTITION BY elig ORDER BY composite DESC, pos) <= (SELECT t FROM goal) - (SELECT count(*) FROM s2 WHERE s12) AS s3 FROM s3),
s5 AS (SELECT *, NOT (s12 OR s3) AND row_number() OVER (PARTITION BY s12 OR s3 ORDER BY composite DESC, pos) <= (SELECT t FROM goal) - (SELECT count(*) FROM s4 WHERE s12 OR s3) AS s6 FROM s4),
chosen AS (SELECT *, row_number() OVER (ORDER BY composite DESC, ts IS NULL, ts, id) AS rank FROM s5 WHERE s12 OR s3 OR s6)"""
_PIX = """e AS (SELECT vec_id AS v, [floor(greatest(0.0, least(1.0, (x::DOUBLE + 0.55) / 1.1)) * 255) FOR x IN embedding] AS g FROM embeddings), es AS (SELECT count(*) AS n FROM embeddings),
px AS (
  SELECT a.v AS img_id, i // 8 AS y, i % 8 AS x, a.g[i + 1] AS r, b.g[i + 1] AS g, c.g[i + 1] AS b
  FROM e a JOIN e b ON b.v = (a.v + 1) % (SELECT n FROM es) JOIN e c ON c.v = (a.v + 2) % (SELECT n FROM es), range(64) t(i)),
gr AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS l FROM px)"""
_CAST = f"""WITH {_PIX.replace('0.299 * r + 0.587 * g + 0.114 * b', '0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b')},
u AS (SELECT *, quantile_cont(l, 0.95) OVER (PARTITION BY img_id) AS cut FROM gr WHERE l < 250),
t AS (SELECT img_id, avg(greatest(r, g, b) - least(r, g, b)) AS chroma, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM u WHERE l >= cut - 1e-9 GROUP BY img_id),
v AS (SELECT *, (mr + mg + mb) / 3 AS m FROM t)
SELECT img_id, round(CASE WHEN chroma > 40 OR m = 0 THEN 1.0 ELSE greatest(0, least(1, 1 - sqrt((pow(mr / m - 1, 2) + pow(mg / m - 1, 2) + pow(mb / m - 1, 2)) / 3) * 255 / 40)) END, 9) AS color_cast FROM v"""
_COMPOSITION = f"""WITH {_PIX},
d AS (SELECT a.img_id, a.y, a.x, abs(coalesce(h.l, a.l) - a.l) + abs(coalesce(v.l, a.l) - a.l) AS m FROM gr a
  LEFT JOIN gr h ON h.img_id = a.img_id AND h.y = a.y AND h.x = a.x + 1 LEFT JOIN gr v ON v.img_id = a.img_id AND v.x = a.x AND v.y = a.y + 1),
c AS (SELECT img_id, CASE WHEN y < 2 THEN 0 WHEN y < 5 THEN 1 ELSE 2 END AS cy, CASE WHEN x < 2 THEN 0 WHEN x < 5 THEN 1 ELSE 2 END AS cx, sum(m) AS s FROM d GROUP BY ALL),
p AS (SELECT img_id, cy, cx, s / sum(s) OVER (PARTITION BY img_id) AS q FROM c)
SELECT img_id, round(greatest(0, least(1, 0.6 * least(1, sum(CASE WHEN cy <> 1 AND cx <> 1 THEN q ELSE 0 END) / 0.55)
  + 0.4 * greatest(0, least(1, (1 + sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) / ln(9)) / 0.03)))), 9) AS composition FROM p GROUP BY img_id"""
_BOX3 = "(SELECT {t}.img_id, {t}.y, {t}.x, sum(n.{v}) / 9 AS {v} FROM {t}, range(-1, 2) a(dy), range(-1, 2) b(dx), {t} n WHERE n.img_id = {t}.img_id AND n.y = greatest(0, least(7, {t}.y + dy)) AND n.x = greatest(0, least(7, {t}.x + dx)) GROUP BY ALL)".format
def _box3_sql(table: str, value: str, last: int) -> str:
    """Means over 3 x 3 with edges repeated, rows first."""
    return f"""(SELECT img_id, y, x, (c + CASE WHEN y = 0 THEN c ELSE up END + CASE WHEN y = {last} THEN c ELSE down END) / 9 AS {value} FROM (
  SELECT img_id, y, x, r AS c, lag(r) OVER w AS up, lead(r) OVER w AS down FROM (
    SELECT img_id, y, x, {value} + CASE WHEN x = 0 THEN {value} ELSE lag({value}) OVER v END + CASE WHEN x = {last} THEN {value} ELSE lead({value}) OVER v END AS r
    FROM {table} WINDOW v AS (PARTITION BY img_id, y ORDER BY x)) WINDOW w AS (PARTITION BY img_id, x ORDER BY y)))"""


_TURN = "2 * pi() * (a.y * b.y + a.x * b.x) / 8"
_SALIENCY = f"""WITH {_PIX.replace('0.299 * r + 0.587 * g + 0.114 * b', '0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b')},
cell AS (SELECT i // 8 AS y, i % 8 AS x FROM range(64) t(i)),
ft AS (SELECT img_id, b.y, b.x, sum(l * cos({_TURN})) AS re, -sum(l * sin({_TURN})) AS im FROM gr a, cell b GROUP BY ALL),
lg AS (SELECT *, ln(sqrt(re * re + im * im) + 1e-8) AS v FROM ft),
rs AS (SELECT lg.img_id, lg.y, lg.x, exp(lg.v - s.v) * re / sqrt(re * re + im * im) AS re, exp(lg.v - s.v) * im / sqrt(re * re + im * im) AS im
  FROM lg JOIN {_BOX3(t='lg', v='v')} s USING (img_id, y, x)),
bk AS (SELECT img_id, b.y, b.x, pow(sum(re * cos({_TURN}) - im * sin({_TURN})) / 64, 2) + pow(sum(re * sin({_TURN}) + im * cos({_TURN})) / 64, 2) AS v FROM rs a, cell b GROUP BY ALL),
sm AS (SELECT img_id, y, x, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS s FROM {_BOX3(t='bk', v='v')} WINDOW w AS (PARTITION BY img_id)),
gd AS (SELECT a.img_id, a.y, a.x, floor(least(255, abs(coalesce(h.l, a.l) - a.l) + abs(coalesce(v.l, a.l) - a.l))) AS m FROM gr a
  LEFT JOIN gr h ON h.img_id = a.img_id AND h.y = a.y AND h.x = a.x + 1 LEFT JOIN gr v ON v.img_id = a.img_id AND v.x = a.x AND v.y = a.y + 1),
z AS (SELECT img_id, s, m, s / sum(s) OVER (PARTITION BY img_id) AS p FROM sm JOIN {_BOX3(t='gd', v='m')} USING (img_id, y, x))
SELECT img_id, round(greatest(0, least(1, (greatest(0, least(1, 1 + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(64))) + (corr(s, m) + 1) / 2) / 2)), 6) AS subject_isolation FROM z GROUP BY img_id"""
# The same at 64 x 64, with the transform one axis at a time.
_SALIENCY_64 = f"""WITH {_PIX.replace('0.299 * r + 0.587 * g + 0.114 * b', '0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b')},
tap AS (SELECT j, i, w / sum(w) OVER (PARTITION BY j) AS w FROM (SELECT j, i, greatest(0, 1 - abs(i + 0.5::DOUBLE - (j + 0.5::DOUBLE) / 8)) AS w FROM range(64) a(j), range(8) b(i)) WHERE w > 0),
gd AS (SELECT a.img_id, a.y, a.x, a.l, abs(coalesce(h.l, a.l) - a.l) + abs(coalesce(v.l, a.l) - a.l) AS m FROM gr a
  LEFT JOIN gr h ON h.img_id = a.img_id AND h.y = a.y AND h.x = a.x + 1 LEFT JOIN gr v ON v.img_id = a.img_id AND v.x = a.x AND v.y = a.y + 1),
by8 AS (SELECT img_id, y, x, floor(greatest(0, least(255, l))) AS l, floor(greatest(0, least(255, m))) AS m FROM gd),
wide AS (SELECT img_id, y, j AS x, round_even(greatest(0, least(255, sum(l * w))), 0) AS l, round_even(greatest(0, least(255, sum(m * w))), 0) AS m FROM by8 JOIN tap ON i = by8.x GROUP BY ALL),
big AS (SELECT img_id, j AS y, x, round_even(greatest(0, least(255, sum(l * w))), 0) AS l, round_even(greatest(0, least(255, sum(m * w))), 0) AS m FROM wide JOIN tap ON i = wide.y GROUP BY ALL),
tw AS (SELECT k, cos(2 * pi() * k / 64) AS c, sin(2 * pi() * k / 64) AS s FROM range(64) t(k)), ax AS (SELECT f::BIGINT AS f FROM range(64) t(f)),
f1 AS (SELECT img_id, y, f AS u, sum(l * c) AS re, -sum(l * s) AS im FROM big, ax, tw WHERE k = (f * x) % 64 GROUP BY ALL),
ft AS (SELECT img_id, f AS y, u AS x, sum(re * c + im * s) AS re, sum(im * c - re * s) AS im FROM f1, ax, tw WHERE k = (f * f1.y) % 64 GROUP BY ALL),
am AS (SELECT *, CASE WHEN a < 1e-9 * max(a) OVER (PARTITION BY img_id) THEN 0 ELSE a END AS z FROM (SELECT *, sqrt(re * re + im * im) AS a FROM ft)),
lg AS (SELECT *, ln(z + 1e-8) AS v FROM am),
rs AS (SELECT lg.img_id, lg.y, lg.x, exp(lg.v - s.v) * CASE WHEN z = 0 THEN 1 ELSE re / a END AS re, exp(lg.v - s.v) * CASE WHEN z = 0 THEN 0 ELSE im / a END AS im FROM lg JOIN {_box3_sql('lg', 'v', 63)} s USING (img_id, y, x)),
b1 AS (SELECT img_id, y, f AS u, sum(re * c - im * s) AS re, sum(im * c + re * s) AS im FROM rs, ax, tw WHERE k = (f * x) % 64 GROUP BY ALL),
bk AS (SELECT img_id, f AS y, u AS x, pow(sum(re * c - im * s) / 4096, 2) + pow(sum(im * c + re * s) / 4096, 2) AS v FROM b1, ax, tw WHERE k = (f * b1.y) % 64 GROUP BY ALL),
sm AS (SELECT img_id, y, x, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS s FROM {_box3_sql('bk', 'v', 63)} WINDOW w AS (PARTITION BY img_id)),
z AS (SELECT img_id, s, m, s / sum(s) OVER (PARTITION BY img_id) AS p FROM sm JOIN {_box3_sql('big', 'm', 63)} USING (img_id, y, x))
SELECT img_id, round(greatest(0, least(1, (greatest(0, least(1, 1 + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(4096))) + (corr(s, m) + 1) / 2) / 2)), 6) AS subject_isolation FROM z GROUP BY img_id"""
_HASH = f"""WITH {_PIX}, luma AS (SELECT img_id, y, x, ((r * 19595 + g * 38470 + b * 7471 + 32768)::BIGINT >> 16) AS l FROM px),
k AS (SELECT j, x, CASE WHEN abs(d) < 1e-12 THEN 1.0::DOUBLE WHEN abs(d) < 3 THEN sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) ELSE 0.0::DOUBLE END AS w
  FROM (SELECT j, x, x + 0.5::DOUBLE - (j + 0.5::DOUBLE) * 8 / 9 AS d FROM range(9) t(j), range(8) u(x))),
row9 AS (SELECT img_id, y, j, round(greatest(0, least(255, sum(l * w) / sum(w)))) AS v FROM luma JOIN k USING (x) GROUP BY ALL),
bits AS (SELECT a.img_id, sum(CASE WHEN a.v > b.v THEN (1::HUGEINT << (63 - (8 * a.y + a.j))::INT) ELSE 0 END) AS h FROM row9 a JOIN row9 b ON b.img_id = a.img_id AND b.y = a.y AND b.j = a.j + 1 GROUP BY a.img_id)
SELECT img_id, (h - CASE WHEN h >= (1::HUGEINT << 63) THEN (1::HUGEINT << 64) ELSE 0 END)::BIGINT AS phash FROM bits"""
_REASONS = [
    "CASE WHEN n > 0 THEN CASE WHEN eyes < 0.4 THEN {'p': -3.5, 'o': 0, 't': 'eyes look closed in at least one face — likely a blink frame'} WHEN ppl >= 0.6 THEN {'p': -3.0, 'o': 0, 't': n || ' well-framed face(s) — strong people shot'} ELSE {'p': -1.5, 'o': 0, 't': n || ' face(s) detected, but small or off-center'} END END",
    "CASE WHEN scenic >= 0.7 THEN {'p': -2.5, 'o': 1, 't': 'taken at a frequently-revisited location — likely a trip highlight'} WHEN scenic <= 0.35 AND scenic > 0 THEN {'p': -0.5, 'o': 1, 't': 'taken at a one-off spot, not a major trip focal point'} END",
    "CASE WHEN sharpness >= 0.6 THEN {'p': -2.0, 'o': 2, 't': 'sharp focus'} WHEN sharpness < 0.25 AND sr >= 0.85 THEN {'p': -2.5, 'o': 2, 't': 'one of the sharpest shots from this batch, even if softer overall'} WHEN sharpness < 0.25 THEN {'p': -4.0, 'o': 2, 't': 'noticeably soft / blurry'} END",
    "CASE WHEN exposure_penalty <= 0.15 THEN {'p': -1.0, 'o': 3, 't': 'well exposed'} WHEN exposure_penalty >= 0.5 THEN {'p': -3.5, 'o': 3, 't': 'poor exposure (too dark, blown out, or heavily clipped)'} END",
    "CASE WHEN colorfulness >= 0.6 THEN {'p': -1.0, 'o': 4, 't': 'vivid, colorful scene'} WHEN cr >= 0.85 THEN {'p': -1.0, 'o': 4, 't': 'one of the most vivid shots from this batch'} END",
    "CASE WHEN color_cast < 0.4 THEN {'p': -2.0, 'o': 5, 't': 'noticeable color cast (white balance looks off)'} END",
    "CASE WHEN composition >= 0.7 THEN {'p': -1.0, 'o': 6, 't': 'well-composed (interest near the rule-of-thirds points)'} END",
    "CASE WHEN subject_isolation >= 0.7 THEN {'p': -1.5, 'o': 7, 't': 'clear, in-focus subject set apart from its surroundings'} WHEN subject_isolation < 0.3 THEN {'p': -0.5, 'o': 7, 't': 'no clear focal point — interest is scattered or background-sharp'} END",
    "CASE WHEN gate < 0.5 THEN {'p': -4.5, 'o': 8, 't': 'limited print quality (low resolution and/or soft focus)'} END",
]
_LADDER = " UNION ALL ".join(f"SELECT idx, s.p, s.o, s.t FROM (SELECT idx, {r} AS s FROM scored) WHERE s IS NOT NULL" for r in _REASONS)

_POOL_FINAL = f"""{_MOMENTS}, {_PLACES}, notable AS (SELECT place_id, count(DISTINCT moment_no) AS k FROM places JOIN moments USING (idx) WHERE place_id NOT LIKE 'place-unknown%' GROUP BY place_id),
scn AS (SELECT p.idx, CASE WHEN k IS NULL OR (SELECT max(k) FROM notable) <= 1 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE + 0.7::DOUBLE * (k - 1) / ((SELECT max(k) FROM notable) - 1) END AS scenic FROM places p LEFT JOIN notable USING (place_id))"""
_FINAL = f"""WITH RECURSIVE {_FEATS}, {_FACES}, {_POOL_FINAL}, {_scored_sql('(SELECT scenic FROM scn WHERE scn.idx = r.idx)')},
withm AS (SELECT scored.*, moment_no FROM scored JOIN moments USING (idx)), {_REPS(rows='withm')}, {_fill_sql('withm')},
pool AS (SELECT c.id, w.ts, p.place_id, w.composite, c.pos, coalesce(strftime(w.ts, '%Y-%m-%d'), 'unknown-day') AS day FROM cands c JOIN withm w USING (id) JOIN places p USING (id)), {_SELECT} """

ORACLE_SQL: dict[str, str] = {
    "percentile_rank_ties": f"SELECT doc_id, round({_rank_sql('n_chars')}, 9) AS rank FROM documents",
    "percentile_rank_events": f"SELECT event_id, round({_rank_sql('value')}, 9) AS rank FROM events",
    "haversine_pairs": f"WITH {_PHOTOS}, {_spots_sql(1000)} SELECT p, q, round(d, 6) AS metres FROM spairs",
    "hamming_pairs": f"WITH {_PHOTOS} SELECT a.idx, bit_count(xor(a.phash, b.phash))::BIGINT AS bits FROM photos a JOIN photos b ON b.idx = a.idx + 1",
    "resolution_score": f"WITH {_PHOTOS} SELECT idx, round({_RES}, 9) AS resolution FROM photos",
    "printability": f"WITH {_FEATS} SELECT idx, round({_GATE}, 9) AS gate FROM feats",
    "appeal": f"WITH {_FEATS} SELECT idx, round({_appeal_sql('sharpness', 'colorfulness')}, 9) AS appeal FROM feats",
    "people_score": f"WITH {_PHOTOS}, {_FACES} SELECT idx, round(people, 9) AS people FROM people",
    "expression_factor": f"WITH {_PHOTOS}, {_FACES} SELECT idx, round(factor, 9) AS factor FROM people",
    "composite": f"WITH {_FEATS}, {_FACES}, {_scored_sql(_TOY_SCENIC)} SELECT idx, round(composite, 9) AS composite FROM scored",
    "reasons_top4": f"WITH {_FEATS}, {_FACES}, {_scored_sql(_TOY_SCENIC)}, ladder AS ({_LADDER}), top AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY p, o) AS k FROM ladder)"
    " SELECT idx, coalesce(reasons, 'average technical quality across the board') AS reasons FROM photos LEFT JOIN (SELECT idx, string_agg(t, '; ' ORDER BY k) AS reasons FROM top WHERE k <= 4 GROUP BY idx) USING (idx)",
    "moment_candidate_pairs": f"WITH {_PHOTOS}, {_PAIRS} SELECT a, b FROM pairs",
    "moment_edges": f"WITH {_PHOTOS}, {_EDGES} SELECT a, b FROM edges",
    "moments": f"WITH RECURSIVE {_PHOTOS}, {_MOMENTS} SELECT idx, moment_id FROM moments",
    "places": f"WITH RECURSIVE {_PHOTOS}, {_PLACES} SELECT idx, place_id FROM places",
    "time_sessions": f"WITH {_PHOTOS}, g AS (SELECT idx, ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, idx) <= INTERVAL 120 SECOND THEN 0 ELSE 1 END AS new FROM photos WHERE ts IS NOT NULL),"
    " s AS (SELECT *, sum(new) OVER (ORDER BY ts, idx) AS run FROM g) SELECT idx, first_value(idx) OVER (PARTITION BY run ORDER BY ts, idx) AS session FROM s",
    "scenic_scores": f"""WITH {_PHOTOS}, m AS (SELECT idx, idx // 7 AS mo, CASE WHEN lat IS NOT NULL THEN round(lat * 1000) || '_' || round(lon * 1000) END AS pl FROM photos),
k AS (SELECT pl, count(DISTINCT mo) AS k FROM m WHERE pl IS NOT NULL GROUP BY pl)
SELECT idx, round(CASE WHEN k IS NULL OR (SELECT max(k) FROM k) <= 1 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE + 0.7::DOUBLE * (k - 1) / ((SELECT max(k) FROM k) - 1) END, 9) AS scenic FROM m LEFT JOIN k USING (pl)""",
    "representatives": f"WITH {_TOY}, {_REPS(rows='toy')} SELECT moment_no, id, pick_no FROM reps",
    "candidates_filled": f"WITH {_TOY}, {_REPS(rows='toy')}, {_fill_sql('toy', '(SELECT count(*) // 4 FROM toy)')} SELECT id, pos FROM cands",
    "day_quotas": f"WITH {_SCORES}, {_QUOTAS} SELECT day, day_n, quota FROM quotas",
    "diverse_selection": f"WITH {_SCORES}, {_SELECT} SELECT id, rank FROM chosen",
    "places_summary": f"WITH {_SCORES}, {_SELECT} SELECT p.place_id, count(*) AS photo_count, count(c.id) AS selected_count FROM pool p LEFT JOIN chosen c ON c.id = p.id GROUP BY p.place_id",
    "laplacian_variance": f"""WITH {_PIX}, lap AS (
  SELECT c.img_id, u.l + d.l + w.l + e2.l - 4 * c.l AS v FROM gr c JOIN gr u ON u.img_id = c.img_id AND u.x = c.x AND u.y = c.y - 1 JOIN gr d ON d.img_id = c.img_id AND d.x = c.x AND d.y = c.y + 1
  JOIN gr w ON w.img_id = c.img_id AND w.y = c.y AND w.x = c.x - 1 JOIN gr e2 ON e2.img_id = c.img_id AND e2.y = c.y AND e2.x = c.x + 1)
SELECT img_id, round(greatest(0, least(1, ln(1 + var_pop(v)) / ln(1501))), 9) AS sharpness FROM lap GROUP BY img_id""",
    "exposure": f"""WITH {_PIX}, m AS (SELECT img_id, avg(l) / 255 AS b, least(1, stddev_pop(l) / 127.5) AS c, avg(CASE WHEN l <= 8 OR l >= 247 THEN 1.0 ELSE 0.0 END) AS k FROM gr GROUP BY img_id)
SELECT img_id, round(b, 9) AS brightness, round(c, 9) AS contrast, round(k, 9) AS clipping, round(0.5 * least(1, abs(b - 0.5) / 0.5) + 0.5 * least(1, 4 * k), 9) AS exposure_penalty FROM m""",
    "colorfulness": f"""WITH {_PIX} SELECT img_id, round(greatest(0, least(1, (sqrt(var_pop(r - g) + var_pop(0.5 * (r + g) - b)) + 0.3 * sqrt(pow(avg(r - g), 2) + pow(avg(0.5 * (r + g) - b), 2))) / 90)), 9) AS colorfulness FROM px GROUP BY img_id""",
    "color_cast": _CAST,
    "composition_grid": _COMPOSITION,
    "dms_to_degrees": """SELECT event_id, round(CASE WHEN user_id % 5 <> 4 THEN (CASE WHEN user_id % 3 = 0 THEN -1 ELSE 1 END)
  * ((user_id % 90)::DOUBLE + (user_id * 7 % 60) / 60.0::DOUBLE + (user_id * 13 % 6000) / 100.0::DOUBLE / 3600.0::DOUBLE) END, 9) + 0.0::DOUBLE AS degrees FROM events""",
    "exif_timestamp_parse": "SELECT event_id, CASE WHEN event_id % 3 = 1 OR event_id % 5 <> 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS taken FROM events",
    "photo_ids": "SELECT page_id, substr(sha1(url), 1, 16) AS id FROM pages",
    "global_row_numbers": "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer",
    "geocode_label_pick": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN NULL WHEN n_nationkey % 4 IN (1, 2) THEN n_name ELSE r_name END AS label FROM nation JOIN region ON n_regionkey = r_regionkey",
    "final_pipeline": _FINAL + "SELECT id, round(composite, 9) AS composite, place_id, rank FROM chosen",
    "run_summary": _FINAL + "SELECT (SELECT count(*) FROM photos) AS total_photos, (SELECT count(DISTINCT moment_no) FROM moments) AS moments, (SELECT count(DISTINCT place_id) FROM places) AS places, (SELECT count(*) FROM chosen) AS selected",
    "distinct_faces": f"""WITH {_PHOTOS}, {_FACES}, o AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY conf DESC, f) AS k FROM faces),
s AS (SELECT a.idx, a.k AS a, b.k AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.hh, b.y + b.hh) - greatest(a.y, b.y)) AS i, a.w * a.hh + b.w * b.hh AS t FROM o a JOIN o b ON a.idx = b.idx AND a.k < b.k),
c AS (SELECT idx, a, b FROM s WHERE i / (t - i) > 0.4::DOUBLE),
kept AS (SELECT o.* FROM o WHERE k = 1 OR NOT EXISTS (SELECT 1 FROM c WHERE c.idx = o.idx AND c.b = o.k AND (c.a = 1 OR NOT EXISTS (SELECT 1 FROM c c1 WHERE c1.idx = o.idx AND c1.a = 1 AND c1.b = c.a))))
SELECT p.idx, count(k) AS n, round(coalesce(sum(conf), 0), 9) AS confidence FROM photos p LEFT JOIN kept USING (idx) GROUP BY p.idx""",
    "named_places": f"""WITH RECURSIVE {_PHOTOS}, {_PLACES}, centres AS (SELECT place_id, avg(lat) AS lat, avg(lon) AS lon FROM places JOIN photos USING (idx) WHERE lat IS NOT NULL GROUP BY place_id),
asked AS (SELECT round(lat, 3) AS a, round(lon, 3) AS o, arg_min(floor(lat * 100 + 0.2371::DOUBLE)::BIGINT, place_id) AS x, arg_min(floor(lon * 100 + 0.2371::DOUBLE)::BIGINT, place_id) AS y FROM centres GROUP BY ALL)
SELECT place_id, x || '/' || y AS name FROM centres JOIN asked ON round(lat, 3) = a AND round(lon, 3) = o WHERE x % 4 <> 0""",
    "moment_report": _FINAL + "SELECT moment_id, count(*) AS photo_count, count(r.id) AS representative_count, arg_min(p.id, (p.ts IS NULL, p.ts, p.idx)) AS first_id FROM moments m JOIN photos p USING (idx) LEFT JOIN reps r ON r.id = m.id GROUP BY moment_id",
    "place_report": _FINAL + "SELECT p.place_id, count(*) AS photo_count, count(c.id) AS selected_count, min(p.idx) AS first_idx FROM places p LEFT JOIN chosen c ON c.id = p.id GROUP BY p.place_id",
    "selected_report": _FINAL + f""", ladder AS ({_LADDER}), why AS (SELECT idx, string_agg(t, '|' ORDER BY p, o) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY p, o) AS k FROM ladder) WHERE k <= 4 GROUP BY idx)
SELECT c.id, c.rank, strftime(c.ts, '%Y-%m-%d %H:%M:%S') AS taken, c.place_id, round(c.composite, 9) AS composite, round(s.ppl, 9) AS people, round(s.scenic, 9) AS scenic, round(s.appeal, 9) AS appeal,
  round(s.gate, 9) AS printability, coalesce(reasons, 'average technical quality across the board') AS reasons FROM chosen c JOIN scored s USING (id) LEFT JOIN why USING (idx)""",
    "saliency_8": _SALIENCY,
    "perceptual_hash": _HASH,
    "saliency_and_hash": f"SELECT * FROM ({_SALIENCY_64}) JOIN ({_HASH}) USING (img_id)",
}
