"""Queries over files: EXIF blocks, image folders, reports, pages, uploads, faces and eyes; and their SQL."""

from __future__ import annotations

import io
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonest.functions import expressions as X
from photonest.functions.pixels import resize
from photonest.functions.vision import Face, detect_faces, eye_boxes
from photonest.operators.measure import measure_files
from photonest.plans import adapters as A
from photonest.plans import files
from photonest.plans import queries as Q
from photonest.plans.curation import Config, Curation, curate
from photonest.session import shared_folder
from photonest.sinks import report
from photonest.sources.exif import read_exif
from photonest.sources.images import load_images, scan_images
from photonest.web.multipart import save_form
from photonest.web.server import render, target_count

TARGET = Q.TARGET
r9 = Q.r9


def exif_files(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as a file with an EXIF block, in all containers and both byte orders, read back."""
    events = A.table(spark, sf, "events").select("event_id", "user_id", F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("taken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, u, taken in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = ([(u % 90, 1), (u * 7 % 60, 1), (u * 13 % 6000, 100)], "S" if u % 3 == 0 else "N", [(u % 180, 1), (u * 11 % 60, 1), (u * 17 % 6000, 100 if u % 7 else 0)], "W" if u % 2 else "E")
                times = [("not a date", taken, None), (taken, None, None), (None, None, f" {taken} "), (None, None, None)][i % 4]
                block = files.exif_tiff("<>"[i % 2], *times, place if u % 5 != 4 else None)
                made.append(files.CONTAINERS[i // 4 % 4](block) if i % 11 else b"\xff\xd8 no block")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    found = read_exif(events.mapInArrow(run, "path string, content binary"))
    zero = F.lit(0.0)
    return found.select(F.col("path").cast("long").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("taken"), (r9("lat") + zero).alias("lat"), (r9("lon") + zero).alias("lon"))


def image_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Each image of the pixel queries as a PNG or BMP file in nested folders, beside files of other kinds; scanned, decoded, measured."""
    folder = shared_folder(spark, "album")
    shots = A.images(spark, sf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, px in zip(batch.column("img_id").to_pylist(), batch.column("rgb").to_pylist(), strict=True):
                rgb = np.array(px, dtype=np.uint8).reshape(8, 8, 3)
                where = f"{folder}/part {i % 7}/"
                os.makedirs(where, exist_ok=True)
                for name, data in ((f"img{i:07d}" + (".PNG" if i % 2 else ".bmp"), (files.png_file if i % 2 else files.bmp_file)(rgb)), (f"img{i:07d}.txt", b"x")):
                    with open(where + name, "wb") as f:  # the same bytes if a task runs again
                        f.write(data)
            yield pa.RecordBatch.from_arrays([batch.column("img_id").cast(pa.int64())], names=["img_id"])

    shots.select("img_id", "rgb").mapInArrow(run, "img_id long").write.format("noop").mode("overwrite").save()
    scanned = scan_images(spark, folder)
    measured = measure_files(load_images(spark, folder))
    right_id = F.col("id") == F.substring(F.sha1(F.encode("path", "UTF-8")), 1, 16)
    return scanned.join(measured, "path").select(
        F.substring("path", len(folder) + 2, 1 << 20).alias("name"), "idx", right_id.alias("right_id"), F.col("height").cast("long").alias("height"),
        F.col("width").cast("long").alias("width"), r9("brightness").alias("brightness"), r9("colorfulness").alias("colorfulness"), F.size("faces").cast("long").alias("faces"),
    )


def bilinear_resize(spark: SparkSession, sf: str) -> DataFrame:
    """Gray images shrunk to 4 x 4 and grown to 16 x 32: sums over rows and columns that tell one pixel from another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gray = [np.array(px, dtype=np.float64).reshape(8, 8, 3)[..., 0] for px in batch.column("rgb").to_pylist()]
            out = []
            for h, w in ((4, 4), (32, 16)):
                weight = (np.arange(h)[:, None] + 1) * (np.arange(w)[None, :] + 1) ** 2
                out.append(pa.array([int((resize(g, h, w) * weight).sum()) for g in gray], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("img_id").cast(pa.int64()), *out], names=["img_id", "small", "large"])

    return A.images(spark, sf).select("img_id", "rgb").mapInArrow(run, "img_id long, small long, large long")


def detected_faces(spark: SparkSession, sf: str) -> DataFrame:
    """A detector whose outputs are three boxes and two logits each from an embedding: unpacked, filtered, made distinct, clipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, e in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                v = np.array(e, dtype=np.float64)
                corner = np.array([[0.1 + v[2 * k], 0.2 + v[2 * k + 1]] for k in range(3)])
                boxes = np.hstack([corner, corner + 0.4 + np.array([[v[10 + k], v[20 + k]] for k in range(3)])])
                logits = np.array([[20 * v[30 + k], 20 * v[40 + k] + 1] for k in range(3)])
                found = detect_faces(lambda rgb, shift, scale, o=(boxes[None], logits[None]): list(o), np.zeros((8, 8, 3), np.uint8))
                out += [(i, n, *(round(x, 6) for x in (f.x, f.y, f.width, f.height, f.confidence))) for n, f in enumerate(found)]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(columns)], names=["vec_id", "n", "x", "y", "width", "height", "confidence"])

    faces = A.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return faces.mapInArrow(run, "vec_id long, n long, x double, y double, width double, height double, confidence double")


def eye_crops(spark: SparkSession, sf: str) -> DataFrame:
    """Where the eyes of each face are looked for."""
    faces = Q._feats(spark, sf).select("idx", F.posexplode("faces").alias("f", "face")).select("idx", F.col("f").cast("long").alias("f"), "face.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [eye_boxes(Face(r["x"], r["y"], r["width"], r["height"], r["confidence"])) for r in rows]
            sides = [pa.array([round(eyes[e][s], 9) for eyes in found], pa.float64()) for e in (0, 1) for s in (0, 1, 2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column("idx"), batch.column("f"), *sides], names=["idx", "f", *_SIDES])

    return faces.mapInArrow(run, "idx long, f long, " + ", ".join(f"{s} double" for s in _SIDES))


_SIDES = [f"{eye}_{side}" for eye in ("left", "right") for side in ("x0", "y0", "x1", "y1")]


def _run(spark: SparkSession, sf: str) -> Curation:
    return curate(Q._feats(spark, sf).withColumn("path", F.concat(F.lit("/album/"), "id", F.lit(".jpg"))), TARGET)


def _report(spark: SparkSession, sf: str) -> str:
    """Path of a written report."""
    path = os.path.join(shared_folder(spark, "report"), "report.json")
    report.write_report(_run(spark, sf), path)
    return path


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def report_selected(spark: SparkSession, sf: str) -> DataFrame:
    """The selected photos as the JSON report tells them, at most ``TARGET``."""
    _, items = report.read_report(spark, _report(spark, sf))
    told = [json.loads(r["item"]) for r in items.where("section = 'selected'").orderBy("n").collect()]
    rows = [
        (n, p["id"], p["path"], p["timestamp"] and p["timestamp"].replace("T", " ")[:19], p["gps"] and p["gps"]["lat"], p["gps"] and p["gps"]["lon"], p["width"], p["height"],
         p["place"]["id"], p["place"]["name"], p["score"]["composite"], p["score"]["printability"], "|".join(p["reasons"]))
        for n, p in enumerate(told, 1)
    ]
    return _rows(spark, rows, "rank long, id string, path string, taken string, lat double, lon double, width long, height long, place_id string, name string, composite double, printability double, reasons string").withColumn(
        "lat", r9("lat")).withColumn("lon", r9("lon"))


def report_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The other parts of the JSON report, in its order: moments with their photos, places, all scores."""
    counts, items = report.read_report(spark, _report(spark, sf))
    tell = {
        "moments": ("moment", lambda m: f"{m['photo_count']}|{','.join(m['photo_ids'])}|{','.join(m['representatives'])}"),
        "places": ("place", lambda p: str(p["photo_count"])),
        "all_scores": ("score", lambda s: f"{s['composite']:.4f}"),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(tell[section], json.loads(item)) for section, item in zip(batch.column("section").to_pylist(), batch.column("item").to_pylist(), strict=True)]
            columns = [[part for (part, _), _ in told], [x["id"] for _, x in told], [body(x) for (_, body), x in told]]
            part, name, body = (pa.array(c, pa.string()) for c in columns)
            yield pa.RecordBatch.from_arrays([part, batch.column("n"), name, body], names=["part", "n", "id", "body"])

    schema = "part string, n long, id string, body string"
    told = items.where("section <> 'selected'").select("section", "n", "item").mapInArrow(run, schema)
    return _rows(spark, [("summary", 0, k, str(v)) for k, v in counts.items()], schema).unionByName(told)


def result_cards(spark: SparkSession, sf: str) -> DataFrame:
    """The photos of the results page in its order, with the address that each is served from; at most ``TARGET``."""
    page = render("run1", _run(spark, sf))
    rows = [(n, url) for n, url in enumerate(dict.fromkeys(re.findall(r'/photos/run1/[^"\']+', page)), 1)]
    return _rows(spark, rows, "rank long, url string")


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Each page as a form of one field and two files (of which the second is named with a path), saved and read back."""
    folder = shared_folder(spark, "uploads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                body, mark = (html or "").encode(), b"----mark"
                parts = [(b'name="count"', str(i).encode()), (b'name="photos"; filename="a.png"', body), (b'name="photos"; filename="C:\\x/sub\\b.jpg"', body[::-1]), (b'name="photos"; filename=""', b"")]
                form = b"".join(b"--" + mark + b"\r\nContent-Disposition: form-data; " + about + b"\r\n\r\n" + data + b"\r\n" for about, data in parts) + b"--" + mark + b"--\r\n"
                where = f"{folder}/{i}"
                os.makedirs(where, exist_ok=True)
                told, saved = save_form(io.BytesIO(form), len(form), f"multipart/form-data; boundary={mark.decode()}", where)
                contents = {}
                for name in saved:
                    with open(f"{where}/{name}", "rb") as f:
                        contents[name] = f.read()
                out.append((i, target_count(told["count"]), ",".join(saved), contents["a.png"].decode() == (html or ""), len(contents["b.jpg"]), contents["b.jpg"][::-1] == body))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "target", "saved", "whole", "n_bytes", "turned"])

    return A.table(spark, sf, "pages").select("page_id", "html").mapInArrow(run, "page_id long, target long, saved string, whole boolean, n_bytes long, turned boolean")


def settings(spark: SparkSession, sf: str) -> DataFrame:
    """The defaults of a run."""
    rows = [(f.name, str(f.default)) for f in fields(Config) if f.name not in ("scoring", "fetch")]
    rows += [(f"scoring.{f.name}", str(f.default)) for f in fields(X.ScoringConfig)]
    return _rows(spark, rows, "name string, value string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (exif_files, image_folder, bilinear_resize, detected_faces, eye_crops, report_selected, report_lists, result_cards, uploads, settings)
}

# --- SQL -------------------------------------------------------------------------------------------------

_TAPS = """k{n} AS (SELECT j, i, w / sum(w) OVER (PARTITION BY j) AS w FROM (
  SELECT j, i, greatest(0, 1 - abs((i + 0.5::DOUBLE - (j + 0.5::DOUBLE) * 8 / {n}) / greatest(1.0::DOUBLE, 8.0::DOUBLE / {n}))) AS w FROM range({n}) a(j), range(8) b(i)))""".format
_GROWN = """r{w} AS (SELECT img_id, y, k.j AS x, round_even(greatest(0, least(255, sum(r * k.w))), 0) AS v FROM px JOIN k{w} k ON k.i = px.x GROUP BY ALL),
g{w} AS (SELECT img_id, sum((j + 1) * (x + 1) * (x + 1) * v)::BIGINT AS s FROM (SELECT img_id, k.j, x, round_even(greatest(0, least(255, sum(v * k.w))), 0) AS v FROM r{w} t JOIN k{h} k ON k.i = t.y GROUP BY ALL) GROUP BY img_id)""".format
_FACE_ROWS = """b AS (SELECT vec_id, k, 0.1::DOUBLE + embedding[2 * k + 1]::DOUBLE AS x0, 0.2::DOUBLE + embedding[2 * k + 2]::DOUBLE AS y0, embedding[11 + k]::DOUBLE AS dw, embedding[21 + k]::DOUBLE AS dh,
  1 / (1 + exp(20 * embedding[31 + k]::DOUBLE - (20 * embedding[41 + k]::DOUBLE + 1))) AS conf FROM embeddings, range(3) t(k)),
o AS (SELECT *, x0 + 0.4::DOUBLE + dw AS x1, y0 + 0.4::DOUBLE + dh AS y1, row_number() OVER (PARTITION BY vec_id ORDER BY conf DESC, k) AS n FROM b WHERE conf > 0.6::DOUBLE),
s AS (SELECT a.vec_id, a.n AS a, c.n AS c, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS i,
  greatest(0, a.x1 - a.x0) * greatest(0, a.y1 - a.y0) + greatest(0, c.x1 - c.x0) * greatest(0, c.y1 - c.y0) AS t FROM o a JOIN o c ON a.vec_id = c.vec_id AND a.n < c.n),
hit AS (SELECT vec_id, a, c FROM s WHERE t - i > 0 AND i > 0.4::DOUBLE * (t - i)),
kept AS (SELECT * FROM o WHERE n = 1 OR NOT EXISTS (SELECT 1 FROM hit h WHERE h.vec_id = o.vec_id AND h.c = o.n
  AND (h.a = 1 OR NOT EXISTS (SELECT 1 FROM hit g WHERE g.vec_id = o.vec_id AND g.a = 1 AND g.c = h.a)))),
cut AS (SELECT vec_id, n, conf, greatest(0, least(1, x0)) AS x0, greatest(0, least(1, y0)) AS y0, greatest(0, least(1, x1)) AS x1, greatest(0, least(1, y1)) AS y1 FROM kept)"""
_EYE = ", ".join(
    f"round(x + {column}::DOUBLE * w + {dx}::DOUBLE * w, 9) AS {eye}_x{i}, round(y + 0.38::DOUBLE * hh + {dy}::DOUBLE * hh, 9) AS {eye}_y{i}"
    for eye, column in (("left", 0.3), ("right", 0.7)) for i, dx, dy in ((0, -0.12, -0.09), (1, 0.12, 0.09))
)
_LADDER_SQL = f"ladder AS ({Q._LADDER}), why AS (SELECT idx, string_agg(t, '|' ORDER BY p, o) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY p, o) AS k FROM ladder) WHERE k <= 4 GROUP BY idx)"

ORACLE_SQL: dict[str, str] = {
    "exif_files": """SELECT event_id, CASE WHEN event_id % 4 <> 3 AND event_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS taken,
  CASE WHEN ok THEN round((CASE WHEN u % 3 = 0 THEN -1 ELSE 1 END) * (u % 90 + (u * 7 % 60) / 60.0::DOUBLE + (u * 13 % 6000) / 100.0::DOUBLE / 3600), 9) + 0.0::DOUBLE END AS lat,
  CASE WHEN ok THEN round((CASE WHEN u % 2 = 1 THEN -1 ELSE 1 END) * (u % 180 + (u * 11 % 60) / 60.0::DOUBLE + (u * 17 % 6000) / 100.0::DOUBLE / 3600), 9) + 0.0::DOUBLE END AS lon
FROM (SELECT event_id, user_id AS u, ts, user_id % 5 <> 4 AND user_id % 7 <> 0 AND event_id % 11 <> 0 AS ok FROM events)""",
    "image_folder": f"""WITH {Q._PIX}, n AS (SELECT DISTINCT img_id, 'part ' || img_id % 7 || '/img' || lpad(img_id::VARCHAR, 7, '0') || CASE WHEN img_id % 2 = 1 THEN '.PNG' ELSE '.bmp' END AS name FROM px),
c AS (SELECT img_id, round(greatest(0, least(1, (sqrt(var_pop(r - g) + var_pop(0.5 * (r + g) - b)) + 0.3 * sqrt(pow(avg(r - g), 2) + pow(avg(0.5 * (r + g) - b), 2))) / 90)), 9) AS colorfulness FROM px GROUP BY img_id),
m AS (SELECT img_id, round(avg(l) / 255, 9) AS brightness FROM gr GROUP BY img_id)
SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx, true AS right_id, 8::BIGINT AS height, 8::BIGINT AS width, brightness, colorfulness, 0::BIGINT AS faces FROM n JOIN c USING (img_id) JOIN m USING (img_id)""",
    "bilinear_resize": f"WITH {Q._PIX}, {_TAPS(n=4)}, {_TAPS(n=16)}, {_TAPS(n=32)}, {_GROWN(w=4, h=4)}, {_GROWN(w=16, h=32)} SELECT img_id, g4.s AS small, g16.s AS large FROM g4 JOIN g16 USING (img_id)",
    "detected_faces": f"""WITH {_FACE_ROWS} SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY n) - 1 AS n, round(x0, 6) AS x, round(y0, 6) AS y, round(x1 - x0, 6) AS width, round(y1 - y0, 6) AS height, round(conf, 6) AS confidence
FROM cut WHERE x1 > x0 AND y1 > y0""",
    "eye_crops": f"WITH {Q._PHOTOS}, {Q._FACES} SELECT idx, f, {_EYE} FROM faces",
    "report_selected": Q._FINAL + f""", {_LADDER_SQL} SELECT c.rank, c.id, '/album/' || c.id || '.jpg' AS path, strftime(c.ts, '%Y-%m-%d %H:%M:%S') AS taken, round(s.lat, 9) AS lat, round(s.lon, 9) AS lon, s.width::BIGINT AS width, s.height::BIGINT AS height,
  c.place_id, NULL::VARCHAR AS name, round(c.composite, 4) AS composite, round(s.gate, 4) AS printability, coalesce(reasons, 'average technical quality across the board') AS reasons FROM chosen c JOIN scored s USING (id) LEFT JOIN why USING (idx)""",
    "report_lists": Q._FINAL + """SELECT 'summary' AS part, 0::BIGINT AS n, k AS id, v AS body FROM (VALUES ('total_photos', (SELECT count(*) FROM photos)::VARCHAR), ('moments', (SELECT count(DISTINCT moment_no) FROM moments)::VARCHAR),
  ('places', (SELECT count(DISTINCT place_id) FROM places)::VARCHAR), ('selected', (SELECT count(*) FROM chosen)::VARCHAR)) t(k, v)
UNION ALL SELECT 'moment', m.moment_no, moment_id, count(*) || '|' || string_agg(m.id, ',' ORDER BY p.ts IS NULL, p.ts, p.idx) || '|' || coalesce(string_agg(r.id, ',' ORDER BY r.pick_no, r.id), '')
  FROM moments m JOIN photos p USING (idx) LEFT JOIN reps r ON r.id = m.id GROUP BY m.moment_no, moment_id
UNION ALL SELECT 'place', row_number() OVER (ORDER BY k DESC, place_id LIKE 'place-unknown-%', f) - 1, place_id, k::VARCHAR FROM (SELECT place_id, count(*) AS k, min(idx) AS f FROM places GROUP BY place_id)
UNION ALL SELECT 'score', row_number() OVER (ORDER BY idx) - 1, id, printf('%.4f', round(composite, 4)) FROM scored""",
    "result_cards": Q._FINAL + "SELECT row_number() OVER (ORDER BY composite DESC, rank) AS rank, '/photos/run1/' || id || '.jpg' AS url FROM chosen",
    "uploads": "SELECT page_id, greatest(1, least(1000, page_id)) AS target, 'a.png,b.jpg' AS saved, true AS whole, octet_length(encode(coalesce(html, ''))) AS n_bytes, true AS turned FROM pages",
    "settings": """SELECT * FROM (VALUES ('target', '100'), ('moment_seconds', '120.0'), ('moment_metres', '100.0'), ('moment_bits', '10'), ('moment_window', '40'), ('place_metres', '300.0'), ('second_from', '8'),
  ('second_ratio', '0.92'), ('second_bits', '12'), ('ceiling', '1.6'), ('face_model', 'None'), ('eye_model', 'None'), ('strict', 'True'), ('scoring.people', '0.3'), ('scoring.scenic', '0.2'), ('scoring.appeal', '0.5'),
  ('scoring.sharpness', '0.22'), ('scoring.exposure', '0.18'), ('scoring.contrast', '0.13'), ('scoring.colorfulness', '0.1'), ('scoring.color_cast', '0.1'), ('scoring.composition', '0.12'), ('scoring.isolation', '0.15'),
  ('scoring.rank_weight', '0.35'), ('scoring.gate_floor', '0.15')) t(name, value)""",
}
