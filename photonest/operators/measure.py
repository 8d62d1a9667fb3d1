"""Pixel measures, faces and eye states of images as one Arrow-batched pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from photonest.functions.pixels import measure
from photonest.functions.vision import Model, detect_faces, eyes_open
from photonest.sources.images import rgb_of

MEASURES = ("laplacian_variance", "sharpness", "brightness", "contrast", "clipping", "exposure_penalty", "colorfulness", "color_cast", "composition", "subject_isolation")
SCHEMA = StructType([StructField("img_id", LongType()), *[StructField(m, DoubleType()) for m in MEASURES], StructField("phash", LongType())])


def measure_images(images: DataFrame, map_size: int = 64) -> DataFrame:
    """``images(img_id, height, width, rgb)``, rgb flat and row by row, to one row of measures each.

    ``map_size`` is the side of the saliency map.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)
            rows = [measure(np.asarray(px.as_py(), dtype=np.uint8).reshape(h, w, 3), map_size) for px, (h, w) in zip(batch.column("rgb"), shapes, strict=True)]
            columns = [batch.column("img_id").cast(pa.int64()), *[pa.array([r[m] for r in rows], pa.float64()) for m in MEASURES], pa.array([r["phash"] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=SCHEMA.names)

    return images.select("img_id", "height", "width", "rgb").mapInArrow(run, SCHEMA)


FILE_SCHEMA = (
    "path string, height int, width int, " + ", ".join(f"{m} double" for m in MEASURES)
    + ", phash long, faces array<struct<x:double,y:double,width:double,height:double,confidence:double>>, eye_openness array<double>"
)


def measure_files(images: DataFrame, face_model: bytes | None = None, eye_model: bytes | None = None, strict: bool = True) -> DataFrame:
    """Decoded image files to their size, measures, faces and eye states; one image is in memory at a time.

    ``strict``: a file that cannot be decoded raises an error; else it is left out. Without models there are no faces.
    """
    face = pa.struct([(c, pa.float64()) for c in ("x", "y", "width", "height", "confidence")])
    types = {"path": pa.string(), "height": pa.int32(), "width": pa.int32(), **{m: pa.float64() for m in MEASURES}}
    types |= {"phash": pa.int64(), "faces": pa.list_(face), "eye_openness": pa.list_(pa.float64())}
    schema = pa.schema(list(types.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One session for each task.
        detector = Model.of(face_model, 320, 240) if face_model else None
        classifier = Model.of(eye_model, 40, 24) if eye_model else None
        for batch in batches:
            rows = []
            for path, h, w, c, data in zip(*(batch.column(n) for n in ("path", "height", "width", "channels", "data")), strict=True):
                path, h, w, c = path.as_py(), h.as_py(), w.as_py(), c.as_py()
                if h <= 0:
                    if strict:
                        raise ValueError(f"cannot decode {path}")
                    continue
                rgb = rgb_of(h, w, c, data.as_buffer())
                faces = detect_faces(detector, rgb)
                eyes = [eyes_open(classifier, rgb, f) for f in faces]
                rows.append({"path": path, "height": h, "width": w, **measure(rgb), "faces": [vars(f) for f in faces], "eye_openness": eyes})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, FILE_SCHEMA)
