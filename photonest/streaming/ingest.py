"""Photos that keep arriving: measured as they come and appended to a table of features' raw material.

Curation ranks photos against each other, so it stays a batch job over that table.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from photonest.operators.measure import measure_files
from photonest.sources.images import load_images


def ingest_images(spark: SparkSession, folder: str, out: str, checkpoint: str, face_model: bytes | None = None, eye_model: bytes | None = None, forever: bool = False) -> StreamingQuery:
    """Measure each image file under ``folder`` once, also across restarts, into Parquet at ``out``.

    Without ``forever`` the query ends when all present files are done. Files that cannot be decoded are left out.
    """
    measured = measure_files(load_images(spark, folder, stream=True), face_model, eye_model, strict=False)
    writer = measured.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="10 seconds") if forever else writer.trigger(availableNow=True)).start()
