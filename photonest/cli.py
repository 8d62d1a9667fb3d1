"""Command line: ``python -m photonest.cli curate FOLDER`` and ``... serve``."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from photonest.plans.curation import Config, curate_folder, summary
from photonest.sinks.report import place_files, write_report
from photonest.sources.geocode import web_lookup

KEY_VARIABLE = "PHOTONEST_MAPS_API_KEY"


def session() -> SparkSession:
    """The session that spark-submit set up, or a local one."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = ":".join(x for x in (root, os.environ.get("PYTHONPATH")) if x)
    builder = SparkSession.builder.appName("photonest").config("spark.sql.session.timeZone", "UTC")
    if "SPARK_ENV_LOADED" not in os.environ:
        builder = builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
    return builder.getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="photonest", description="Pick the best moments of a photo collection.")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("curate", help="select photos of a folder")
    one.add_argument("folder")
    one.add_argument("--out", default="./photonest-selection", help="folder for the photos and report.json")
    one.add_argument("-n", "--count", type=int, default=100, help="number of photos to select")
    one.add_argument("--link", action=argparse.BooleanOptionalAction, default=False, help="link instead of copying")
    one.add_argument("--copy", dest="link", action="store_false", help="copy the photos (the default)")
    one.add_argument("--report-only", action="store_true", help="write report.json only")
    one.add_argument("--skip-undecodable", action="store_true", help="leave out files that cannot be decoded")
    one.add_argument("--face-model", help="ONNX face detector")
    one.add_argument("--eye-model", help="ONNX eye-state classifier")
    two = commands.add_parser("serve", help="upload photos in a browser")
    two.add_argument("--host", default="127.0.0.1")
    two.add_argument("--port", type=int, default=5050)
    two.add_argument("--debug", action="store_true", help="log requests")
    for sub in (one, two):
        sub.add_argument("--maps-api-key", default=os.environ.get(KEY_VARIABLE), help=f"names places by a web service; also ${KEY_VARIABLE}")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or session()
    fetch = web_lookup(args.maps_api_key)
    if args.command == "serve":
        from photonest.web.server import serve

        print(f"Serving at http://{args.host}:{args.port} (Ctrl+C to stop)")
        serve(spark, args.host, args.port, fetch, args.debug)
        return 0
    if not os.path.isdir(args.folder):
        parser().error(f"{args.folder} is not a folder")
    print(f"Scanning {args.folder} ...")
    config = Config(target=args.count, fetch=fetch, strict=not args.skip_undecodable, face_model=args.face_model, eye_model=args.eye_model)
    run = curate_folder(spark, args.folder, config)
    if run is None:
        print("No supported images found.")
        return 0
    n = summary(run).first()
    print(f"{n['total_photos']} photos -> {n['moments']} moments -> {n['selected']} selected")
    if fetch is not None:
        print(f"Named {run.names.count()} of {n['places']} place(s).")
    os.makedirs(args.out, exist_ok=True)
    if not args.report_only:
        place_files(run, args.out, args.link)
    write_report(run, os.path.join(args.out, "report.json"))
    print(f"Wrote {n['selected']} photos and report to {args.out}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
