"""Files in, files out: EXIF, faces, a folder's run, the report, the command line, the web pages and the stream."""

import http.client
import json
import struct
import threading
import time
from http.server import ThreadingHTTPServer
from io import BytesIO

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from photonest import cli
from photonest.functions import vision
from photonest.sources import exif
from photonest.web.multipart import BadUpload, save_form
from photonest.web.server import Site, handler_of, target_count


def tiff(order="<", taken=None, digitized=None, main=None, gps=None):
    """A TIFF block with the given tags; gps is (lat ratios, ref, lon ratios, ref)."""
    heap, base = bytearray(), 8

    def ifd(at, entries):
        entries = sorted(entries)
        body = struct.pack(order + "H", len(entries))
        spill_at, spill = at + 2 + 12 * len(entries) + 4, b""
        for tag, kind, count, data in entries:
            if len(data) > 4:
                body += struct.pack(order + "HHII", tag, kind, count, spill_at + len(spill))
                spill += data
            else:
                body += struct.pack(order + "HHI", tag, kind, count) + data.ljust(4, b"\0")
        return body + bytes(4) + spill

    text = lambda tag, s: (tag, 2, len(s) + 1, s.encode() + b"\0")
    ratios = lambda tag, rs: (tag, 5, len(rs), b"".join(struct.pack(order + "II", *r) for r in rs))
    pointer = lambda tag, at: (tag, 4, 1, struct.pack(order + "I", at))
    sub = [text(t, s) for t, s in ((exif.ORIGINAL, taken), (exif.DIGITIZED, digitized)) if s]
    places = [ratios(2, gps[0]), ratios(4, gps[2]), *[text(t, r) for t, r in ((1, gps[1]), (3, gps[3])) if r]] if gps else []
    first = [text(exif.DATE_TIME, main)] if main else []
    size = len(ifd(0, first + [pointer(exif.EXIF_IFD, 0), pointer(exif.GPS_IFD, 0)]))
    sub_at = base + size
    gps_at = sub_at + len(ifd(0, sub))
    heap += ifd(base, first + [pointer(exif.EXIF_IFD, sub_at), pointer(exif.GPS_IFD, gps_at)])
    heap += ifd(sub_at, sub) + ifd(gps_at, places)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", base) + bytes(heap)


def jpeg(block):
    return b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda\0\2\xff\xd9"


def png(block):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"eXIf", block)


def webp(block):
    return b"RIFF" + bytes(4) + b"WEBP" + b"VP8 " + struct.pack("<I", 3) + bytes(4) + b"EXIF" + struct.pack("<I", len(block)) + block


def bmp(rgb):
    h, w, _ = rgb.shape
    body = b"".join(row[:, ::-1].tobytes() + bytes(-3 * w % 4) for row in rgb[::-1])
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


GPS = ([(48, 1), (51, 1), (3000, 100)], "N", [(2, 1), (30, 1), (0, 1)], "W")


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("wrap", [jpeg, png, webp, lambda b: b])
def test_exif_is_found_in_every_container(order, wrap):
    taken, lat, north, lon, west = exif.raw_tags(wrap(tiff(order, taken="2024:05:01 10:00:00", gps=GPS)))
    assert taken == ["2024:05:01 10:00:00", None, None, None]
    assert (lat, north, lon, west) == ([48.0, 51.0, 30.0], "N", [2.0, 30.0, 0.0], "W")


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80), st.integers(0, 220), st.sampled_from([jpeg, png, webp, lambda b: b]))
def test_broken_exif_never_raises(noise, cut, wrap):
    whole = wrap(tiff(">", taken="2024:05:01 10:00:00", digitized="x", main="y", gps=GPS))
    for data in (noise, whole[:cut], whole[:cut] + noise + whole[cut + len(noise) :], whole[:8] + noise):
        assert len(exif.raw_tags(data)) == 5


def test_exif_meaning(spark):
    rows = [
        ("both", jpeg(tiff(taken="2024:05:01 10:00:00", main="2020:01:01 00:00:00", gps=GPS))),
        ("next tag", jpeg(tiff(taken="not a date", digitized="2024-05-02 11:00:00"))),
        ("main only", jpeg(tiff(main=" 2024:05:03 12:00:00 "))),
        ("half a place", jpeg(tiff(gps=(GPS[0], "N", [(2, 1)], "E")))),
        ("zero below", jpeg(tiff(gps=([(1, 0), (0, 1), (0, 1)], "N", GPS[2], "E")))),
        ("no refs", jpeg(tiff(gps=(GPS[0], None, GPS[2], None)))),
        ("nothing", b""), ("null", None),
    ]
    found = {r["path"]: (str(r["ts"]), r["lat"] and round(r["lat"], 4), r["lon"]) for r in exif.read_exif(spark.createDataFrame(rows, "path string, content binary")).collect()}
    none = ("None", None, None)
    assert found == {
        "both": ("2024-05-01 10:00:00", 48.8583, -2.5), "next tag": ("2024-05-02 11:00:00", None, None), "main only": ("2024-05-03 12:00:00", None, None),
        "half a place": none, "zero below": none, "no refs": ("None", 48.8583, 2.5), "nothing": none, "null": none,
    }


class Fake:
    def __init__(self, *outputs):
        self.outputs, self.seen = list(outputs), []

    def run(self, _, feeds):
        self.seen.append(feeds["in"])
        return self.outputs


def model(*outputs, w=32, h=24):
    return vision.Model(Fake(*outputs), "in", w, h)


def test_faces_are_filtered_clipped_and_distinct():
    rgb = np.full((60, 80, 3), 127, np.uint8)
    boxes = np.array([[[0.1, 0.1, 0.5, 0.5], [0.12, 0.1, 0.5, 0.5], [0.7, 0.7, 1.4, 1.2], [0.2, 0.2, 0.3, 0.3], [1.1, 0, 1.2, 1]]], np.float32)
    logits = np.log(np.array([[[0.1, 0.9], [0.05, 0.95], [0.3, 0.7], [0.5, 0.5], [0.1, 0.9]]], np.float32))
    m = model(boxes, logits)
    found = vision.detect_faces(m, rgb)
    assert [round(f.confidence, 3) for f in found] == [0.95, 0.7]
    assert found[1].x == pytest.approx(0.7) and found[1].x + found[1].width == pytest.approx(1.0)
    assert m.session.seen[0].shape == (1, 3, 24, 32) and m.session.seen[0].dtype == np.float32 and not m.session.seen[0].any()
    assert len(vision.detect_faces(model(np.array([[0.9], [0.5], [0.7], [0.1], [0.1]]), boxes), rgb)) == 2
    assert vision.detect_faces(None, rgb) == [] == vision.detect_faces(model(boxes), rgb)


def test_distinct_boxes_against_plain_definition():
    rng = np.random.default_rng(4)
    for _ in range(30):
        corner = rng.random((25, 2)) * 0.6
        boxes, scores = np.hstack([corner, corner + rng.random((25, 2)) * 0.4]), rng.random(25)
        kept = []
        for i in sorted(range(25), key=lambda i: -scores[i]):
            def iou(a, b):
                w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                both = max(w, 0) * max(h, 0)
                return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

            if all(iou(boxes[i], boxes[j]) <= 0.4 for j in kept):
                kept.append(i)
        assert vision.distinct_boxes(boxes, scores).tolist() == kept


def test_eye_states():
    rgb = np.zeros((100, 100, 3), np.uint8)
    face = vision.Face(0.2, 0.2, 0.5, 0.5, 0.9)
    m = model(np.array([[1.7]]), w=40, h=24)
    assert vision.eyes_open(m, rgb, face) == 1.0 and len(m.session.seen) == 2
    assert vision.eye_boxes(face)[0] == pytest.approx((0.29, 0.345, 0.41, 0.435))
    assert vision.eyes_open(m, rgb, vision.Face(0, 0, 0.5, 0.5, 0.4)) is None
    assert vision.eyes_open(m, rgb, vision.Face(0, 0, 0.01, 0.01, 0.9)) is None and vision.eyes_open(None, rgb, face) is None


def test_missing_model_is_none(tmp_path):
    assert vision.model_bytes(None) is None is vision.model_bytes(str(tmp_path / "no.onnx"))


@pytest.fixture(scope="module")
def album(tmp_path_factory):
    """A burst of six, four unlike pictures, one odd name and one note."""
    folder = tmp_path_factory.mktemp("album")
    rng = np.random.default_rng(1)
    same = rng.integers(0, 256, (48, 64, 3)).astype(np.uint8)
    for i in range(6):
        (folder / f"burst{i}.bmp").write_bytes(bmp(same))
    for i in range(4):
        (folder / f"other{i}.bmp").write_bytes(bmp(rng.integers(0, 40 * i + 60, (48, 64, 3)).astype(np.uint8)))
    (folder / "odd %41 + é.BMP").write_bytes(bmp(same))
    (folder / "note.txt").write_text("no picture")
    return folder


def test_command_line(spark, album, tmp_path, capsys):
    out = tmp_path / "out"
    assert cli.main(["curate", str(album), "--out", str(out), "-n", "7"], spark) == 0
    text = (out / "report.json").read_text()
    report = json.loads(text)
    assert text == json.dumps(report, indent=2)
    assert report["summary"]["total_photos"] == 11 == len(report["all_scores"]) == sum(m["photo_count"] for m in report["moments"])
    assert report["summary"]["selected"] == 7 == len(report["selected"]) and report["summary"]["moments"] == len(report["moments"]) == 5
    assert sum(p["photo_count"] for p in report["places"]) == 11 and all(p["id"].startswith("place-unknown-") for p in report["places"])
    names = sorted(p.name for p in out.iterdir() if p.suffix.lower() == ".bmp")
    assert names == [f"{r:03d}_{p['path'].rsplit('/', 1)[1]}" for r, p in enumerate(report["selected"], 1)]
    assert all((out / n).read_bytes() == (album / n[4:]).read_bytes() for n in names)
    assert "11 photos -> 5 moments -> 7 selected" in capsys.readouterr().out
    assert all(m["representatives"] and set(m["representatives"]) <= set(m["photo_ids"]) for m in report["moments"])
    again = tmp_path / "links"
    cli.main(["curate", str(album), "--out", str(again), "-n", "2", "--link"], spark)
    cli.main(["curate", str(album), "--out", str(again), "-n", "2", "--link"], spark)
    links = [p for p in again.iterdir() if p.name != "report.json"]
    assert len(links) == 2 and all(p.is_symlink() and p.resolve().parent == album.resolve() for p in links)
    only = tmp_path / "only"
    cli.main(["curate", str(album), "--out", str(only), "--report-only"], spark)
    assert [p.name for p in only.iterdir()] == ["report.json"]
    assert json.loads((only / "report.json").read_text())["summary"]["selected"] == 11


def test_empty_and_undecodable_folders(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    assert cli.main(["curate", str(tmp_path / "in"), "--out", str(tmp_path / "out")], spark) == 0
    assert "No supported images found." in capsys.readouterr().out and not (tmp_path / "out").exists()
    (tmp_path / "in" / "x.jpg").write_bytes(b"no picture")
    with pytest.raises(Exception, match="cannot decode"):
        cli.main(["curate", str(tmp_path / "in"), "--out", str(tmp_path / "out")], spark)
    cli.main(["curate", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--skip-undecodable"], spark)
    assert json.loads((tmp_path / "out" / "report.json").read_text())["summary"]["selected"] == 0


def form(files, fields=(), mark="xYz"):
    out = b""
    for name, value in fields:
        out += f'--{mark}\r\nContent-Disposition: form-data; name="{name}"\r\n\r\n{value}\r\n'.encode()
    for name, data in files:
        out += f'--{mark}\r\nContent-Disposition: form-data; name="photos"; filename="{name}"\r\nContent-Type: image/bmp\r\n\r\n'.encode() + data + b"\r\n"
    return out + f"--{mark}--\r\n".encode(), f"multipart/form-data; boundary={mark}"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=60), st.sampled_from([b"\r\n", b"\r\n--xYz!", b"--xY\r\n", b"\n\r", b"a" * 65535 + b"\r\n--xYzz", b"a" * 65536 + b"\r\nb"])), min_size=1, max_size=4))
def test_uploads_round_trip(tmp_path_factory, blobs):
    folder = tmp_path_factory.mktemp("up")
    body, kind = form([(f"../d/{i}.bin", b) for i, b in enumerate(blobs)], [("count", "7")])
    fields, saved = save_form(BytesIO(body), len(body), kind, str(folder))
    assert fields == {"count": "7"} and [(folder / n).read_bytes() for n in saved] == blobs


def test_bad_uploads(tmp_path):
    body, kind = form([("a", b"1"), ("b", b"2")])
    for args in ((body, len(body), "text/plain"), (body, len(body) - 12, kind), (b"x" + body, len(body), kind)):
        with pytest.raises(BadUpload):
            save_form(BytesIO(args[0]), args[1], args[2], str(tmp_path))
    with pytest.raises(BadUpload):
        save_form(BytesIO(body), len(body), kind, str(tmp_path), max_parts=1)
    assert [target_count(x) for x in ("5", "0", "9999", "many", None)] == [5, 1, 1000, 100, 100]


def test_web(spark, album, tmp_path):
    site = Site(spark, str(tmp_path))
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler_of(site))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None, headers=None):
        link = http.client.HTTPConnection(*server.server_address, timeout=300)
        link.request(method, path, body, headers or {})
        got = link.getresponse()
        return got.status, got.read(), got.headers

    status, page, _ = call("GET", "/")
    assert status == 200 and all(x in page for x in (b'id="progress-bar"', b'role="progressbar"', b"pollProgress"))
    pictures = [(p.name, p.read_bytes()) for p in sorted(album.iterdir()) if p.suffix == ".bmp"][:5]
    body, kind = form([*pictures, ("<b>.bmp", pictures[0][1])], [("count", "4")])
    status, answer, _ = call("POST", "/curate", body, {"Content-Type": kind, "Accept": "application/json"})
    assert status == 202
    url = json.loads(answer)["progress_url"]
    for _ in range(600):
        state = json.loads(call("GET", url)[1])
        if state["status"] in ("done", "error"):
            break
        time.sleep(0.3)
    assert (state["status"], state["percent"], state["error"]) == ("done", 100, None)
    status, page, _ = call("GET", state["results_url"])
    assert status == 200 and b"4 selected, ranked by score" in page and b"<b>.bmp" not in page
    run_id = json.loads(answer)["run_id"]
    assert call("GET", f"/photos/{run_id}/burst0.bmp")[1] == pictures[0][1]
    for path in (f"/photos/{run_id}/none.bmp", f"/photos/{run_id}/..%2f..%2fetc", "/photos/../x", "/progress/zz", "/results/zz", "/else"):
        assert call("GET", path)[0] == 404
    none, kind = form([("", b"")])
    assert call("POST", "/curate", none, {"Content-Type": kind, "Accept": "application/json"})[0] == 400
    assert call("POST", "/curate", none, {"Content-Type": kind})[0] == 302
    text, kind = form([("a.txt", b"x")])
    status, _, headers = call("POST", "/curate", text, {"Content-Type": kind})
    assert status == 302 and b"No images found" in call("GET", headers["Location"])[1]
    bad, kind = form([("a.bmp", b"x")])
    status, answer, _ = call("POST", "/curate", bad, {"Content-Type": kind})
    assert status == 500
    server.shutdown()


def test_stream_measures_each_file_once(spark, album, tmp_path):
    from photonest.streaming.ingest import ingest_images

    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    for i, p in enumerate(sorted(album.glob("*.bmp"))[:4]):
        (source / p.name).write_bytes(p.read_bytes())
        if i % 2:
            ingest_images(spark, str(source), out, check).awaitTermination(200)
            assert spark.read.parquet(out).count() == i + 1
