"""Photo operators: each query against its SQL on sf0.001, and small cases."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from photonest.functions import expressions as X
from photonest.functions import pixels
from photonest.operators.cluster import near_points
from photonest.operators.components import connected_components, contracted
from photonest.operators.order import percentile_ranks
from photonest.plans import file_queries
from photonest.plans.queries import ORACLE_SQL, QUERIES

QUERIES, ORACLE_SQL = QUERIES | file_queries.QUERIES, ORACLE_SQL | file_queries.ORACLE_SQL
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"run_summary"}))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = [sorted(map(tuple, x[cols].astype(str).to_numpy())) for x in (got, want)]
    assert rows[0] == rows[1]


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    least = {}
    for x in up:
        least[find(x)] = min(x, least.get(find(x), x))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: least[find(x)] for x in up}


@pytest.mark.parametrize("limit", [3, 1 << 20])
def test_contracted_edges_connect_the_same_nodes(spark, limit):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(500) if i % 97] + [(rng.randrange(700), rng.randrange(700)) for _ in range(60)] + [(3, 3), (None, 4), (9, None)]
    df = spark.createDataFrame(edges, "src long, dst long")
    whole = lambda e: {tuple(r) for r in connected_components(e).collect()}
    less = contracted(df.repartition(5), limit=limit)
    assert whole(less) == whole(df.where("src <> dst"))
    assert less.count() < df.count() and contracted(df.limit(0)).count() == 0


@pytest.mark.parametrize("values,want", [([1, 1, 1, 10], [1 / 3, 1 / 3, 1 / 3, 1.0]), ([5, 5], [0.5, 0.5]), ([3], [0.5]), ([], [])])
def test_percentile_ranks(spark, values, want):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")
    got = [r["r"] for r in percentile_ranks(df, "v", "r").orderBy("i").collect()]
    assert got == pytest.approx(want)


def test_near_points_at_poles_and_date_line(spark):
    rng = random.Random(2)
    pts = [(i, lat + rng.uniform(-0.01, 0.01), lon + rng.uniform(-0.01, 0.01)) for i, (lat, lon) in enumerate([(0, 179.995), (0, -179.995), (89.99, 10), (89.99, -100), (45, 7)] * 30)]

    def metres(p, q):
        a, b, c, d = map(math.radians, (p[1], p[2], q[1], q[2]))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))

    want = {(p[0], q[0]) for p in pts for q in pts if p[0] < q[0] and metres(p, q) <= 900}
    df = spark.createDataFrame(pts, "p long, lat double, lon double")
    assert {(r["p"], r["q"]) for r in near_points(df, 900.0).collect()} == want


def test_pixel_kernels():
    noise = np.random.default_rng(0).integers(0, 256, (90, 120, 3)).astype(np.uint8)
    flat = np.full((90, 120, 3), 128, np.uint8)
    assert pixels.measure(noise)["sharpness"] > pixels.measure(flat)["sharpness"] == 0
    assert pixels.color_cast(np.zeros((9, 9, 3), np.uint8)) == 1.0
    assert not pixels.saliency(pixels.gray(flat)).any()
    assert bin((pixels.dhash(noise) ^ pixels.dhash(noise[::-1])) & (1 << 64) - 1).count("1") > 10


def test_dms(spark):
    df = spark.createDataFrame([([48.0, 51.0, 30.0], "N"), ([2.0, 30.0, 0.0], " w"), ([1.0], "S"), (None, None)], "d array<double>, r string")
    got = [r[0] for r in df.select(X.dms_to_degrees(F.col("d"), F.col("r"))).collect()]
    assert got == [pytest.approx(48.8583333333), -2.5, None, None]


def test_images_are_scanned_and_decoded(spark, tmp_path):
    from photonest.sources.images import load_images, rgb_of, scan_images

    def bmp(rgb):
        h, w, _ = rgb.shape
        body = b"".join(row[:, ::-1].tobytes() + bytes(-3 * w % 4) for row in rgb[::-1])
        head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
        info = (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + b"\x01\x00\x18\x00" + bytes(4) + len(body).to_bytes(4, "little") + bytes(16)
        return head + info + body

    rgb = np.random.default_rng(3).integers(0, 256, (5, 6, 3)).astype(np.uint8)
    (tmp_path / "a").mkdir()
    for name in ("a/z.BMP", "a-b.bmp"):
        (tmp_path / name).write_bytes(bmp(rgb))
    (tmp_path / "note.txt").write_text("x")
    found = scan_images(spark, str(tmp_path)).orderBy("idx").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in found] == ["z.BMP", "a-b.bmp"] and len({r["id"] for r in found}) == 2
    for r in load_images(spark, str(tmp_path)).collect():
        assert np.array_equal(rgb_of(r["height"], r["width"], r["channels"], bytes(r["data"])), rgb)


def test_every_embedding_is_an_image(spark, tmp_path):
    from photonest.plans.adapters import images

    vectors = np.random.default_rng(6).uniform(-0.6, 0.6, (1203, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    level = np.floor(np.clip((vectors.astype(np.float64) + 0.55) / 1.1, 0, 1) * 255).astype(int)
    got = {r["img_id"]: r["rgb"] for r in images(spark, str(tmp_path)).collect()}
    assert len(got) == 1203
    assert all(got[i] == np.stack([level[i], level[(i + 1) % 1203], level[(i + 2) % 1203]], axis=1).ravel().tolist() for i in got)


def test_candidates_cover_every_group(spark):
    rows, groups = (QUERIES[n](spark, SF).toPandas() for n in ("candidates_filled", "representatives"))
    assert set(groups["id"]) <= set(rows["id"]) and groups["moment_no"].nunique() == 84


def test_candidates_fill_up_when_picks_fall_short(spark):
    from photonest.operators.select import candidates, representatives

    shots = [(i // 3, f"p{i}", i, None, (i * 7 % 11) / 10, 0) for i in range(9)]
    df = spark.createDataFrame(shots, "moment_no long, id string, idx long, ts timestamp, composite double, phash long")
    best = [max(shots[g * 3 : g * 3 + 3], key=lambda r: (r[4], -r[2]))[1] for g in range(3)]
    rest = [r[1] for r in sorted(shots, key=lambda r: (-r[4], r[2])) if r[1] not in best]
    for target in (2, 3, 5, 20):
        got = [r["id"] for r in candidates(df, representatives(df), target).orderBy("pos").collect()]
        assert got == best + rest[: max(0, target - 3)]


def test_intermediate_tables_can_be_released(spark):
    import os

    from photonest import session

    kept = session.materialize(spark.range(100).repartition(8), "probe", thin=True)
    folder = session.run_dir(spark).removeprefix("file://")
    assert kept.count() == 100 and os.path.isdir(folder)
    assert len([f for f in kept.inputFiles() if f.endswith(".parquet")]) == 1
    session.release(spark)
    assert not os.path.isdir(folder)
    assert session.materialize(spark.range(5), "probe").count() == 5



def test_near_links_connect_what_near_pairs_connect(spark):
    from photonest.operators.cluster import near_links

    rng = random.Random(17)
    spots = []
    for lat, lon in ((0.0, 0.0), (48.85, 2.35), (-33.0, 179.9999), (84.95, 10.0), (89.99, 0.0), (60.0, -180.0)):
        for _ in range(70):
            spots.append((lat + rng.gauss(0, 0.006), (lon + rng.gauss(0, 0.006) / max(0.01, math.cos(math.radians(lat))) + 540) % 360 - 180))
        spots += [(lat + i * 0.0026, lon if lon < 179 else -180 + i * 0.0001) for i in range(4)]  # about the radius apart
    spots = [(min(90.0, max(-90.0, a)), o) for a, o in spots]
    points = spark.createDataFrame([(i, *x) for i, x in enumerate(spots)], "p long, lat double, lon double")
    for metres in (40.0, 300.0, 1500.0, 9000.0):
        ends = [{(r["node"], r["component"]) for r in connected_components(pairs, "p", "q").collect()} for pairs in (near_links(points, metres), near_points(points, metres))]
        assert ends[0] == ends[1] and ends[0]
