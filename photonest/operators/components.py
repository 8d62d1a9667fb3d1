"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonest.session import materialize

#: Ways in which the neighbours of one node are dealt out, so that a hub is no single task's work.
SALTS = 16
#: Nodes whose forest one task holds before it hands it on and starts anew.
FOREST = 1 << 20


def contracted(edges: DataFrame, src: str = "src", dst: str = "dst", limit: int = FOREST) -> DataFrame:
    """``(src, dst)``: stars that connect the same nodes as ``edges`` of longs, made in each partition as it is.

    Long chains whose edges lie together become one star without a shuffle, which saves rounds later. A forest is
    handed on at ``limit`` nodes; then one node may be in several stars. Self-loops and null ends are dropped.
    """
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            trail = []
            while (higher := parent.get(x, x)) != x:
                trail.append(x)
                x = higher
            for y in trail:
                parent[y] = x
            return x

        def forest() -> pa.RecordBatch:
            nodes = list(parent)
            stars = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(n) for n in nodes], pa.int64())], schema=schema)
            parent.clear()
            return stars

        for batch in batches:
            for a, b in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                ends = sorted((top(a), top(b)))
                if ends[0] != ends[1]:
                    parent[ends[1]] = ends[0]
            if len(parent) >= limit:
                yield forest()
        yield forest()

    ends = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
    return ends.where("src <> dst").mapInArrow(run, "src long, dst long")


def _with_min(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` with ``m``, the least of u and all its neighbours v. The join is salted on both sides."""
    mins = edges.groupBy("u").agg(F.min("v").alias("m"))
    mins = mins.select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = edges.withColumn("s", F.pmod(F.hash("v"), F.lit(SALTS)))
    return salted.join(mins, ["u", "s"]).select("u", "v", "m")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that has an edge; component is the least node reachable.

    Self-loops count as nodes, null ends are ignored, an empty input gives an empty result.
    Edges never reach the driver, only a count and a checksum a round. Rounds go on until nothing changes: each moves
    edges to lesser nodes, so they end, after about the square of the logarithm of the number of nodes at most.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    stars = materialize(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", thin=True
    )
    seen = _mark(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large.distinct(), "large-star", thin=True)
        joined = _with_min(large)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            large.groupBy("u").agg(F.min("v").alias("v"))
        )
        stars = materialize(small.where("u <> v").distinct(), "small-star", thin=True)
        now = _mark(stars)
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
