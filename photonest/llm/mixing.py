"""Mixing overlapping sources to target weights by min-cost flow.

A membership pattern is the set of sources that share something: with ``mix``, the sources that a document
names; with ``mix_documents``, the sources that hold a document of equal text. Patterns supply words, sources
have quotas; an arc leads from a pattern to each of its sources. A pattern's words cost 0 on their first use, 1
on their second and so on (a convex cost), and a document's second use costs 1 more, so the cheapest flow takes
what other sources have not taken, and repeats only where a quota cannot be met by fresh words. The flow is
solved on the driver over sums by pattern; sources without shared texts need no flow.

Selection is seeded: documents of a pattern stand in the order of a hash, and each (pattern,
source) flow takes the next words of that order; copies of a text stand at the same place in each source, and
a source begins where the one before it ended, so that they take different texts while there are any. The order is
split into hash buckets whose sums are added up first, so that no pattern is one task's work. Documents are taken
whole; only the one on which a flow ends (or begins, between sources) is taken in part (``taken`` counts its words).

Null text has size 0; a null source is a source of its own, last in order. Empty tables give empty
results. Repeated rows are documents of their own, ordered by the hash of doc_id and size, then doc_id: rows that
agree in both are alike to every count, so it does not matter which of them comes first. Other columns never
take part.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photonest.llm.bitmap import Bitmap
from photonest.llm.common import salted_join, table
from photonest.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_targets(sizes: list[int], weights: list[float], share: float, ceiling: float) -> list[float]:
    """``share`` of all sizes dealt by weight; what exceeds ``ceiling`` times a size is dealt again."""
    total = share * sum(sizes)
    target = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > ceiling * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in sorted(over):
            target[i] = ceiling * sizes[i]
            left -= target[i]
            free.discard(i)
    return target


def cheapest_flow(supply: dict, arcs: dict, quota: dict) -> dict:
    """Words by (pattern, source) of the cheapest flow among those that meet the quotas as far as can be.

    supply: pattern to steps (words, price); arcs: (pattern, source) to steps; quota: source to words. Prices of
    steps do not fall. Shortest paths with potentials, and for each price a blocking flow; arcs hold integers.
    """
    names: dict = {"S": 0, "T": 1}
    heads: list[list[int]] = [[], []]
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []

    def node(key) -> int:
        if key not in names:
            names[key] = len(heads)
            heads.append([])
        return names[key]

    def arc(a: int, b: int, room: int, price: int) -> int:
        for x, y, c, p in ((a, b, room, price), (b, a, 0, -price)):
            heads[x].append(len(to))
            to.append(y)
            cap.append(c)
            cost.append(p)
        return len(to) - 2

    shipped: dict = {}
    for pattern in sorted(supply, key=repr):
        for words, price in supply[pattern]:
            arc(0, node(("p", pattern)), int(words), price)
    for pattern, source in sorted(arcs, key=repr):
        if source in quota and pattern in supply:
            shipped[pattern, source] = [arc(node(("p", pattern)), node(("s", source)), int(words), price) for words, price in arcs[pattern, source]]
    for source in sorted(quota, key=repr):
        arc(node(("s", source)), 1, int(quota[source]), 0)

    potential = [0] * len(heads)
    while True:
        best: list[float] = [float("inf")] * len(heads)
        via = [-1] * len(heads)
        best[0] = 0
        queue = [(0, 0)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > best[x]:
                continue
            for e in heads[x]:
                if cap[e] and d + cost[e] + potential[x] - potential[to[e]] < best[to[e]]:
                    best[to[e]] = d + cost[e] + potential[x] - potential[to[e]]
                    via[to[e]] = e
                    heapq.heappush(queue, (best[to[e]], to[e]))
        if via[1] < 0:
            break
        potential = [p + (b if b < float("inf") else 0) for p, b in zip(potential, best, strict=True)]

        def free(x: int, e: int, now: list[int] = potential) -> bool:
            """Whether an arc from x lies on a shortest path and has room."""
            return cap[e] > 0 and cost[e] + now[x] == now[to[e]]

        # All that fits on paths of this price, level by level; the next search then finds a greater price.
        while True:
            level, layer = {0: 0}, [0]
            while layer and 1 not in level:
                ahead = {to[e]: level[x] + 1 for x in layer for e in heads[x] if to[e] not in level and free(x, e)}
                level |= ahead
                layer = list(ahead)
            if 1 not in level:
                break
            turn, path, x = [0] * len(heads), [], 0
            while True:
                if x == 1:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    path, x = [], 0
                while turn[x] < len(heads[x]):
                    e = heads[x][turn[x]]
                    if level.get(to[e]) == level[x] + 1 and free(x, e):
                        break
                    turn[x] += 1
                if turn[x] < len(heads[x]):
                    path.append(heads[x][turn[x]])
                    x = to[path[-1]]
                elif path:  # a dead end
                    x = to[path.pop() ^ 1]
                    turn[x] += 1
                else:
                    break
    flow = {key: sum(cap[e ^ 1] for e in es) for key, es in shipped.items()}
    return {key: n for key, n in flow.items() if n}


def min_cost_flow(supply: dict, quota: dict, max_repeat: int = 2) -> dict:
    """The cheapest flow where use number r of a pattern's words costs r, for any of its sources (a tuple)."""
    steps = {p: [(n, use) for use in range(max_repeat)] for p, n in supply.items()}
    return cheapest_flow(steps, {(p, s): [(1 << 62, 0)] for p in supply for s in p}, quota)


def _placed(rows: DataFrame, plan: DataFrame, id_col: str, size: str) -> DataFrame:
    """``rows`` (with the group ``_g`` and the hash ``_r``) and ``taken``.

    plan: ``_g``, ``_full`` passes over the group's words, and of the next pass ``_rest`` words from ``_start`` on, the
    first of ``_n`` words following the last; ``_buckets``.
    """
    placed = rows.join(F.broadcast(plan), "_g")
    # The bucket is the top of the hash, so that buckets stand in hash order.
    unit = (F.shiftright("_r", 11).cast("double") + F.lit(float(1 << 52))) / F.lit(float(1 << 53))
    placed = placed.withColumn("_b", F.least(F.floor(unit * F.col("_buckets")), F.col("_buckets") - 1).cast("long"))
    sums = placed.groupBy("_g", "_b").agg(F.sum(size).alias("_sum"))
    ahead = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_g", "_b", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    sums = materialize(sums, "bucket-sums", thin=True)
    inside = Window.partitionBy("_g", "_b").orderBy("_r", id_col).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_ahead") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    end = F.col("_start") + F.col("_rest")
    first = F.least(F.col("_before") + F.col(size), F.least(end, F.col("_n"))) - F.greatest("_before", "_start")
    again = F.least(F.col(size), end - F.col("_n") - F.col("_before"))
    part = F.greatest(F.lit(0), first) + F.greatest(F.lit(0), again)
    return (
        placed.join(sums, ["_g", "_b"])
        .withColumn("_before", before)
        .withColumn("taken", (F.col("_full") * F.col(size) + part).cast("long"))
        .drop("_g", "_full", "_rest", "_start", "_n", "_buckets", "_r", "_b", "_ahead", "_before")
    )


_PLAN = "_g string, _full long, _rest long, _start long, _n long, _buckets long"


def mix(
    df: DataFrame,
    sources: str = "sources",
    size: str = "size",
    id_col: str = "doc_id",
    targets: dict | None = None,
    max_repeat: int = 2,
    seed: int = 17,
    docs_per_bucket: int = 2000,
    max_patterns: int = 100_000,
) -> DataFrame:
    """Add ``taken`` (words taken, repeats counted) to ``df``.

    ``sources``: array of source names of a document (null: the nameless source). ``targets``: words
    wanted by source. Beyond ``max_patterns`` distinct patterns of several sources it raises an error.
    """
    targets = targets or {}
    pattern = F.array_sort(F.array_distinct(F.transform(F.col(sources), lambda s: F.coalesce(s, F.lit("\0null")))))
    keyed = df.withColumn("_p", F.to_json(pattern))
    found = keyed.groupBy("_p").agg(F.sum(size).alias("n"), F.count("*").alias("docs"), F.first(pattern).alias("s"))
    found = found.collect()
    quota = {k if k is not None else "\0null": round(v) for k, v in targets.items()}
    supply = {tuple(r["s"]): r["n"] for r in found}
    # A source that shares no document needs no flow.
    tied = {s for p in supply if len(p) > 1 for s in p}
    if sum(len(p) > 1 for p in supply) > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns of several sources")
    flow = {(p, p[0]): min(quota.get(p[0], 0), max_repeat * n) for p, n in supply.items() if len(p) == 1 and p[0] not in tied}
    flow |= min_cost_flow({p: n for p, n in supply.items() if tied & {*p}}, {s: n for s, n in quota.items() if s in tied}, max_repeat)
    due: dict = defaultdict(int)
    for (p, _), n in flow.items():
        due[p] += n
    # Full passes over a pattern, and the words of the pass that is cut short.
    plan = [
        (r["_p"], due[tuple(r["s"])] // r["n"], due[tuple(r["s"])] % r["n"], 0, r["n"], max(1, -(-r["docs"] // docs_per_bucket)))
        if r["n"]
        else (r["_p"], 0, 0, 0, 0, 1)
        for r in found
    ]
    rank = F.xxhash64(F.lit(seed), F.col(id_col), F.col(size))
    return _placed(keyed.withColumnRenamed("_p", "_g").withColumn("_r", rank), df.sparkSession.createDataFrame(plan, _PLAN), id_col, size)


#: Copies of one text beyond which they do not stand at one place of the order, but each at its own.
CLOSE = 100


def _shared_texts(sized: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """``(th, _p, copies)`` of texts that several sources hold, and words by pattern, all of them."""
    several = sized.groupBy("th").agg(F.min("_s").alias("a"), F.max("_s").alias("b")).where("a <> b").select("th")
    rows = Bitmap(materialize(several, "shared-texts", thin=True), "th").keep(sized, "th")
    texts = rows.groupBy("th").agg(F.array_sort(F.collect_set("_s")).alias("s"), F.count("*").alias("copies"), F.max("size").alias("size"))
    texts = materialize(texts.where("size(s) > 1 and size > 0").select("th", F.to_json("s").alias("_p"), "copies", "size"), "shared-patterns", thin=True)
    words = {r["_p"]: r["n"] for r in texts.groupBy("_p").agg(F.sum("size").alias("n")).collect()}
    return texts.select("th", "_p", "copies"), words


def _planned(groups: list, words: dict[str, int], quota: dict[str, int], most: int, docs_per_bucket: int) -> list[tuple]:
    """The plan of ``groups`` (rows of _p, _s, n, docs): the flow of each, and where its cut pass begins."""
    tied = {r["_s"] for r in groups if r["_p"] in words}
    supply = {p: [(n, use) for use in range(4)] + [(1 << 62, 4)] for p, n in words.items()}
    supply |= {r["_p"]: [(1 << 62, 0)] for r in groups if r["_s"] in tied and r["_p"] not in words}
    arcs = {(r["_p"], r["_s"]): [(r["n"], use) for use in range(most)] for r in groups if r["_s"] in tied}
    flow = cheapest_flow(supply, arcs, {s: quota[s] for s in tied})
    plan, at = [], defaultdict(float)
    for r in sorted(groups, key=lambda r: (r["_p"], r["_s"])):
        n = r["n"]
        due = flow.get((r["_p"], r["_s"]), 0) if r["_s"] in tied else min(quota[r["_s"]], most * n)
        rest = due % n if n else 0
        start = round(at[r["_p"]] * n) % n if n else 0
        if r["_p"] in words and n:
            at[r["_p"]] = (at[r["_p"]] + rest / n) % 1.0
        plan.append((f"{r['_p']} {r['_s']}", due // n if n else 0, rest, start, n, max(1, -(-r["docs"] // docs_per_bucket))))
    return plan


def mix_documents(
    df: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 17,
    docs_per_bucket: int = 2000,
    max_patterns: int = 2000,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, pattern)``; sources in code point order weigh ``weights`` in turn.

    ``pattern`` tells the sources that hold the document's text. The driver holds some bytes a source and some KB a
    pattern; every pattern takes part in the flow, whatever ``max_patterns`` says, which only callers of old still name.
    """
    spark = df.sparkSession
    name = F.coalesce(F.col("source").cast("string"), F.lit("\0null"))
    sized = df.select("doc_id", name.alias("_s"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("th"))
    sized = materialize(sized, "sizes")
    shared, words = _shared_texts(sized)
    own = F.xxhash64(F.lit(seed), "doc_id", "size")
    alone = F.to_json(F.array("_s"))
    if words:
        maybe, rest = Bitmap(shared, "th").split(sized, "th")
        maybe = salted_join(maybe, shared, "th", "doc_id")
        rank = F.when(F.col("copies") <= CLOSE, F.xxhash64(F.lit(seed), "th")).otherwise(own)
        maybe = maybe.select("doc_id", "_s", "size", F.coalesce("_p", alone).alias("_p"), rank.alias("_r"))
        rows = rest.select("doc_id", "_s", "size", alone.alias("_p"), own.alias("_r")).unionByName(maybe)
    else:
        rows = sized.select("doc_id", "_s", "size", alone.alias("_p"), own.alias("_r"))
    rows = materialize(rows.withColumn("_g", F.concat_ws(" ", "_p", "_s")), "patterned")
    groups = rows.groupBy("_p", "_s").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
    totals: dict = defaultdict(int)
    for r in groups:
        totals[r["_s"]] += r["n"]
    order = sorted(totals, key=lambda s: (s == "\0null", s))
    goal = shared_targets([totals[s] for s in order], [weights[i % len(weights)] for i in range(len(order))], share, ceiling)
    plan = _planned(groups, words, {s: round(g) for s, g in zip(order, goal, strict=True)}, max(1, int(ceiling)), docs_per_bucket)
    goals = F.broadcast(spark.createDataFrame([(s, totals[s], g) for s, g in zip(order, goal, strict=True)], "_s string, source_size long, target double"))
    mixed = _placed(rows, spark.createDataFrame(plan, _PLAN), "doc_id", "size")
    return mixed.join(goals, "_s").select("doc_id", "size", "source_size", "target", "taken", F.col("_p").alias("pattern"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def take_mix(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, in whole copies, with all their columns.

    Within a source the mix takes every document equally often, and those up to some place of the seeded
    order once more. That place is found on thin rows and broadcast, one row a source, so texts do not move.
    Documents without words are not taken. Equal texts are meant to be gone by then, so no two sources share any.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    at = {c: F.col(names[df.columns.index(c)]) for c in ("doc_id", "source", "text")}
    plain = df.toDF(*names)
    thin = plain.select(at["doc_id"].alias("doc_id"), at["source"].alias("source"), word_count(at["text"]).alias("size"))
    thin = materialize(thin, "sizes")
    totals = thin.groupBy("source").agg(F.sum("size").alias("n")).collect()
    totals = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = shared_targets([r["n"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], share, ceiling)
    targets = {r["source"]: g for r, g in zip(totals, goal, strict=True)}
    mixed = mix(thin.withColumn("sources", F.array("source")), targets=targets, max_repeat=max(1, int(ceiling)), seed=seed)
    copies = F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    cuts = mixed.where("size > 0").select(F.col("source").alias("_s"), copies.alias("k"), place.alias("r"))
    cuts = cuts.groupBy("_s").agg(F.min("k").alias("_low"), F.max(F.struct("k", "r")).alias("_cut"))
    cuts = F.broadcast(materialize(cuts, "cuts", thin=True))
    rows = plain.withColumn("_size", word_count(at["text"])).where("_size > 0")
    rows = rows.join(cuts, at["source"].eqNullSafe(F.col("_s")))
    own = F.xxhash64(F.lit(seed), at["doc_id"], F.col("_size"))
    times = F.col("_low") + F.when((F.col("_cut.k") > F.col("_low")) & (own <= F.col("_cut.r")), 1).otherwise(0)
    rows = rows.withColumn("_n", times).where("_n > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*names).toDF(*df.columns)
