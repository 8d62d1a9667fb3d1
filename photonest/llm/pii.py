"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base spans come from fixed patterns and checks. They are the seeds. Runs of identifier-like characters, single
spaces included, are instances; the words around a run are its lexical patterns (the word before, the two words
before, the word after; in lower case, digits as 9). Spark scores the graph of patterns and instances in rounds:
a pattern's confidence is the share of all its occurrences in the texts, ordinary words beside it included, that
stand beside an instance believed in (instances that are neither seeds nor believed in yet count on no side), and
counts only with enough distinct seeds; an instance's is that of any of
its patterns being right. Instances that may be of a kind (``LOOSE``) and that confident patterns vouch for are
added to the spans, unless they overlap a base span; of several kinds the one vouched for most, then the first.

Positions are code points, end exclusive. They follow from the pieces between matches, which ``split``
and ``regexp_extract_all`` cut alike. The patterns are written with possessive repeats and may start
only where a run starts or the last match ended; they find the same matches as the plain ones, without
backtracking. Intermediate tables hold digests of instances, never the instances. Null and empty texts have no
spans; repeated rows get equal spans; other columns never take part; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonest.llm.common import table
from photonest.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: The plain patterns are: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, [0-9]+(\.[0-9]+){3},
#: [0-9]([\x20-]?[0-9])+ and \+[0-9][\x20().0-9-]+[0-9].
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A run of identifier-like characters: around an @ (or "at" in brackets), groups of hex digits between colons, or
#: groups of digits with a few marks between them.
RUN = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9._-]++"
    r"|(?<![A-Za-z0-9:])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){3,7}+(?![A-Za-z0-9:])"
    r"|(?<![A-Za-z0-9])[+(]{0,2}[0-9]++(?:[\x20()./-]{1,3}+[0-9]++)*+(?![A-Za-z0-9])"
)
#: What an instance may be besides what the base patterns take.
LOOSE = {
    "email": r"@|[(\[]at[)\]]",
    "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){2,5}$|:.*:.*:",
    "card": r"^[0-9]([^0-9]{0,2}[0-9]){11,18}$",
    "phone": r"^[+(]{0,2}[0-9]([^0-9]{0,3}[0-9]){6,14}$",
}
ROUNDS, LEAST_SEEDS, LEAST_CONFIDENCE = 3, 3, 0.8
_WS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    one = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(F.lit(2) * digit(i) - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + one(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))


def _starts(hits: Column, gaps: Column) -> Column:
    """Where each match starts: the lengths of what stands before it, added up.

    Growing an array copies it, so the sums are made in blocks of about the root of the number of matches.
    """
    n = F.size(hits)
    block = F.ceil(F.sqrt(n)).cast("int")
    nothing = lambda: F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda acc, i: F.struct(
        (acc["at"] + F.length(F.get(gaps, i)) + F.length(F.get(hits, i))).alias("at"),
        F.concat(acc["starts"], F.array(acc["at"] + F.length(F.get(gaps, i)))).alias("starts"),
    )
    blocks = F.transform(
        F.sequence(F.lit(0), (n - 1).cast("int"), block),
        lambda first: F.aggregate(F.sequence(first, F.least(first + block, n) - 1), nothing(), step),
    )
    whole = F.aggregate(blocks, nothing(), lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))
    return F.flatten(F.zip_with(blocks, whole["starts"], lambda x, at: F.transform(x["starts"], lambda s: s + at)))


_SPAN = "array<struct<k:int,a:int,b:int>>"


def _spans(kind: str, hits: Column, gaps: Column) -> Column:
    """Valid matches as (number of the kind, start, end)."""
    starts = _starts(hits, gaps)
    made = F.zip_with(
        hits,
        starts,
        lambda h, a: F.when(_valid(kind, h), F.struct(F.lit(KINDS.index(kind)).alias("k"), a.alias("a"), (a + F.length(h)).alias("b"))),
    )
    return F.when(F.size(hits) > 0, F.filter(made, lambda x: x.isNotNull())).otherwise(F.array()).cast(_SPAN)


def _found(text: Column, pattern: str, only_if: Column | None = None) -> Column:
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return hits if only_if is None else F.when(only_if, hits).otherwise(F.array().cast("array<string>"))


def _gaps(text: Column, pattern: str, hits: Column) -> Column:
    return F.when(F.size(hits) > 0, F.split(text, pattern, -1))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["a"].cast("string"), x["b"].cast("string")))
    return F.array_join(shown, ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row, base, runs)``: base spans, and runs with their places and neighbouring words."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = F.col("t")
    needs = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+"))}
    rows = rows.select("*", *[_found(t, PATTERNS[k], needs.get(k)).alias(f"h_{k}") for k in KINDS], _found(t, RUN).alias("h_run"))
    rows = rows.select(
        "doc_id", *[f"h_{k}" for k in (*KINDS, "run")],
        *[_gaps(t, PATTERNS[k] if k != "run" else RUN, F.col(f"h_{k}")).alias(f"g_{k}") for k in (*KINDS, "run")],
    )
    spans = F.concat(*[_spans(k, F.col(f"h_{k}"), F.col(f"g_{k}")) for k in KINDS])
    rows = rows.select("doc_id", spans.alias("base"), F.col("h_run").alias("hits"), F.col("g_run").alias("gaps"), F.transform("g_run", F.reverse).alias("back"))
    hits, gaps = F.col("hits"), F.col("gaps")
    shown = lambda x: F.regexp_replace(F.lower(x), "[0-9]", "9")
    last = lambda i, words: shown(F.reverse(F.regexp_extract(F.get(F.col("back"), i), f"^{_WS}*+({words})", 1)))
    runs = F.zip_with(
        F.sequence(F.lit(0), F.size(hits) - 1),
        _starts(hits, gaps),
        lambda i, a: F.struct(
            F.get(hits, i).alias("value"),
            a.alias("a"),
            F.array(
                F.concat(F.lit("1:"), last(i, f"{_WORD}++")),
                F.concat(F.lit("2:"), last(i, f"{_WORD}++{_WS}++{_WORD}++")),
                F.concat(F.lit("r:"), shown(F.regexp_extract(F.get(gaps, i + 1), f"^{_WS}*+({_WORD}++)", 1))),
            ).alias("pats"),
        ),
    )
    # Full stops and the like behind an instance are not its own.
    runs = F.transform(runs, lambda r: F.struct(F.regexp_replace(r["value"], "[^A-Za-z0-9]+$", "").alias("value"), r["a"].alias("a"), r["pats"].alias("pats")))
    runs = F.transform(
        runs,
        lambda r: F.struct(
            F.sha2(r["value"], 256).alias("value"),
            r["a"].alias("a"),
            (r["a"] + F.length(r["value"])).alias("b"),
            F.array(*[r["value"].rlike(LOOSE[k]) for k in KINDS]).alias("may"),
            F.filter(r["pats"], lambda p: F.length(p) > 2).alias("pats"),
        ),
    )
    runs = F.when(F.size(hits) > 0, F.filter(runs, lambda r: F.exists(r["may"], lambda x: x)))
    return rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "base", runs.alias("runs"))


def instances(scanned: DataFrame) -> DataFrame:
    """``(row, kind, value, a, b, pats, seed)``, a row for each kind that a run is (seed) or may be of; ``value`` is a digest."""
    runs = scanned.where("size(runs) > 0").select("row", "base", F.explode("runs").alias("r")).select("row", "base", "r.*")
    over = F.filter("base", lambda x: (x["a"] < F.col("b")) & (F.col("a") < x["b"]))
    may = F.filter(F.array(*[F.when(F.get("may", F.lit(i)), F.lit(i)) for i in range(len(KINDS))]), lambda x: x.isNotNull())
    runs = runs.withColumn("over", F.array_distinct(F.transform(over, lambda x: x["k"])))
    runs = runs.withColumn("seed", F.size("over") > 0).withColumn("kind", F.explode(F.when(F.size("over") > 0, F.col("over")).otherwise(may)))
    return runs.select("row", "kind", "value", "a", "b", "pats", "seed")


def _occurrences(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(gram, n)``: how often each word or pair of words of ``wanted(gram)`` stands in ``texts(t)``."""
    words = F.split(F.regexp_replace(F.lower(F.col("t")), "[0-9]", "9"), f"{_WS}+")
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(F.get("w", i), F.lit(" "), F.get("w", i + 1)))
    grams = texts.select(words.alias("w")).select(F.explode(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("gram"))
    return grams.join(wanted, "gram").groupBy("gram").agg(F.count("*").alias("n"))


def vouched(
    found: DataFrame, texts: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least: float = LEAST_CONFIDENCE
) -> tuple[DataFrame, DataFrame]:
    """``(kind, value, c)`` of instances that are no seeds but that confident patterns vouch for, and ``(kind, pat, score)`` of those patterns."""
    edges = found.select("kind", "value", "seed", F.explode("pats").alias("pat"))
    edges = materialize(edges.groupBy("kind", "pat", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("occ")), "pattern-edges", thin=True)
    known = edges.groupBy("kind", "pat").agg(F.sum(F.col("seed").cast("long")).alias("seeds"), F.sum("occ").alias("all"), F.sum(F.when(F.col("seed"), 0).otherwise(F.col("occ"))).alias("open")).where(F.col("seeds") >= least_seeds)
    gram = F.regexp_replace(F.substring("pat", 3, 1 << 30), f"{_WS}+", " ")
    known = materialize(known.select("kind", "pat", "all", "open", gram.alias("gram")), "seeded-patterns", thin=True)
    counts = materialize(_occurrences(texts, known.select("gram").distinct()), "occurrences", thin=True)
    # Where an instance is glued to the word before it, the word does not stand alone in the text.
    known = known.join(counts, "gram", "left").select("kind", "pat", (F.greatest("all", F.coalesce("n", F.lit(0))) - F.col("open")).alias("n"))
    known = materialize(known, "pattern-counts", thin=True)
    belief = edges.select("kind", "pat", "seed", F.col("seed").cast("double").alias("conf"), "occ")
    sure = scores = None
    for i in range(rounds):
        believed = belief.groupBy("kind", "pat").agg(
            F.sum(F.col("conf") * F.col("occ")).alias("believed"), F.sum(F.when(F.col("seed"), 0.0).otherwise(F.col("conf") * F.col("occ"))).alias("more")
        )
        scores = known.join(believed, ["kind", "pat"]).select("kind", "pat", (F.col("believed") / (F.col("n") + F.col("more") + 0.5)).alias("score"))
        scores = materialize(scores.where(F.col("score") >= least), "patterns", thin=True)
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1.0) - F.col("score"), F.lit(1e-9)))))
        sure = edges.where("not seed").join(scores, ["kind", "pat"]).groupBy("kind", "value").agg((F.lit(1.0) - doubt).alias("c"))
        sure = materialize(sure.where(F.col("c") >= least), "vouched", thin=True)
        if i + 1 < rounds:
            belief = edges.join(sure, ["kind", "value"], "left").select(
                "kind", "pat", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("c", F.lit(0.0))).alias("conf"), "occ"
            )
    return sure, scores


def extract(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, counts of base spans, their digest, and all spans."""
    scanned = materialize(scan(df, id_col, text_col), "scanned")
    found = materialize(instances(scanned), "instances", thin=True)
    sure, _ = vouched(found, df.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")))
    more = found.where("not seed").join(sure, ["kind", "value"]).groupBy("row", "a", "b").agg(F.max(F.struct("c", (-F.col("kind")).alias("k"))).alias("m"))
    more = more.groupBy("row").agg(F.collect_list(F.struct((-F.col("m.k")).alias("k"), "a", "b")).cast(_SPAN).alias("more"))
    joined = scanned.drop("runs").join(materialize(more, "added", thin=True), "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))))
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return joined.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _text_of(every).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_added"),
    )


def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "documents"))
