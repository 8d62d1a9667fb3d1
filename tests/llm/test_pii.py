"""Base spans against plain regular expressions over a whole table, and discovery of planted identifiers."""

import hashlib
import random
import re
import time

from photonest.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def show(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(df):
    texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    got = pii.extract(df).collect()
    assert len(got) == df.count()
    for r in got:
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(show(want).encode()).hexdigest(), texts[r["doc_id"]][:300]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        assert set(show(want).split(",")) - {""} <= set(r["spans"].split(","))
    return got


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(df.select("doc_id", "text"))


def test_random_texts(spark):
    rng = random.Random(9)
    bits = ["4111 1111 1111 1111", "1.2.3.4", "10.0.0.256", "a@b.c", "x.y@z", "@", "+1 (017) 555-7713", "+", "12", " ", "  ", ".", "-", "é", "日", "😀", "mail: ", "a", "(", "00001.2.3.4", "::1:2:f", "x(at)y.z"]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(600))]
    rows = [(i, t, "k", "v") for i, t in enumerate(texts)] + [(5, texts[5], None, None)]
    check(spark.createDataFrame(rows, "doc_id long, text string, kind string, value string").repartition(4))
    assert pii.extract(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_planted_identifiers_are_discovered(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = lambda: next(x for x in iter(lambda: digits(16), None) if luhn(x))
    bad_card = lambda: next(x for x in iter(lambda: digits(16), None) if not luhn(x))
    seeds = {
        "email": lambda: f"contact address {digits(4)}@mail{digits(2)}.com",
        "ip": lambda: f"server host {rng.randint(1, 255)}.{rng.randint(0, 255)}.0.{rng.randint(1, 255)}",
        "card": lambda: f"credit card: {card()}",
        "phone": lambda: f"please call +1 ({digits(3)}) 555-{digits(4)}",
    }
    unseen = {
        "email": lambda: ("contact address ", f"{digits(4)}x@intranet"),
        "ip": lambda: ("server host ", f"fe80:0:{digits(3)}:{digits(4)}:1"),
        "card": lambda: ("credit card: ", " ".join(re.findall("....", bad_card()))),
        "phone": lambda: ("please call ", f"({digits(3)}) 555-{digits(4)}"),
    }
    rows, want, plain = [], {}, []
    for i in range(400):
        kind = pii.KINDS[i % 4]
        head = say(rng.randint(5, 40)) + " "
        if i % 20 < 4:
            lead, value = unseen[kind]()
            want[i] = (kind, len(head) + len(lead), len(head) + len(lead) + len(value))
            body = lead + value
        elif i % 20 < 8:  # numbers elsewhere
            plain.append(i)
            body = f"{say(1)} {bad_card()}"
        else:
            body = seeds[kind]()
        rows.append((i, f"{head}{body} {say(rng.randint(3, 30))}"))
    got = {r["doc_id"]: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = [i for i, x in want.items() if show([x]) in got[i]["spans"].split(",")]
    assert len(found) >= 0.9 * len(want), (len(found), len(want))
    assert all(got[i]["n_added"] == 0 for i in got if i not in want)


def test_function_words_vouch_for_nothing(spark):
    rows = [(i, f"so the 10.0.0.{i} and then the number 1234567{i:03d} and the end of the day and the rest") for i in range(40)]
    assert pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).where("n_added > 0").count() == 0


def test_many_matches_take_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(f"10.0.{i % 256}.{i // 256 % 256}" for i in range(n)))], "doc_id long, text string")
        start = time.time()
        assert pii.extract(df).first()["n_ip"] == n
        return time.time() - start

    seconds(100)
    assert seconds(32_000) < 15
