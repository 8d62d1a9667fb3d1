"""Text operators against plain Python on a small table with nulls, empties, copies, near copies and long texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from photonest.llm import bpe, exact_dedup, flac, language, mixing, pii, simhash, suffix_dedup, token_store, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, h string"


def rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " ", "  a  b ", "x" * 900, make(4000), "Tab\tand\nnew \x0b line", "mail a@b.c x, +1 (017) 555-7713, 1.2.3.999 10.0.0.1, card 4111 1111 1111 1111"]
    texts += [make(rng.randint(1, 200)) for _ in range(40)]
    passage, base = make(90), make(300)
    texts += [make(20) + " " + passage + " " + make(20) for _ in range(4)] + [base] * 3 + [base.upper()] + [base + " tail"]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), None, "k", "s", "h") for i, t in enumerate(texts)]
    return out + [out[10]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact(docs, none):
    got = exact_dedup.duplicate_classes(docs).collect()
    groups = {}
    for r in rows():
        groups.setdefault(lowered(r[1]), []).append(r[0])
    want = {hashlib.sha256(k.encode()).hexdigest(): (max(v), len(v)) for k, v in groups.items()}
    assert len(got) == len(rows()) and sum(r["kept"] for r in got) == len(groups)
    assert all(want[r["text_sha256"]] == (r["keep_id"], r["group_size"]) for r in got)
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs).collect()) == sorted(max(v) for v in groups.values())
    ranged = exact_dedup.duplicate_classes(docs, max_blocks=16).collect()  # more texts than a filter takes
    assert sorted(r[:5] for r in ranged) == sorted(r[:5] for r in got)
    assert exact_dedup.duplicate_classes(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).columns == none.columns


def test_simhash(docs, none):
    got = {(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicate_classes(docs).collect()}

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {r[0]: fp(r[1]) for r in rows()}
    group = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            group[a] = min(group[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3)
    assert got == {(i, p, group[i]) for i, p in prints.items()}
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == set(group.values())
    assert simhash.near_duplicate_classes(none).count() == 0


def test_suffix(docs, none):
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    texts = [(r[0], (r[1] or "").encode()) for r in rows()]
    seen = {}
    for _, t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    for i, t in texts:
        mask = np.zeros(len(t) + 1, int)
        for s in range(len(t) - 199):
            if seen[t[s : s + 200]] > 1:
                mask[s : s + 200] = 1
        kept = bytes(c for c, m in zip(t, mask, strict=False) if not m)
        assert got[i] == (int(mask.sum()), int((np.diff(np.concatenate([[0], mask])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_mix(docs, none):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows()) and all(r["taken"] <= 2 * r["size"] for r in got)
    by_target = {}
    for r in got:
        by_target.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - t) <= 1 for (_, t), v in by_target.items())
    assert sorted(got) == sorted(mixing.mix_documents(docs.repartition(3)).collect())
    assert mixing.mix_documents(none).count() == 0 and mixing.take_mix(docs).columns == docs.columns


def test_min_cost_flow_prefers_fresh_words():
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10}, {"a": 12, "b": 8}, 2)
    assert flow == {(("a",), "a"): 10, (("a", "b"), "a"): 2, (("a", "b"), "b"): 8}


def test_bpe_and_store(docs, none, spark, tmp_path):
    import tiktoken
    from tokenizers import Tokenizer

    path, pattern = bpe.tokenizer_file("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern)[0].ranks, special_tokens={})
    for r in bpe.bpe_round_trip(docs).collect():
        text = next(x[1] or "" for x in rows() if x[0] == r["doc_id"])
        ids = np.array(library.encode_ordinary(text), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.bpe_round_trip(none).count() == 0

    vocabulary, pattern = bpe.tokenizer_file("byte_bpe_50k.json")
    tokenizer, start = Tokenizer.from_file(vocabulary), 0
    token_store.write_store(docs, f"{tmp_path}/s", vocabulary, pattern)
    got = token_store.read_store(spark, f"{tmp_path}/s").orderBy("start").collect()
    for r, x in zip(got, sorted(rows(), key=lambda x: x[0]), strict=True):
        ids = [*tokenizer.encode(x[1] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (x[0], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert token_store.check_manifest(spark, f"{tmp_path}/s") == []
    token_store.write_store(none, f"{tmp_path}/e", vocabulary, pattern)
    assert token_store.read_store(spark, f"{tmp_path}/e").count() == 0


def test_flac(docs, none):
    media = flac.store(docs)
    got = flac.describe(flac.pcm_blocks(media)).collect()
    streams = {r["doc_id"]: r["media"] for r in media.collect()}
    assert len(got) == len(rows())
    for r in got:
        text = next((x[1] or "").encode() for x in rows() if x[0] == r["doc_id"])
        whole, stream = flac.payload(text), streams[r["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(text), len(whole), zlib.crc32(whole[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest()
        assert (r["media_bytes"], r["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())
        assert ((flac.Reader(stream).samples()[0] + 128).astype(np.uint8) == np.frombuffer(whole, np.uint8)).all()
    assert flac.describe(flac.pcm_blocks(flac.store(none))).count() == 0


def signals():
    rng = np.random.default_rng(3)
    wave = (90 * np.sin(np.arange(9000) / 7)).astype(int)
    return [wave, rng.integers(-128, 128, 5000), np.full(300, -7), np.array([5]), np.array([1, 2]), rng.integers(-3, 4, 4097), np.cumsum(rng.integers(-1, 2, 5000)) % 90, np.empty(0, int)]


@pytest.mark.parametrize("order", [0, 4, 6, 12])
@pytest.mark.parametrize("depth", [8, 16, 24])
def test_flac_streams(order, depth):
    loud = [x << (depth - 8) if i % 2 else x for i, x in enumerate(signals())]
    streams = flac.encode_many(loud, depth=depth, lpc_order=order)
    kinds = set()
    for x, data, (reader, blocks) in zip(loud, streams, flac.decode_many(streams), strict=True):
        assert (np.concatenate([np.empty(0, int), *(y for _, y in blocks)]) == x).all()
        assert [at for at, _ in blocks] == list(range(0, len(x), flac.BLOCK))
        assert (flac.Reader(data).samples()[0] == x).all()
        for start in (0, 1, 4090, len(x) - 3):
            if 0 <= start < len(x):
                assert (flac.Reader(data).read(start, 50)[0] == x[start : start + 50]).all()
        kinds |= {data[reader._head(at)[0]] >> 1 for at in reader._ends[:-1]}
    assert {0, 1} <= kinds and (not order or max(kinds) == 32 + order - 1)


def test_flac_damage():
    data = flac.encode_many([signals()[0]])[0]
    first = flac.Reader(data).first
    for at in (first + 1, first + 4, first + 60, len(data) - 9, len(data) - 1, 30):
        broken = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
        with pytest.raises(ValueError):
            flac.decode_many([broken])
        with pytest.raises(ValueError):
            flac.Reader(broken).samples()


def test_pcm_is_read_by_offset():
    offsets, blocks = [0, 4, 8], [b"abcd", b"efgh", b"ij"]
    for start in range(11):
        for count in range(1, 12):
            assert flac.read_pcm(offsets, blocks, start, count) == b"abcdefghij"[start : start + count]
    assert flac.read_pcm([], [], 0, 4) == b""


def test_pii(docs, spark):
    got = {r["doc_id"]: r for r in pii.extract(docs).collect()}
    assert got[7]["spans"].startswith("email:5:10,ip:") and [got[7][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    context = [f"user mail: u{i}@ex{i}.com sent" for i in range(9)] + ["user mail: joe_at@localhost sent"]
    found = pii.extract(spark.createDataFrame(list(enumerate(context)), "doc_id long, text string")).where("n_added > 0").collect()
    assert [(r["doc_id"], r["spans"]) for r in found] == [(9, "email:11:27")]


def test_language(spark):
    table = [(i, ("the cat sat on the mat " if i % 2 else "der hund lief durch das haus ") * (1 + i % 5), "en" if i % 2 else "de") for i in range(60)]
    table += [(100, None, "en"), (101, "123 !", None), (102, "the mat der hund the cat das haus " * 20, None)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string").withColumn("held_out", F.lit(False))
    got = {r["doc_id"]: r for r in language.identify_languages(df, language.fit_language_model(df)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in table[:60]) and got[100]["lang_pred"] == got[101]["lang_pred"] == "und"
    assert {x.split(":")[0] for x in got[102]["mixture"].split(",")} == {"de", "en"}


def test_toxicity(spark):
    rng = random.Random(4)
    filler = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    table, labels = [], []
    for i in range(600):
        words = [rng.choice(filler) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["vilezz", "vilewort", "blaggard"])
        table.append((i, " ".join(words) + "."))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame([*table, (900, None), (901, "")], "doc_id long, text string")
    tagger = toxicity.tagger_of(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, tagger).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels) and got[900]["predicted"] == got[901]["predicted"] == 0
    a, b = map(int, got[0]["spans"].split(":"))
    assert table[0][1][a:b] in ("vilezz", "vilewort", "blaggard")
    assert sorted(r["doc_id"] for r in toxicity.drop_toxic(docs, tagger).collect()) == sorted([i for i, y in labels if not y] + [900, 901])
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.tagger_of(docs, empty)).where("predicted = 1").count() == 0


def test_marginals_equal_those_of_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    length = np.array([1, 4, 6, 6])
    emit, trans = rng.normal(0, 2, (4, 6)), rng.normal(0, 1, (2, 2))
    token, pairs, log_z = toxicity.batch_marginals(emit, trans, length)
    for c, n in enumerate(length):
        total, one, two = 0.0, np.zeros(6), np.zeros((2, 2))
        for path in product((0, 1), repeat=int(n)):
            weight = np.exp(sum(emit[c, i] for i in range(n) if path[i]) + sum(trans[path[i], path[i + 1]] for i in range(n - 1)))
            total += weight
            for i in range(n):
                one[i] += weight * path[i]
                if i + 1 < n:
                    two[path[i], path[i + 1]] += weight
        assert np.allclose(token[c], one / total) and np.allclose(pairs[c], two / total) and np.isclose(log_z[c], np.log(total))
        assert np.allclose(toxicity.chain_marginals(emit[c, :n].tolist(), trans), (one / total)[:n])


def test_skipped_sentences_hold_no_marginal_that_counts():
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioumnrst") for _ in range(5)) for _ in range(80)]
    say = lambda bad: " ".join([*rng.choices(words, k=rng.randint(1, 60)), *bad]) + ". " + " ".join(rng.choices(words, k=9))
    tagger = toxicity.SpanTagger().fit([say(["vilezz"]) for _ in range(150)], [say([]) for _ in range(150)])
    for text in [say(["vilezz", "viler"]) for _ in range(50)] + [say([]) for _ in range(50)]:
        every = []
        for s in toxicity.sentences(text):
            emit = [float(tagger.weight[0] + tagger.weight[list(tagger._active(m[0]))].sum()) for m in s]
            every += [(m.start(), m.end(), p) for m, p in zip(s, toxicity.chain_marginals(emit, tagger.trans), strict=True) if p > toxicity.FLOOR]
        assert [x[:2] for x in tagger.tag(text)] == [x[:2] for x in every]


def test_toxicity_of_awkward_tables(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)] + [(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    tagger = toxicity.tagger_of(docs, labels)
    got = toxicity.score_toxicity(docs, tagger).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(next(x[1] or "" for x in rows() if x[0] == r["doc_id"]), set()).add(r["score"])
    assert all(len(x) == 1 for x in by_text.values())
    assert toxicity.score_toxicity(none, toxicity.tagger_of(none, labels)).count() == 0
    assert toxicity.drop_toxic(docs, tagger).columns == docs.columns
