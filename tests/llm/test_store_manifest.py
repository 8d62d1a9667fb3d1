"""A store that lost or altered any of its parts is not read; added tokens are the library's."""

import glob
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from photonest.llm import bpe, token_store


@pytest.fixture
def store(spark, tmp_path):
    vocabulary, pattern = bpe.tokenizer_file("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"text number {i} " * (1 + i % 40)) for i in range(80)], "doc_id long, text string")
    token_store.write_store(docs, f"{tmp_path}/s", vocabulary, pattern)
    assert token_store.read_store(spark, f"{tmp_path}/s").count() == 80
    return f"{tmp_path}/s"


def largest(store, part):
    return max(glob.glob(f"{store}/{part}/**/part-*.parquet", recursive=True), key=os.path.getsize)


def rewrite(path, change):
    table = pq.read_table(path, partitioning=None).to_pydict()
    schema = pq.read_schema(path)
    change(table)
    for crc in glob.glob(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")):
        os.remove(crc)
    pq.write_table(pa.table(table, schema=schema), path)


def test_lost_recipe_file_is_noticed(spark, store):
    os.remove(largest(store, "recipes"))
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_store(spark, store).count()


def test_altered_recipe_file_is_noticed(spark, store):
    def change(table):  # a root that fits its own chunk list, but not the manifest
        table["hashes"][0] = table["hashes"][0][::-1] + table["hashes"][0][:1]
        table["root"][0] = token_store.merkle_root(list(table["hashes"][0]))

    rewrite(largest(store, "recipes"), change)
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_store(spark, store).count()


def test_lost_document_is_noticed(spark, store):
    rewrite(largest(store, "recipes"), lambda table: [column.pop() for column in table.values()])
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_store(spark, store).count()


def test_lost_chunk_is_noticed(spark, store):
    os.remove(largest(store, "chunks/kind=chunk"))
    with pytest.raises(Exception, match="missing from the store"):
        token_store.read_store(spark, store).collect()


def test_altered_chunk_is_noticed(spark, store):
    def change(table):
        table["payload"][0] = bytes([table["payload"][0][0] ^ 1]) + table["payload"][0][1:]

    rewrite(largest(store, "chunks/kind=chunk"), change)
    with pytest.raises(Exception, match="does not match its name"):
        token_store.read_store(spark, store).collect()


def test_ids_are_the_library_s():
    from tokenizers import Tokenizer

    vocabulary, pattern = bpe.tokenizer_file("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(vocabulary), random.Random(6)
    encode_texts, _ = token_store._encoder(vocabulary, pattern)
    bits = ["<|endoftext|>", "<|endoftext", " ", "  ", "\n", "\t", "hello", " World", "é", "日本", "123", "'ll", "...", " ", "😀", "x" * 40]
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "", None, "a<|endoftext|><|endoftext|>  b"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    ids, counts = encode_texts(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == library.encode(text or "", add_special_tokens=False).ids, text
        at += n
    assert at == len(ids)
