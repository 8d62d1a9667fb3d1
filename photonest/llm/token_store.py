"""Content-addressed store of token ids.

Writing: texts are tokenised, an end id closes each document, and a rolling hash over the last
``WINDOW`` ids cuts the stream where the content says so (chunks of ``SHORTEST`` to ``LONGEST`` ids).
Chunks are named by a digest of their bytes and stored once; a document's recipe lists the names of
its chunks, with the Merkle root over them. One exchange carries both: chunk rows are dealt by name
(each task hands on a chunk once, so a chunk that many documents share stays a row a task), recipe
rows by a digest of the id. Recipes are then written in ascending doc_id order, with running starts.

Layout, all Parquet: ``chunks/kind=chunk`` (key, n, payload: little-endian ids of ``width`` bytes),
``recipes`` (doc_id, n_tokens, local_start, hashes, root), ``manifest`` (one row a recipe file: ids,
documents, first doc_id and place, Merkle root over the document roots).

Reading verifies: each recipe file's documents, ids and root against the manifest, each document's chunk list
against its root, each chunk's bytes against its name; a chunk, document or file that is missing is an error. Checksums of documents are put together from those of their
chunks, so the bytes of a chunk are read once however many documents share it.

A null or empty text is the end id alone. Repeated rows are documents of their own; a null doc_id
comes first. An empty table makes an empty store.
"""

from __future__ import annotations

import gc
import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from photonest.llm.bpe import tokenizer_file
from photonest.llm.common import map_texts, table
from photonest.llm.pieces import WordCache
from photonest.session import new_path, shuffle_partitions

WINDOW, SHORTEST, MEAN, LONGEST = 16, 64, 256, 1024
END_ID = 2


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over ``leaves``; an odd one moves up as it is."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        pairs = [digest(leaves[i] + leaves[i + 1]) for i in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[len(leaves) & ~1 :]
    return leaves[0]


def cut_points(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document, as positions in ``ids``; ``ends`` are the documents' ends."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled, span = mixed, 1
    while span < WINDOW:  # sums over 2, 4, ... ids, the older half turned so that order counts
        older = rolled[:-span] * np.uint64(0xD6E8FEB86659FD93)
        rolled[span:] += older ^ (older >> np.uint64(32))
        span *= 2
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    places = (np.flatnonzero((rolled >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1).tolist()
    out, i, start = [], 0, 0
    for end in ends.tolist():
        cuts = []
        while i < len(places) and places[i] < end:
            at = places[i]
            i += 1
            if at - start < SHORTEST:  # the window lies within the document then
                continue
            while at - start > LONGEST:
                start += LONGEST
                cuts.append(start)
            if at - start >= SHORTEST:
                cuts.append(at)
                start = at
        while end - start > LONGEST:
            start += LONGEST
            cuts.append(start)
        if end > start:
            cuts.append(end)
        out.append(cuts)
        start = end
    return out


def byte_letters() -> dict[int, str]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tuple[Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], int]:
    """One per worker: ids of texts as the tokenizers library gives them, and the bytes an id takes.

    The pieces of distinct words go through the library's BPE model; texts that hold an added token go through the
    library whole.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    gc.set_threshold(100_000, 50, 50)  # a slice makes millions of small lists and no cycles
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    tokenize, letters = library.model.tokenize, byte_letters()
    space = letters[32]
    pieces = regex.compile(pattern).findall

    def ids_of(piece: str) -> list[int]:
        if piece.isascii() and piece[1:].isalnum() and piece[0] == " ":
            return [t.id for t in tokenize(space + piece[1:])]
        return [t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))]

    tails: dict[str, list[int]] = {}  # runs of these marks are one piece each

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known: dict[str, list[int]] = {}
        found = []
        for w in words:
            core = w.rstrip(".,!")
            if core[1:].isalpha() and (core[0] == " " or core[0].isalpha()):
                tail = w[len(core) :]
                if not tail:
                    found.append(ids_of(w))
                    continue
                if core not in known:
                    known[core] = ids_of(core)
                if tail not in tails and len(tails) < 1000:
                    tails[tail] = ids_of(tail)
                found.append(known[core] + (tails.get(tail) or ids_of(tail)))
                continue
            ids: list[int] = []
            for p in pieces(w):
                if p not in known:
                    known[p] = ids_of(p)
                ids += known[p]
            found.append(ids)
        flat = np.fromiter(chain.from_iterable(found), dtype=np.uint32)
        return flat, np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def whole(text: str) -> np.ndarray:
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    cache = WordCache(pattern, encode)

    def encode_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = np.zeros(len(texts), dtype=bool)
        for token in added:
            marked |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return cache.encode_texts(texts)
        ids, counts = cache.encode_texts(pc.if_else(pa.array(marked), pa.scalar("", texts.type), texts))
        at = np.flatnonzero(marked)
        own = [whole(texts[i].as_py()) for i in at.tolist()]
        ids = np.insert(ids, np.repeat(np.cumsum(counts)[at], list(map(len, own))), np.concatenate(own))
        counts[at] = list(map(len, own))
        return ids, counts

    return encode_texts, 2 if library.get_vocab_size() <= 1 << 16 else 4


_ROW = StructType(
    [
        StructField("kind", StringType()),
        StructField("key", BinaryType()),
        StructField("doc_id", LongType()),
        StructField("n", LongType()),
        StructField("width", IntegerType()),
        StructField("payload", BinaryType()),
        StructField("hashes", ArrayType(BinaryType())),
    ]
)


def _chunked(path: str, pattern: str, end_id: int):
    seen: set[bytes] = set()  # of one task: the closure is unpickled for each

    def kernel(batch: pa.RecordBatch) -> dict:
        encode_texts, width = _encoder(path, pattern)
        ids, counts = encode_texts(batch.column("text"))
        ends = np.cumsum(counts)
        ids = np.insert(ids, ends, end_id)
        ends = ends + np.arange(1, len(counts) + 1)
        raw = ids.astype("<u2" if width == 2 else "<u4").tobytes()
        out: dict = {f.name: [] for f in _ROW}
        start = 0
        for doc_id, cuts in zip(batch.column("doc_id").to_pylist(), cut_points(ids, ends), strict=True):
            names, first = [], start
            for cut in cuts:
                payload = raw[start * width : cut * width]
                key = digest(payload)
                names.append(key)
                if key not in seen:
                    seen.add(key)
                    for k, v in zip(out, ("chunk", key, None, cut - start, width, payload, None), strict=True):
                        out[k].append(v)
                start = cut
            row = ("recipe", digest(str(doc_id).encode()), doc_id, start - first, None, None, names)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out

    return kernel


_RECIPE = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_tokens", LongType()),
        StructField("local_start", LongType()),
        StructField("hashes", ArrayType(BinaryType())),
        StructField("root", BinaryType()),
    ]
)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    start = 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        hashes = batch.column("hashes")
        starts = start + np.cumsum(n) - n
        start += int(n.sum())
        roots = [merkle_root(x) for x in hashes.to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n"), pa.array(starts, pa.int64()), hashes, pa.array(roots, pa.binary())],
            names=_RECIPE.names,
        )


_MANIFEST = StructType(
    [
        StructField("file", StringType()),
        StructField("documents", LongType()),
        StructField("ids", LongType()),
        StructField("root", BinaryType()),
    ]
)


def _manifest(recipes: DataFrame) -> DataFrame:
    """One row a recipe file. Files are read whole by a task each: their rows are dealt by file and sorted by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for file, n, root in zip(batch.column("file").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("root").to_pylist(), strict=True):
                entry = found.setdefault(file, [0, 0, []])
                entry[0] += 1
                entry[1] += n
                entry[2].append(root)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), *(pa.array([x[i] for x in found.values()], pa.int64()) for i in (0, 1)), pa.array([merkle_root(x[2]) for x in found.values()], pa.binary())],
            names=_MANIFEST.names,
        )

    rows = recipes.select(_file(), "local_start", "n_tokens", "root")
    rows = rows.repartition(shuffle_partitions(recipes.sparkSession), "file").sortWithinPartitions("file", "local_start")
    return rows.select("file", "n_tokens", "root").mapInArrow(run, _MANIFEST)


def _file():
    return F.regexp_extract(F.input_file_name(), r"(part-\d+)", 1).alias("file")


def write_store(df: DataFrame, path: str, vocabulary: str, pattern: str, end_id: int = END_ID) -> None:
    """Tokenise ``(doc_id, text)`` rows with the tokenizers file ``vocabulary`` and write the store at ``path``."""
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    rows = map_texts(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _chunked(vocabulary, pattern, end_id), _ROW, limit=8 << 20)
    # Of equal chunks one stays; recipes are told apart by their number.
    row = F.when(F.col("kind") == "recipe", F.monotonically_increasing_id())
    same = Window.partitionBy("key", "kind", "row").orderBy("n")
    rows = rows.withColumn("row", row).repartition(n, "key").withColumn("at", F.row_number().over(same)).where("at = 1").drop("row", "at")
    rows.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/chunks")
    recipes = spark.read.schema(_ROW).parquet(f"{path}/chunks").where("kind = 'recipe'").select("doc_id", "n", "hashes")
    ordered = recipes.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "n")
    ordered.mapInArrow(_placed, _RECIPE).write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifest(spark.read.schema(_RECIPE).parquet(f"{path}/recipes")).coalesce(1).write.parquet(f"{path}/manifest")


_CHUNK_SUM = StructType([StructField("key", BinaryType()), StructField("chunk_n", LongType()), StructField("crc", LongType())])


def _chunk_sums(batch: pa.RecordBatch) -> dict:
    keys, crcs, sizes = batch.column("key").to_pylist(), [], []
    for key, width, payload in zip(keys, batch.column("width").to_pylist(), batch.column("payload").to_pylist(), strict=True):
        if digest(payload) != key:
            raise ValueError(f"chunk {key.hex()} does not match its name")
        ids = np.frombuffer(payload, dtype="<u2" if width == 2 else "<u4")
        crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        sizes.append(len(ids))
    return {"key": batch.column("key"), "chunk_n": sizes, "crc": crcs}


_ZEROS = bytes(4 * LONGEST)
_DOCUMENT = StructType([StructField("doc_id", LongType()), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids_crc32", LongType()), StructField("merkle_root", StringType())])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunks = batch.column("chunks")
        pos, keys, sizes, parts = chunks.flatten().flatten()
        if sizes.null_count:
            lost = keys.filter(sizes.is_null())[0].as_py()
            raise ValueError(f"chunk {lost.hex()} is missing from the store")
        ends = np.cumsum(chunks.value_lengths().to_numpy())
        row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        order = np.lexsort((pos.to_numpy(), row))
        keys = [keys[i] for keys in (keys.to_pylist(),) for i in order.tolist()]
        sizes, parts = sizes.to_numpy()[order].tolist(), parts.to_numpy()[order].tolist()
        crcs, start = [], 0
        for doc_id, n, root, end in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "root")), ends.tolist(), strict=True):
            if sum(sizes[start:end]) != n or merkle_root(keys[start:end]) != root:
                raise ValueError(f"document {doc_id} cannot be put together from its chunks")
            crc = 0
            for size, part in zip(sizes[start:end], parts[start:end], strict=True):  # the checksum of a || b from those of a and b
                gap = _ZEROS[: 4 * size]
                crc = zlib.crc32(gap, crc) ^ _of_zeros(size) ^ part
            crcs.append(crc)
            start = end
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64()), pa.array([r.hex() for r in batch.column("root").to_pylist()], pa.string())],
            names=_DOCUMENT.names,
        )


@lru_cache(maxsize=LONGEST + 1)
def _of_zeros(size: int) -> int:
    return zlib.crc32(_ZEROS[: 4 * size])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, merkle_root)`` from the files of a store, verified.

    A recipe file that is lost, new or altered is noticed here; a chunk that is lost or altered raises an error
    when the rows are computed.
    """
    wrong = check_manifest(spark, path)
    if wrong:
        raise ValueError(f"recipe files do not match the manifest: {', '.join(wrong)}")
    chunks = spark.read.schema(_ROW).parquet(f"{path}/chunks").where("kind = 'chunk'").select("key", "width", "payload")
    sums = map_texts(chunks, _chunk_sums, _CHUNK_SUM, text="payload")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    # One row a file, in the order of the files' numbers, which is that of the documents.
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = manifest.select("file", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("offset"))
    recipes = spark.read.schema(_RECIPE).parquet(f"{path}/recipes").select("*", _file())
    recipes = recipes.join(F.broadcast(offsets), "file").withColumn("start", F.col("offset") + F.col("local_start"))
    parts = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("hashes").alias("pos", "key"))
    # A chunk that is gone leaves nulls, at which _documents stops; an inner join would drop its documents.
    whole = parts.join(sums, "key", "left").groupBy("start", "doc_id", "n_tokens", "root").agg(
        F.collect_list(F.struct("pos", "key", "chunk_n", "crc")).alias("chunks")
    )
    return whole.select(*whole.columns).mapInArrow(_documents, _DOCUMENT)


def check_manifest(spark: SparkSession, path: str) -> list[str]:
    """The recipe files whose documents, ids or root differ from what the manifest tells, or that only one side knows."""
    told = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    found = _manifest(spark.read.schema(_RECIPE).parquet(f"{path}/recipes"))
    both = told.withColumn("side", F.lit(1)).unionByName(found.withColumn("side", F.lit(-1)))
    wrong = both.groupBy(*_MANIFEST.names).agg(F.sum("side").alias("side")).where("side <> 0")
    return sorted({r["file"] or "" for r in wrong.select("file").collect()})


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = tokenizer_file("byte_bpe_50k.json")
    path = new_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, vocabulary, pattern)
    return read_store(spark, path)
