"""Token ids in binary files: each document compressed by itself with one shared dictionary.

A store is a folder. `dictionary/hash=...` holds a zstandard dictionary, trained on id arrays of some documents, under
its SHA-256. `segments/segment=.../first=.../last=.../docs=.../tokens=...` holds a file for each run of documents in
ascending order of their keys; the names tell which keys it spans, how many documents and ids it has.

A segment file: one zstandard frame a document; the keys (int64), whether each is there (a byte), how many ids each
has (int64), and where each frame ends (int64); then the trailer: hash of the dictionary (32 bytes), bytes an id has (2
or 4, little-endian), number of documents and place of the index (8 bytes each), `TOKSEG1` and a line feed. So a short
document is read by the trailer, the index and its own frame alone.

Spark writes the files: a segment is a row whose only column is text of arbitrary bytes, so any file system that Spark
reaches takes it, and a job that fails, or a task that runs twice, leaves no segment behind or twice. Frames are made before the
shuffle, in one pass over the texts, and are dealt by ranges of (key, text hash, row), so that a key which many rows share fills
many segments. A segment starts its numbers of ids at 0; what stands before it is summed from the names.

Edge cases: a null text is '' and holds the end mark alone; null keys come first, equal keys in the order of their texts'
hashes, equal rows are kept each; a text of any length is one frame; an empty table makes a store without segments, which reads as
an empty table; further columns are not read. Keys are integers.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import shared_dir, slices, small, table, texts
from .library_ids import library_ids

#: Compressed bytes of a segment; the dictionary's bytes; documents it is trained on, in parts of so many ids, so many bytes at most.
SEGMENT_BYTES, DICTIONARY_BYTES = 16 * 2**20, 112_640
TRAIN_DOCS, TRAIN_PART, TRAIN_BYTES = 2_000, 2_048, 8 * 2**20
LEVEL = 3
#: Segments whose numbers of ids are summed in one task.
FAN = 100_000
_TRAILER = struct.Struct("<32sBQQ8s")
_MAGIC = b"TOKSEG1\n"


def _arrays(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """Batches with the serialized ids of every text and their numbers."""
    lib = library_ids(tokenizer)
    kind = "<u2" if max(lib.size, end_id + 1) <= 2**16 else "<u4"
    for b in slices(batches):
        ids, counts = lib.encode(texts(b))
        whole = np.insert(ids, np.cumsum(counts), end_id).astype(kind)
        ends = np.r_[0, np.cumsum(counts + 1)].tolist()
        yield b, [whole[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)], counts + 1


def train_dictionary(df: DataFrame, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> bytes:
    """A dictionary from the ids of about TRAIN_DOCS documents, those whose keys hash lowest; b'' where they are too few to train on.

    Keys that many rows share are cut off at TRAIN_DOCS rows, long documents into parts; the driver gets TRAIN_BYTES at most.
    """
    mark = F.xxhash64(F.col(key))
    last = df.select(mark.alias("h")).orderBy("h").limit(TRAIN_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, arrays, _ in _arrays(batches, tokenizer, end_id):
            parts = [a[i : i + 2 * TRAIN_PART] for a in arrays for i in range(0, len(a), 2 * TRAIN_PART)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["part"])

    drawn = df.filter(mark <= last).select(F.col(text).alias("text")).limit(TRAIN_DOCS).mapInArrow(run, "part binary")
    parts = [bytes(r[0]) for r in drawn.orderBy(F.xxhash64("part")).limit(TRAIN_BYTES // (2 * TRAIN_PART)).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes() if len(parts) >= 8 else b""
    except zstandard.ZstdError:  # too little, or all the same
        return b""


def _shared(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def compress_documents(df: DataFrame, tokenizer: str, dictionary: bytes, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tie, n_tokens, frame) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_shared(dictionary), write_dict_id=False)
        for b, arrays, counts in _arrays(batches, tokenizer, end_id):
            frames = pa.array([packer.compress(a) for a in arrays], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("tie"), pa.array(counts), frames], names=["key", "tie", "n_tokens", "frame"])

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key bigint, tie bigint, n_tokens bigint, frame binary")


def pack_segment(keys: list[int | None], counts: list[int], frames: list[bytes], digest: bytes, width: int) -> bytes:
    """A segment file without its last line feed."""
    n, body = len(keys), b"".join(frames)
    index = [np.array([k or 0 for k in keys], "<i8"), np.array([k is not None for k in keys], np.uint8), np.array(counts, "<i8"), np.cumsum([len(f) for f in frames]).astype("<i8")]
    return b"".join([body, *(x.tobytes() for x in index), _TRAILER.pack(digest, width, n, len(body), _MAGIC)])[:-1]


def open_segment(blob: bytes) -> tuple[str, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the dictionary, bytes an id has, keys, which are there, numbers of ids, and ends of the frames."""
    digest, width, n, at, magic = _TRAILER.unpack_from(blob, len(blob) - _TRAILER.size)
    if magic != _MAGIC:
        raise ValueError("not a segment file")
    keys = np.frombuffer(blob, "<i8", n, at)
    there = np.frombuffer(blob, np.uint8, n, at + 8 * n).astype(bool)
    counts = np.frombuffer(blob, "<i8", n, at + 9 * n)
    return digest.hex(), width, keys, there, counts, np.frombuffer(blob, "<i8", n, at + 17 * n)


def _segments(width: int, digest: bytes, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            nonlocal number, size
            keys, counts, frames = map(list, zip(*held, strict=True))
            blob = pack_segment(keys, counts, frames, digest, width)
            cols = [[number], [keys[0]], [keys[-1]], [len(keys)], [sum(counts)]]
            number, size = number + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([blob], pa.binary())], names=["segment", "first", "last", "docs", "tokens", "blob"])

        for b in batches:
            for k, n, frame in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and size + len(frame) > most:
                    yield row()
                held.append((k, n, frame))
                size += len(frame)
        if held:
            yield row()

    return run


def _bytes_as_text(blob: str):
    """A binary column as a string column of the same bytes, which the text sink writes as they are."""
    return F.col(blob).cast("string").alias("value")


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes the ids of every row, each document's followed by `end_id`, as a new store at `path`."""
    spark = df.sparkSession
    dictionary = train_dictionary(df, tokenizer, end_id, key, text)
    digest = hashlib.sha256(dictionary)
    width = 2 if max(library_ids(tokenizer).size, end_id + 1) <= 2**16 else 4
    named = spark.createDataFrame([(digest.hexdigest(), bytearray(dictionary))], "hash string, blob binary")
    named.select("hash", _bytes_as_text("blob")).coalesce(1).write.partitionBy("hash").text(f"{path}/dictionary")

    frames = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    compress_documents(df, tokenizer, dictionary, end_id, key, text).withColumn("row", F.monotonically_increasing_id()).write.parquet(frames)
    made = spark.read.parquet(frames)
    total = made.agg(F.sum(F.length("frame"))).first()[0] or 0
    order = [F.col("key").asc_nulls_first(), F.col("tie"), F.col("row")]
    dealt = made.repartitionByRange(total // segment_bytes + 1, *order).sortWithinPartitions(*order).select("key", "n_tokens", "frame")
    blobs = dealt.mapInArrow(_segments(width, digest.digest(), segment_bytes), "segment bigint, first bigint, last bigint, docs bigint, tokens bigint, blob binary")
    names = ["segment", "first", "last", "docs", "tokens"]
    blobs.select(*names, _bytes_as_text("blob")).write.partitionBy(*names).text(f"{path}/segments")
    _remove(spark, frames)


def _remove(spark: SparkSession, path: str) -> None:
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, segment, first, last, docs, tokens, before) of every segment, from names alone; `before`: ids of all earlier segments."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/segments").select(F.col("path").alias("file"))
    part = lambda name: F.expr(f"try_cast(regexp_extract(file, '/{name}=([^/]*)/', 1) AS bigint)").alias(name)
    listed = files.select("file", *map(part, ("segment", "first", "last", "docs", "tokens")))
    numbered = listed.withColumn("_rank", F.floor(F.col("segment") / F.lit(2**24)))
    # one partition of the writer is a group of segments; groups are summed in blocks of FAN
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    sums = numbered.groupBy("_rank").agg(F.sum("tokens").alias("_sum")).withColumn("_block", F.floor(F.col("_rank") / FAN))
    blocks = sums.groupBy("_block").agg(F.sum("_sum").alias("_all")).select("_block", F.coalesce(F.sum("_all").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), none).alias("_ahead"))
    groups = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier("_block").orderBy("_rank")), none)).join(blocks, "_block").select("_rank", (F.col("_before") + F.col("_ahead")).alias("_before"))
    within = numbered.withColumn("_within", F.coalesce(F.sum("tokens").over(earlier("_rank").orderBy("segment")), none))
    return within.join(groups, "_rank").select("file", "segment", "first", "last", "docs", "tokens", (F.col("_before") + F.col("_within")).alias("before"))


def dictionaries(spark: SparkSession, path: str) -> dict[str, bytes]:
    """The dictionaries of a store by their hashes, each checked against its hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/dictionary").select("content").collect()  # one, of DICTIONARY_BYTES
    found = {hashlib.sha256(d).hexdigest(): d for d in (bytes(r[0])[:-1] for r in files)}
    return found


def _reader(known: dict[str, bytes], wanted: frozenset | None, as_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        openers = {h: zstandard.ZstdDecompressor(dict_data=_shared(d)) for h, d in known.items()}
        for b in batches:
            for file, blob in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                blob = blob.as_buffer()
                view = memoryview(blob)
                digest, width, keys, there, counts, ends = open_segment(view)
                if digest not in openers:
                    raise ValueError(f"{file} was written with another dictionary than its store has")
                starts = np.cumsum(counts) - counts
                picked = range(len(keys)) if wanted is None else [i for i in range(len(keys)) if (int(keys[i]) if there[i] else None) in wanted]
                part: list[tuple[int, bytes]] = []
                size = 0
                for i in picked:
                    raw = openers[digest].decompress(view[ends[i - 1] if i else 0 : ends[i]], max_output_size=int(counts[i]) * width)
                    part.append((i, np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
                    size += 4 * int(counts[i])
                    if size > 4_000_000 or len(part) >= 1_000:
                        yield _rows(file, keys, there, starts, counts, part, as_bytes)
                        part, size = [], 0
                if part:
                    yield _rows(file, keys, there, starts, counts, part, as_bytes)

    return run


def _rows(file, keys, there, starts, counts, part, as_bytes) -> pa.RecordBatch:
    at = np.array([i for i, _ in part])
    data = [x for _, x in part]
    if as_bytes:
        ids = pa.array(data, pa.binary())
    else:
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts[at])], pa.int32()), pa.array(np.frombuffer(b"".join(data), "<u4").astype(np.int32)))
    cols = [pa.array([file] * len(at)), pa.array(keys[at], mask=~there[at]), pa.array(starts[at]), pa.array(counts[at]), ids]
    return pa.RecordBatch.from_arrays(cols, names=["file", "key", "within", "n_tokens", "ids"])


def read_token_files(spark: SparkSession, path: str, keys: list[int | None] | None = None, as_bytes: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids) of all documents of a store, or of those with the given keys: the files whose keys can match, and of them the matching frames alone.

    `start` counts the ids of all documents before. `as_bytes`: ids as little-endian unsigned 32-bit integers in one binary value.
    """
    names = segments(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/segments")
    if keys is not None:
        given = sorted(k for k in keys if k is not None)
        fits = F.lit(False)
        for k in given:
            fits = fits | (F.coalesce("first", F.lit(-(2**63))) <= k) & (F.col("last") >= k)
        if None in keys:
            fits = fits | F.col("first").isNull()
        hit = [r[0] for r in names.filter(fits).select("file").distinct().collect()]  # a few files a key, of names alone
        files = spark.read.format("binaryFile").load(hit) if hit else files.limit(0)
    kind = "binary" if as_bytes else "array<int>"
    found = files.select(F.col("path").alias("file"), "content").mapInArrow(_reader(dictionaries(spark, path), None if keys is None else frozenset(keys), as_bytes), f"file string, key bigint, within bigint, n_tokens bigint, ids {kind}")
    return found.join(small(names.select("file", "before")), "file").select("key", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids")


#: Parameters of the registered query.
BYTE_BPE, END_ID = "byte_bpe_50k.json", 0


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary(BYTE_BPE), END_ID)
    back = read_token_files(spark, path, as_bytes=True)
    return back.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op11_token_files": op11_token_files}
ORACLE: dict[str, str] = {}
