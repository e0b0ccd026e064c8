"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes may be cut after a line and wherever the gear hash of the last 16 bytes has four leading
zero bits. Of such places within 16 bytes of each other one is taken: ends of lines before others, then the
greatest hash. So cuts depend on the bytes around them alone, an insertion moves no cut beyond its surroundings,
a shared passage has the same chunks in every text, and short lines join into chunks that are long enough to be
evidence: all have 16 bytes, but for the first and last of a text. Chunks are told apart by digest: a chunk is a
repeat if a document with a smaller key has it; with `within`, if the same document has it earlier on, too. What
repeats within one document alone stays otherwise: rules for its quality see to it. Runs of repeats with at
least 25 words are removed: a passage of 50 words keeps that much even where the chunks at its ends also
hold other text, and the lines that unrelated documents commonly share stay.

Each document sends a digest once. Counts are summed on the map side, so a passage that a third of all
documents hold reaches a task once for each partition. First documents of repeated digests are checkpointed, and the
documents that hold a hot digest are dealt to many tasks when they meet its first.
Texts meet their repeats in one shuffle by key, and chunks are cut again there.

Edge cases: a null text has no chunks and stays null; rows with a null key are left as they are and do not
count as earlier documents; rows that share a key are one document; texts of any length are read whole; an
empty table gives no rows; `dedup_substrings` keeps further columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..operators.skew import join_by_key
from .common import U64, mix64, settled, slices, table, texts, values

#: Bytes that the gear hash sees, its leading zero bits at a cut, least bytes of a chunk that is evidence.
WINDOW, ZERO_BITS, LEAST_BYTES = 16, 4, 16
#: Least words of a run of repeats that is removed.
MIN_WORDS = 25

GEAR = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ends of all chunks of texts that lie end to end; a text ends its last chunk. `starts`: where the texts begin."""
    n = raw.size
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n, np.int64)
    first[starts[starts < n]] = starts[starts < n]
    inside = np.arange(n) - np.maximum.accumulate(first)
    h, w = GEAR[raw], 1
    while w < WINDOW:
        shifted = np.zeros_like(h)
        shifted[w:] = h[:-w] << U64(w)
        shifted[inside < w] = 0
        h = h + shifted
        w *= 2
    line = raw == 10
    at = ((h >> U64(64 - ZERO_BITS)) == 0) | line
    at[:-1] &= (raw[1:] & 0xC0) != 0x80  # not within a character
    place = np.flatnonzero(at)
    rank = (mix64(h[place]) >> U64(1)) | (line[place].astype(U64) << U64(63))
    # a text begins at place - inside; of equals the first is taken
    begins, taken = place - inside[place], np.ones(place.size, bool)
    for k in range(1, LEAST_BYTES):
        near = (place[k:] - place[:-k] < LEAST_BYTES) & (begins[k:] == begins[:-k])
        if not near.any():
            break
        later = rank[k:] > rank[:-k]
        taken[:-k] &= ~(near & later)
        taken[k:] &= ~(near & ~later)
    at[place[~taken]] = False
    at[starts[(starts > 0) & (starts <= n)] - 1] = True
    at[-1] = True
    return np.flatnonzero(at) + 1


def chunk(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all chunks of all texts: document, start and end within it, and digest (0 for chunks too short to be evidence)."""
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum(sizes) - sizes
    joined = b"".join(docs)
    ends = cuts(np.frombuffer(joined, np.uint8), starts[sizes > 0])
    begins = np.r_[0, ends[:-1]] if ends.size else ends
    of = np.searchsorted(np.cumsum(sizes), begins, "right")
    digests = np.zeros(ends.size, np.int64)
    long_ = np.flatnonzero(ends - begins >= LEAST_BYTES)
    hash_ = xxhash.xxh3_64_intdigest
    digests[long_] = np.fromiter((hash_(joined[s:e]) for s, e in zip(begins[long_].tolist(), ends[long_].tolist(), strict=True)), U64, long_.size).view(np.int64)
    return of, begins - starts[of], ends - starts[of], digests


def first_in_document(of: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Whether a chunk is its document's first with its digest; true of chunks without one."""
    order = np.lexsort((np.arange(of.size), digests, of))
    first = np.ones(of.size, bool)
    same = (of[order][1:] == of[order][:-1]) & (digests[order][1:] == digests[order][:-1])
    first[order[1:][same]] = False
    return first | (digests == 0)


def chunk_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, key, chunk) of every distinct chunk of every document that is long enough to be evidence."""
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            of, _, _, digests = chunk([t.encode("utf-8", "surrogatepass") for t in texts(b)])
            number = np.arange(of.size) - np.searchsorted(of, of)
            sent = np.flatnonzero(first_in_document(of, digests) & (digests != 0))
            keys = b.column(0).to_numpy()[of[sent]]
            yield pa.RecordBatch.from_arrays([pa.array(digests[sent]), pa.array(keys), pa.array(number[sent].astype(np.int32))], names=["digest", key, "chunk"])

    return rows.mapInArrow(run, f"digest bigint, {key} bigint, chunk int")


def repeat_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, key, chunk, owner): chunks that a document with a smaller key, the owner, holds as well."""
    sent = chunk_digests(docs, key, text)
    owners = sent.groupBy("digest").agg(F.min(key).alias("owner"), F.max(key).alias("last"), F.count(F.lit(1)).alias("_n")).filter("owner < last")
    owners, _ = settled(owners.drop("last"))
    return join_by_key(sent, owners, ["digest"], "_n", F.col(key)).filter(F.col(key) > F.col("owner"))


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, repeats): numbers of the chunks that documents with smaller keys hold."""
    return repeat_chunks(docs, key, text).groupBy(key).agg(F.collect_set("chunk").alias("repeats"))


def repeated_spans(raw: bytes, begins: np.ndarray, ends: np.ndarray, repeat: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of runs of repeats with MIN_WORDS words or more."""
    out, marks = [], np.flatnonzero(repeat)
    if not marks.size:
        return out
    broken = np.r_[0, np.cumsum(~repeat)]  # chunks that break a run, counted up to each place
    new = np.r_[True, broken[marks[1:]] != broken[marks[:-1]]]
    heads = np.flatnonzero(new)
    for i, j in zip(marks[heads].tolist(), marks[np.r_[heads[1:], marks.size] - 1].tolist(), strict=True):
        s, e = int(begins[i]), int(ends[j])
        if len(raw[s:e].split()) >= MIN_WORDS:
            out.append((s, e))
    return out


def _cut_out(docs: DataFrame, key: str, text: str, within: bool = False) -> DataFrame:
    """(row, kept, starts, ends, n_chunks): every row, its text without repeats, and their spans in code points."""
    found = find_repeats(docs, key, text).withColumnRenamed(key, "_key")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = rows.join(found, F.col(f"row.`{key}`").cast("bigint") == F.col("_key"), "left").select("row", "repeats")
    span = ArrayType(LongType())
    schema = StructType([joined.schema["row"], StructField("kept", docs.schema[text].dataType), StructField("starts", span), StructField("ends", span), StructField("n_chunks", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            said = values(b, text).to_pylist()
            keyed = values(b, key).is_valid().to_pylist()
            docs_ = [t.encode("utf-8", "surrogatepass") if t else b"" for t in said]
            of, begins, ends, digests = chunk(docs_)
            bounds = np.searchsorted(of, np.arange(len(docs_) + 1))
            inner = ~first_in_document(of, digests) if within else np.zeros(of.size, bool)
            kept, starts_, ends_ = [], [], []
            for i, (raw, repeats) in enumerate(zip(docs_, b.column("repeats").to_pylist(), strict=True)):
                s, e = int(bounds[i]), int(bounds[i + 1])
                repeat = inner[s:e].copy()
                if repeats:  # and whatever says the same later in the document
                    repeat |= np.isin(digests[s:e], digests[s:e][repeats])
                spans = repeated_spans(raw, begins[s:e], ends[s:e], repeat) if keyed[i] else []
                if not spans:
                    kept.append(said[i])
                    starts_.append([])
                    ends_.append([])
                    continue
                edges = [0, *(x for span_ in spans for x in span_), len(raw)]
                parts = [raw[x:y].decode("utf-8", "surrogatepass") for x, y in zip(edges[:-1], edges[1:], strict=True)]
                at = np.cumsum([len(p) for p in parts])
                kept.append("".join(parts[::2]))
                starts_.append(at[:-1:2].tolist())
                ends_.append(at[1::2].tolist())
            sizes = pa.array(np.diff(bounds).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(kept, pa.string()), pa.array(starts_, pa.list_(pa.int64())), pa.array(ends_, pa.list_(pa.int64())), sizes], names=schema.names)

    return joined.mapInArrow(run, schema)


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", within: bool = False) -> DataFrame:
    """The rows of `docs` with repeated passages removed from `text`; n_chars, where there, follows the text."""
    found = _cut_out(docs, key, text, within)
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text: F.col("kept")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.size("starts") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*(c.alias(n) for n, c in out.items()))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _cut_out(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    spans = F.array_join(F.zip_with("starts", "ends", lambda s, e: F.concat_ws(":", s.cast("string"), e.cast("string"))), ",")
    removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_chunks", F.size("starts").alias("n_spans"), removed.alias("removed_chars"), spans.alias("spans"), F.col("kept").alias("text"))


QUERIES = {"op10_substring": op10_substring}
ORACLE: dict[str, str] = {}
