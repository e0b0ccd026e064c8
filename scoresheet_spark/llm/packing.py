"""Best-two-fit packing of documents into sequences of bounded length.

A sequence is filled greedily with the longest documents that fit. Then its smallest document is replaced
by the two unpacked documents that fit the gap, expanded by that document, more tightly; this repeats
until the gap is closed or no pair fits better.

Only the histogram of lengths decides a plan, and lengths are at most `max_tokens`. So the driver gets that
many counts whatever the corpus holds, plans whole runs of equal sequences at once, and every piece finds
its place from its rank among the pieces of its length. Ranks come from row numbers within salted groups of
bounded size plus group offsets, so that a length that a third of all pieces have isn't ranked in one task.

Edge cases: a null text is '' and packs as the end mark alone; only documents longer than `max_tokens` are
cut; repeated rows are packed each; rows with a null key are packed too; an empty table gives no rows;
further columns are not read. Plan and places are the same whatever the partitioning.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import codec, vocabulary
from .common import cut, slices, table, texts

#: Pieces of one length that are ranked in one group.
RANK_GROUP = 200_000


def tokenize_pieces(df: DataFrame, path: str, max_tokens: int, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every piece: ids of the text, then `end_id`, cut where longer than `max_tokens`."""
    rows = df.select(F.col(key), F.col(text).alias("text"))
    schema = f"piece int, start bigint, length bigint, ids_crc32 bigint{', ids array<int>' * with_ids}"
    schema = StructType([rows.schema[0], *StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in slices(batches):
            ids, counts = bpe.encode(texts(b))
            ends = np.cumsum(counts)
            whole = np.insert(ids, ends, end_id).astype("<u4")
            sizes = counts + 1
            n = -(-sizes // max_tokens)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * max_tokens
            length = np.minimum(sizes[row] - start, max_tokens)
            at = (np.cumsum(sizes) - sizes)[row] + start
            data = memoryview(whole.tobytes())
            crc = [zlib.crc32(data[4 * i : 4 * (i + m)]) for i, m in zip(at.tolist(), length.tolist(), strict=True)]
            cols = [b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(whole.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each, using every length as often as `counts` says."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left[length] += n
    plan = []
    while True:
        there = np.flatnonzero(left)
        if not there.size:
            return plan
        taken: Counter = Counter()
        gap = capacity
        while gap:
            i = int(np.searchsorted(there, gap, "right")) - 1
            while i >= 0 and left[there[i]] <= taken[int(there[i])]:
                i -= 1
            if i < 0:
                break
            length = int(there[i])
            n = min(gap // length, int(left[length]) - taken[length])
            taken[length] += n
            gap -= n * length
        while gap:
            small = min(taken)
            room, free = gap + small, left.copy()
            for length, n in taken.items():
                free[length] -= n
            open_ = np.flatnonzero(free)
            if not open_.size:
                break
            j = np.searchsorted(open_, room - open_, "right") - 1
            j = np.where((j >= 0) & (open_[j] == open_) & (free[open_] < 2), j - 1, j)
            sums = np.where(j >= 0, open_ + open_[j], 0)
            best = int(np.argmax(sums))
            if sums[best] <= small:
                break
            taken[small] -= 1
            taken += Counter()
            for length in (int(open_[best]), int(open_[j[best]])):
                taken[length] += 1
            gap = room - int(sums[best])
        times = min(int(left[length]) // n for length, n in taken.items())
        for length, n in taken.items():
            left[length] -= times * n
        plan.append((tuple(sorted(taken.elements(), reverse=True)), times))


def _ranges(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of its ranges, the sequence of each first rank, and the place in it."""
    used: Counter = Counter()
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, times in plan:
        at = 0
        for length in lengths:
            out.setdefault(length, []).append((used[length], sequence, at))
            used[length] += times
            at += length
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in out.items()}


def pack(pieces: DataFrame, max_tokens: int, order: tuple[str, ...] = ("doc_id", "piece"), length: str = "length") -> DataFrame:
    """The rows of `pieces` with sequence_id and offset. `pieces` must be cheap to read again (a checkpoint or table)."""
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy(length).count().collect()}  # max_tokens rows at most
    places = _ranges(best_two_fit(counts, max_tokens))
    salts = spark.createDataFrame([(k, -(-n // RANK_GROUP)) for k, n in counts.items()] or [(0, 1)], "_length bigint, _salts bigint")
    salted = pieces.join(F.broadcast(salts), F.col(length) == F.col("_length")).withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_salts"))).drop("_salts")
    sizes = salted.groupBy("_length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rest = [c for c in pieces.columns if c not in order and c != length and not pieces.schema[c].dataType.typeName() == "array"]
    within = Window.partitionBy("_length", "_salt").orderBy(*order, *rest)
    ranked = salted.withColumn("_rank", F.row_number().over(within)).join(first, ["_length", "_salt"])
    rows = ranked.select(*pieces.columns, (F.col("_first") + F.col("_rank") - 1).alias("_rank"))
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    shipped = spark.sparkContext.broadcast(places)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = shipped.value
        for b in batches:
            lengths, ranks = b.column(length).to_numpy(), b.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for k in np.unique(lengths).tolist():
                mine = lengths == k
                firsts, sequences, at = by_length[k]
                i = np.searchsorted(firsts, ranks[mine], "right") - 1
                sequence[mine], offset[mine] = sequences[i] + ranks[mine] - firsts[i], at[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return rows.mapInArrow(put, schema)


def pack_documents(df: DataFrame, path: str, max_tokens: int, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack(cut(tokenize_pieces(df, path, max_tokens, end_id)), max_tokens)


#: Parameters of the registered query.
WORD_BPE, SEQUENCE_TOKENS, END_ID = "word_bpe_49k.json", 2048, 0


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), SEQUENCE_TOKENS, END_ID)


QUERIES = {"op2_packing": op2_packing}
ORACLE: dict[str, str] = {}
