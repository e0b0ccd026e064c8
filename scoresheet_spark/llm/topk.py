"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers. Rows are dealt into blocks; a block keeps, for every attribute and bit,
one bitmap over its rows. A query's score is the sum of attribute slices shifted by the bits of its own
components (complemented for negative ones), added with carry-save bitmap arithmetic. The top rows are
then selected from the most significant score slice downward: rows that must be in, rows still tied.
Boundary rows, the tied ones at the end, are resolved exactly by score and row id.

The query set meets all row blocks, block by block, by design; each pair of blocks is one bounded piece of
work, and k rows of each leave it. Every row is indexed; the result is exact, so its recall is 1.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows without
an id; a shorter vector counts as padded with zeros; rows sharing an id are queries and candidates each, and a
query meets all rows but its own one; ties go to the smaller id; fewer than k candidates all appear; an empty
table gives no rows; further columns are not read. Sums have as many slices as they need and are exact at any
size; a component of 2**62 or more after quantisation, or a score among the best that a long can't hold, is an
error and never another number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Rows of an index block, queries of a query block: a block pair is one unit of work.
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 128
#: Selection stops early once so few rows are left that their exact scores settle the order.
FEW = 24

INDEX = "ids binary, dims int, bits int, low bigint, slices binary"
RESULT = "query bigint, query_id bigint, vec_id bigint, score bigint, own boolean"
#: Greatest component and greatest score.
MOST, MOST_SCORE = 2**62, 2**63 - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    large = F.raise_error(F.lit(f"a quantised component is {MOST} or more")).cast("bigint")
    return F.transform(vector, lambda x: F.when(F.abs(scale * x.cast("double")) < float(MOST), F.floor(scale * x.cast("double"))).otherwise(large))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Integer vectors as rows, padded with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def product(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, in integers without a bound where 64 bits might not hold them."""
    most = [int(np.abs(x).max(initial=0)) for x in (rows, query)]
    if most[0] * most[1] * max(1, len(query)) <= MOST_SCORE:
        return rows @ query
    return (rows.astype(object) * query.astype(object)).sum(axis=1)


class Index:
    """The bitmaps of one block, and sums and selections over them."""

    def __init__(self, ids: np.ndarray, dims: int, bits: int, low: int, slices: np.ndarray) -> None:
        self.ids, self.dims, self.bits, self.low = ids, dims, bits, low
        self.words = -(-len(ids) // 64)
        plain = slices.reshape(dims * bits, self.words)
        self.both = np.vstack([plain, ~plain])  # attribute slices, then their complements
        self.valid = np.packbits(np.arange(self.words * 64) < len(ids), bitorder="little").view(np.uint64)

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray) -> tuple[bytes, int, int, int, bytes]:
        order = np.argsort(ids, kind="stable")
        low = int(vectors.min(initial=0))
        above = vectors[order] - low
        bits = max(1, int(above.max(initial=0)).bit_length())
        rows = np.zeros((above.shape[1], bits, -(-len(ids) // 64) * 64), bool)
        for b in range(bits):
            rows[:, b, : len(ids)] = (above >> b & 1).T
        return ids[order].astype("<i8").tobytes(), above.shape[1], bits, low, np.packbits(rows, axis=2, bitorder="little").tobytes()

    @classmethod
    def load(cls, ids: bytes, dims: int, bits: int, low: int, slices: bytes) -> Index:
        return cls(np.frombuffer(ids, "<i8"), dims, bits, low, np.frombuffer(slices, "<u8"))

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Score slices, least significant first, up to a constant that is the same for all rows."""
        size, dims = np.abs(query[: self.dims]), np.arange(min(self.dims, len(query)))
        side = np.where(query[: self.dims] < 0, self.dims * self.bits, 0)
        levels: list[list[np.ndarray]] = [[] for _ in range(self.bits + int(size.max(initial=0)).bit_length())]
        for j in range(int(size.max(initial=0)).bit_length()):
            on = dims[(size >> j & 1).astype(bool)]
            for b in range(self.bits):
                levels[j + b].append(on * self.bits + b + side[on])
        out: list[np.ndarray] = []
        carries: list[np.ndarray] = []
        while len(out) < len(levels) or carries:
            level = levels[len(out)] if len(out) < len(levels) else []
            stack = np.concatenate([self.both[np.concatenate(level)] if level else np.zeros((0, self.words), np.uint64), *carries])
            carries = []
            while len(stack) > 1:
                if (n := len(stack) // 3) == 0:
                    carries.append(stack[:1] & stack[1:])
                    stack = stack[:1] ^ stack[1:]
                    continue
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                x = a ^ b
                carry = a & b
                carry |= x & c
                x ^= c
                carries.append(carry)
                stack = np.concatenate([x, stack[3 * n :]]) if len(stack) > 3 * n else x
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
        return out

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def values(self, rows: np.ndarray) -> np.ndarray:
        """The vectors of a few rows, read from the slices."""
        bit = self.both[: self.dims * self.bits][:, rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)
        return (bit.astype(np.int64).reshape(self.dims, self.bits, -1) << np.arange(self.bits)[None, :, None]).sum(axis=1).T + self.low

    def top(self, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (vec_id, score) of the block."""
        tied = self.valid.copy()
        sure = np.zeros_like(tied)
        n_sure, n_tied = 0, int(np.bitwise_count(tied).sum())
        if n_tied > FEW:
            for level in reversed(self.scores(query)):
                high = tied & level
                n_high = int(np.bitwise_count(high).sum())
                if n_sure + n_high >= k:
                    tied, n_tied = high, n_high
                else:
                    sure |= high
                    tied = tied & ~level
                    n_sure, n_tied = n_sure + n_high, n_tied - n_high
                if n_sure + n_tied <= FEW:
                    break
            else:  # tied rows have equal scores; ids ascend with the row
                tied_rows = self.rows(tied)[: max(0, k - n_sure)]
                tied = np.zeros_like(tied)
                np.bitwise_or.at(tied, tied_rows // 64, np.uint64(1) << (tied_rows % 64).astype(np.uint64))
        rows = self.rows(sure | tied)
        width = min(self.dims, len(query))
        exact = product(self.values(rows)[:, :width], query[:width])
        best = sorted(zip((-exact).tolist(), self.ids[rows].tolist(), strict=True))[:k]
        return [(i, -s) for s, i in best]


def build_index(vectors: DataFrame) -> DataFrame:
    """Index blocks of (vec_id, v): every row is in one."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            made = Index.build(rows.column("vec_id").to_numpy(), _matrix(rows.column("v").combine_chunks()))
            return pa.RecordBatch.from_pydict({n: [x] for n, x in zip(("ids", "dims", "bits", "low", "slices"), made, strict=True)}, schema=pa.schema([("ids", pa.binary()), ("dims", pa.int32()), ("bits", pa.int32()), ("low", pa.int64()), ("slices", pa.binary())]))

        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= BLOCK_ROWS:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, BLOCK_ROWS))
                held = rows.slice(BLOCK_ROWS).to_batches()
        if sum(x.num_rows for x in held):
            yield block(pa.Table.from_batches(held))

    return vectors.mapInArrow(build, INDEX)


def query_blocks(queries: DataFrame) -> DataFrame:
    """(query_ids, numbers, queries) of up to BLOCK_QUERIES queries a row; each query row has a number of its own."""
    schema = pa.schema([("query_ids", pa.binary()), ("numbers", pa.binary()), ("queries", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, BLOCK_QUERIES):
                part = b.slice(s, BLOCK_QUERIES)
                held = [part.column(n).to_numpy() for n in ("vec_id", "number")] + [_matrix(part.column("v"))]
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in held], schema=schema)

    return queries.select("vec_id", F.monotonically_increasing_id().alias("number"), "v").mapInArrow(build, "query_ids binary, numbers binary, queries binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best rows of `vectors` for each row of `queries`, both (vec_id, v), but for its own: query_id, rank, vec_id, score.

    Blocks give k + 1 rows, as a query's own may be among them: of the rows that have its id and its vector one goes.
    """
    sizes = vectors.agg(F.count(F.lit(1))).first()[0], queries.agg(F.count(F.lit(1))).first()[0]
    dealt = vectors.repartition(max(1, -(-sizes[0] // BLOCK_ROWS)))  # in turn, so that blocks are full
    asked = queries.repartition(max(1, -(-sizes[1] // BLOCK_QUERIES)))
    pairs = cut(build_index(dealt)).crossJoin(cut(query_blocks(asked)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = None, None
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r].as_py() for n in b.schema.names}
                if last != row["ids"]:
                    index, last = Index.load(*(row[n] for n in ("ids", "dims", "bits", "low", "slices"))), row["ids"]
                ids, numbers = (np.frombuffer(row[n], "<i8").tolist() for n in ("query_ids", "numbers"))
                found = []
                for number, q, v in zip(numbers, ids, np.frombuffer(row["queries"], "<i8").reshape(len(ids), -1), strict=True):
                    own = int(product(v[None], v)[0])
                    for i, score in index.top(v, k + 1):
                        mine = i == q and score == own
                        if not mine and not -MOST_SCORE <= score <= MOST_SCORE:
                            raise OverflowError(f"the score of {q} and {i} is {score}, which a long can't hold")
                        found.append((number, q, i, min(score, MOST_SCORE), mine))
                yield pa.RecordBatch.from_arrays([*(pa.array([f[c] for f in found], pa.int64()) for c in range(4)), pa.array([f[4] for f in found], pa.bool_())], names=["query", "query_id", "vec_id", "score", "own"])

    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    best = pairs.mapInArrow(search, RESULT).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    best = best.withColumn("gap", F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("query"))).filter(~F.col("place").eqNullSafe(F.col("gap")))
    rank = F.col("place") - F.when(F.col("gap") < F.col("place"), 1).otherwise(0)
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Every row whose id this divides is a query; results of each.
EVERY, K = 50, 5


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0), K)


QUERIES = {"op9_topk": op9_topk}
ORACLE = {
    "op9_topk": f"""
WITH v AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x : CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z : z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r
  WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= {K}"""
}
