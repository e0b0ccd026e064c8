"""Alignment of two tokenizers' tokens by the bytes they stand for.

Both tokenize the same bytes. In each Arrow partition DuckDB holds the tokens of a slice of documents as intervals of
bytes. An as-of join finds the last A token that each B token overlaps; where that ends at the B token's end, the two end
together. Such ends cut a document into groups, which window sums number. Overlaps in full are a range join from the first A
token that a B token overlaps, which another as-of join finds, to the last.

A partition adds up how often an id of A is linked with an id of B, and hands on partial counts; Spark merges them. Each document
keeps its distinct links with their numbers, so that scores come from a join with the merged counts, without tokenizing again.

Edge cases: a text that is null or empty, or that one of the tokenizers does not give back byte by byte, has no tokens; texts may be
of any length; repeated rows are aligned each, null keys too; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .bpe import byte_chars, vocabulary
from .common import cut, offsets, slices, small, texts
from .common import table as read_table
from .library_ids import PieceIds, library_ids

#: Distinct pairs of ids that a partition holds before it hands its counts on; pairs in a row of partial counts.
MAX_PAIRS, ROW_PAIRS = 200_000, 20_000
#: Distinct pairs up to which the merged counts are broadcast.
SMALL_PAIRS = 1_000_000
LINKS = ("end", "overlap")
#: B tokens that DuckDB has at once: whole documents where they fit, else up to an end that both tokenizers have.
BLOCK_TOKENS = 100_000

_SPANS = """CREATE OR REPLACE TEMP TABLE spans AS
SELECT b.pos, b.doc, b.id, b.s, hi.pos AS hi, hi.id AS hi_id, (hi.e = b.e)::INT AS closed FROM b ASOF JOIN a hi ON b.e - 1 >= hi.s"""
_ENDS = "CREATE OR REPLACE TEMP TABLE links AS SELECT doc, hi_id AS a_id, id AS b_id FROM spans WHERE closed = 1"
_OVERLAPS = "CREATE OR REPLACE TEMP TABLE links AS SELECT s.doc, a.id AS a_id, s.id AS b_id FROM (SELECT b.*, lo.pos AS lo FROM spans b ASOF JOIN a lo ON b.s >= lo.s) s JOIN a ON a.pos >= s.lo AND a.pos <= s.hi"
#: The closed ends up to each token, of B tokens by themselves, of A tokens by the B tokens that they close with. Sums, as
#: DuckDB counts a filtered window frame by frame.
_GROUPS_B = "SELECT pos, closed, sum(closed) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM spans"
_GROUPS_A = """SELECT pos, closed, sum(closed) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g
FROM (SELECT a.pos, CASE WHEN c.hi IS NULL THEN 0 ELSE 1 END AS closed FROM a LEFT JOIN (SELECT hi FROM spans WHERE closed = 1) c ON a.pos = c.hi)"""
_PAIRS = "SELECT doc, a_id, b_id, count(*)::BIGINT AS n FROM links GROUP BY ALL ORDER BY doc, a_id, b_id"
_ADD = "CREATE OR REPLACE TEMP TABLE sums AS SELECT a_id, b_id, sum(n)::BIGINT AS n FROM (FROM sums UNION ALL SELECT a_id, b_id, count(*) FROM links GROUP BY ALL) GROUP BY ALL"


class _Side:
    """A tokenizer's ids and the bytes of each id."""

    def __init__(self, path: str) -> None:
        self.ids = library_ids(path, plain=True)
        lib = self.ids.lib
        self.pieces = isinstance(self.ids, PieceIds)
        if self.pieces:
            self.bytes = self.ids.bytes
        else:
            back = {c: b for b, c in enumerate(byte_chars())}
            vocab = lib.get_vocab()
            self.bytes = [b""] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.text = {sep: [f"{i}{sep}" for i in range(len(self.bytes))] for sep in (",", "|", ";")}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each text, in one array, and how many each has; none of empty texts. Files of pieces add the space themselves."""
        return self.ids.encode(texts if self.pieces else [f" {t}" if t else "" for t in texts])


@lru_cache(maxsize=4)
def _side(path: str) -> _Side:
    made = _Side(path)
    gc.freeze()
    return made


def _tokens(side: _Side, ids: np.ndarray, counts: np.ndarray) -> pa.Table:
    """(pos, doc, id, s, e): tokens of all documents, one after the other, and their bytes as intervals."""
    ends = np.cumsum(side.sizes[ids])
    whole = {"pos": np.arange(len(ids)), "doc": np.repeat(np.arange(len(counts)), counts), "id": ids, "s": ends - side.sizes[ids], "e": ends}
    kind = np.int32 if not len(ends) or ends[-1] < 2**31 else np.int64
    return pa.table({k: x.astype(kind) for k, x in whole.items()})


def _blocks(a_ends: np.ndarray, b_ends: np.ndarray, b_counts: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Runs of A and B tokens over the same bytes: BLOCK_TOKENS of B's and the rest of their group at most, cut at ends of documents where one is near."""
    docs, at, start = np.cumsum(b_counts), 0, 0
    while at < len(b_ends):
        stop = int(docs[max(0, np.searchsorted(docs, at + BLOCK_TOKENS, "right") - 1)])
        i = at + BLOCK_TOKENS
        while stop <= at:  # within a long document: the first end from here on that A has as well
            near = b_ends[i - 1 : i + BLOCK_TOKENS]
            place = np.minimum(np.searchsorted(a_ends, near), len(a_ends) - 1)
            both = np.flatnonzero(a_ends[place] == near)
            stop = i + int(both[0]) if both.size else 0
            i += BLOCK_TOKENS
        a_stop = int(np.searchsorted(a_ends, b_ends[stop - 1], "right"))
        yield slice(start, a_stop), slice(at, stop)
        start, at = a_stop, stop


def _kept(side: _Side, texts: list[str], ids: np.ndarray, counts: np.ndarray, wanted: list[bytes]) -> np.ndarray:
    """Which documents' tokens join to the bytes that they should. Byte-level files without a normalizer lose none, and runs of pieces were compared as they were learned."""
    ends = np.r_[0, np.cumsum(counts)]
    fits = np.diff(np.r_[0, np.cumsum(side.sizes[ids])][ends]) == [len(w) for w in wanted]
    told = side.ids.by_words if not side.pieces else not side.ids.lossy
    for i in np.flatnonzero(fits).tolist():
        if not told or side.pieces and side.ids.whole(texts[i]):
            fits[i] = b"".join(map(side.bytes.__getitem__, ids[ends[i] : ends[i + 1]].tolist())) == wanted[i]
    return fits


def _listed(a: _Side, b: _Side, ta: pa.Table, tb: pa.Table, ga: np.ndarray, gb: np.ndarray, docs: int) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of every document: ids by group, A's before B's."""
    if not len(ga):
        return [""] * docs
    last = lambda g: np.append(g[1:] != g[:-1], True)
    in_a, in_b = np.bincount(ga), np.bincount(gb)
    code = np.empty(len(ga) + len(gb), np.int64)
    # a token stands behind those of its side, A's behind B's of earlier groups, B's behind A's of their own as well
    na, nb = len(a.bytes), len(b.bytes)
    code[np.arange(len(ga)) + (np.cumsum(in_b) - in_b)[ga]] = ta["id"].to_numpy() + last(ga) * na
    code[np.arange(len(gb)) + np.cumsum(in_a)[gb]] = tb["id"].to_numpy() + (2 * na + last(gb) * nb)
    # one list of texts: A's with a comma, A's with a bar, B's with a comma, B's with a semicolon
    words = a.text[","] + a.text["|"] + b.text[","] + b.text[";"]
    sizes = np.bincount(ta["doc"].to_numpy(), minlength=docs) + np.bincount(tb["doc"].to_numpy(), minlength=docs)
    stops = np.r_[0, np.cumsum(sizes)].tolist()
    said = list(map(words.__getitem__, code.tolist()))
    return ["".join(said[s:e])[:-1] for s, e in zip(stops[:-1], stops[1:], strict=True)]


def align_documents(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", link: str = "end") -> DataFrame:
    """(partial, key, n_a, n_b, n_groups, n_links, groups, links): a row for each document, and rows of partial counts.

    `groups` lists the ids of each group, A's, then B's. `links`: array<struct<a, b, n>> of the id pairs that are linked, by tokens
    that end together or by all that overlap (`link`); a pair comes once for each block of a very long document. Where `partial` is true, it holds a partition's sums instead.
    """
    if link not in LINKS:
        raise ValueError(f"link is one of {', '.join(LINKS)}")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counts = StructType.fromDDL("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links array<struct<a:int,b:int,n:bigint>>")
    schema = StructType([StructField("partial", StructType.fromDDL("x boolean")[0].dataType), rows.schema["key"], *counts.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        a, b = _side(path_a), _side(path_b)
        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "preserve_insertion_order": False})
        fresh = "CREATE OR REPLACE TEMP TABLE sums (a_id INT, b_id INT, n BIGINT)"
        con.execute(fresh)
        kind = pa.null()

        def leave() -> Iterator[pa.RecordBatch]:
            sums = con.execute("FROM sums").fetchnumpy()
            con.execute(fresh)
            for i in range(0, len(sums["n"]), ROW_PAIRS):
                part = {k: np.asarray(v[i : i + ROW_PAIRS]) for k, v in sums.items()}
                zero = pa.array([0], pa.int64())
                yield _rows(schema, True, pa.nulls(1, kind), zero, zero, zero, zero, pa.nulls(1, pa.string()), part, np.array([len(part["n"])]))

        for batch in slices(batches):
            kind = batch.column("key").type
            said = texts(batch)
            wanted = [f" {t}".encode() if t else b"" for t in said]
            ids = [side.encode(said) for side in (a, b)]
            fits = np.logical_and.reduce([_kept(side, said, *x, wanted) for side, x in zip((a, b), ids, strict=True)])
            (ia, ca), (ib, cb) = ((i[np.repeat(fits, c)], c * fits) for i, c in ids)
            ta, tb = _tokens(a, ia, ca), _tokens(b, ib, cb)
            ga, gb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
            found, before = [], 0
            for in_a, in_b in _blocks(ta["e"].to_numpy(), tb["e"].to_numpy(), cb):
                for name, tokens, part in (("a", ta, in_a), ("b", tb, in_b)):
                    con.register("tokens", tokens.slice(part.start, part.stop - part.start))
                    con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS FROM tokens")
                con.execute(_SPANS)
                con.execute(_ENDS if link == "end" else _OVERLAPS)
                for query, out in ((_GROUPS_A, ga), (_GROUPS_B, gb)):
                    numbered = con.execute(query).fetchnumpy()
                    out[numbered["pos"]] = numbered["g"].astype(np.int64) - numbered["closed"] + before
                before = int(gb[in_b.stop - 1]) + 1
                found.append(con.execute(_PAIRS).fetchnumpy())
                con.execute(_ADD)
            pairs = {k: np.concatenate([np.asarray(x[k]) for x in found]) if found else np.zeros(0, np.int64) for k in ("doc", "a_id", "b_id", "n")}
            docs = batch.num_rows
            first = np.r_[True, gb[1:] != gb[:-1]] if len(gb) else np.zeros(0, bool)
            n_groups = np.bincount(tb["doc"].to_numpy()[first], minlength=docs)
            n_links = np.bincount(pairs["doc"], weights=pairs["n"], minlength=docs).astype(np.int64)
            groups = pa.array(_listed(a, b, ta, tb, ga, gb, docs), pa.string())
            yield _rows(schema, False, batch.column("key"), pa.array(ca), pa.array(cb), pa.array(n_groups), pa.array(n_links), groups, pairs, np.bincount(pairs["doc"], minlength=docs))
            if con.execute("SELECT count(*) FROM sums").fetchall()[0][0] > MAX_PAIRS:
                yield from leave()
        yield from leave()
        con.close()

    return rows.mapInArrow(run, schema)


def _rows(schema: StructType, partial: bool, keys: pa.Array, n_a, n_b, n_groups, n_links, groups, pairs: dict, sizes: np.ndarray) -> pa.RecordBatch:
    links = pa.StructArray.from_arrays([pa.array(np.asarray(pairs["a_id"]), pa.int32()), pa.array(np.asarray(pairs["b_id"]), pa.int32()), pa.array(np.asarray(pairs["n"]), pa.int64())], names=["a", "b", "n"])
    lists = pa.ListArray.from_arrays(pa.array(offsets(sizes)), links)
    return pa.RecordBatch.from_arrays([pa.array([partial] * len(keys)), keys, n_a, n_b, n_groups, n_links, groups, lists], names=schema.names)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): how many links of all documents each pair of ids has, and whether no other id of A has more with that id of B."""
    partial = aligned.filter("partial").select(F.explode("links").alias("l"))
    pairs = partial.groupBy("l.a", "l.b").agg(F.sum("l.n").alias("n"))
    top = pairs.groupBy("b").agg(F.max("n").alias("_top"))  # a row for each id of B
    return pairs.join(F.broadcast(top), "b").select("a", "b", "n", (F.col("n") == F.col("_top")).alias("best"))


def score_links(documents: DataFrame, counts: DataFrame, row: str = "row") -> DataFrame:
    """(row, n_best, count_sum) of documents that have links: links whose pair is its B id's best, and the sum of all links' counts. `row` is unique."""
    each = documents.select(row, F.explode("links").alias("l")).select(row, "l.a", "l.b", F.col("l.n").alias("times"))
    joined = each.join(small(counts, SMALL_PAIRS), ["a", "b"])
    return joined.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


#: Tokenizers of the registered query.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_documents(read_table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), vocabulary(PIECE_BPE))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    kept = cut(aligned.withColumn("groups_sha256", digest).drop("groups").withColumn("row", F.monotonically_increasing_id()))
    counts = cut(link_counts(kept))
    documents = kept.filter("NOT partial")
    none = F.lit(0).cast("bigint")
    return documents.join(score_links(documents, counts), "row", "left").select(
        F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )


QUERIES = {"op12_alignment": op12_alignment}
ORACLE: dict[str, str] = {}
