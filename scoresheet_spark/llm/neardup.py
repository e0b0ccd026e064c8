"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is the weighted set of its five-word shingles (weights: counts). Darts fall on the plane of weight
and rank above each shingle: their number in a strip of ranks, their places and their signature coordinate
follow from hashes of shingle, weight cell and strip alone, so that equal regions get equal darts. A dart
counts where it lies under the shingle's weight; each coordinate keeps its earliest dart. Strips double, so
a document stops as soon as all coordinates have one: long documents need few ranks, short ones many.

Two documents agree in a coordinate with the probability of their weighted Jaccard similarity. Bands of
coordinates make buckets. Texts with the same words form one class before that. In a bucket every member is
compared with a leader, the member that meets most others; similarities are exact, over the shingles.
Buckets that are no single class then hold pairs not yet tested, of members that the leader turned down or took.
All members of these part by the rare shingles that similar texts must share (the prefix of a text's shingles in
order of frequency): leaders again first, then each with each across classes, in blocks of a bounded number of
members, so that no pair is dropped. Links
become classes by contraction of stars in Spark; only counters reach the driver, and each round ends in a
checkpoint.

Edge cases: a document without words is its own class; one with fewer than five words is one shingle of all
of them; repeated rows are copies, and one of them stays; a null key groups under its content as others do, and
is a class's key only where no other is; rows that share a key and no content are documents of their own, each
in its class; keys are integers, or strings of them; an empty table gives no rows; texts are read whole; further
columns, dots in their names included, are not read and kept by `keep_first`. A pair at the threshold of 0.8
shares no band, and goes unseen, with probability (1 - 0.8**5)**25 = 0.00005.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import U64, mix64, offsets, ragged, settled, slices, small, table, texts

#: Words of a shingle, least similarity, bands and their rows.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 25, 5
#: First strip of ranks, for one unit of weight: [0, 2**FIRST); each further strip doubles what is covered, up to WIDEST at once.
FIRST, WIDEST = -6, 16.0
#: Members of a block; two blocks of a bucket are compared each with each at once.
SMALL_BUCKET = 256
#: Darts thrown at once, about.
_GROUP_DARTS = 300_000
#: Text bytes whose shingles a Python worker holds at once.
_SLICE = 500_000
_TINY = 1.0 / 2**53


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((h >> U64(11)).astype(np.float64) + 0.5) * _TINY


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """How many darts fall into an area of `mean`, by inversion."""
    term, k = np.exp(-mean), 0
    total, out = term, np.zeros(u.size, np.int64)
    while (more := u > total).any() and k < 200:
        out[more] += 1
        k += 1
        term *= mean / k
        total += term
    return out


def dart_signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Signatures (a row of `k` unsigned 64-bit numbers for each set) of weighted sets laid end to end.

    `sizes` has how many elements each set has, one at least. Weights are positive numbers.
    """
    n_sets = len(sizes)
    # unit cells of weight: cell c of an element covers the weights from c to c + 1
    cells = np.ceil(weights).astype(np.int64)
    of = np.repeat(np.repeat(np.arange(n_sets), sizes), cells)
    cell = ragged(np.zeros(len(cells), np.int64), cells)
    room = np.minimum(1.0, np.repeat(weights, cells) - cell)
    region = mix64(np.repeat(elements, cells) + cell.astype(U64) * U64(0xD1B54A32D192ED03))
    best_rank = np.full(n_sets * k, np.inf)
    best = np.zeros(n_sets * k, U64)
    strip, high = 0, 0.0
    open_sets = np.ones(n_sets, bool)
    while True:
        low, high = high, min(max(2.0**FIRST, 2 * high), high + WIDEST)
        seed = mix64(region + U64((strip + 1) * 0x9E3779B97F4A7C15 % 2**64))
        n = _poisson(_unit(seed), high - low)
        hit = np.flatnonzero(n)
        times = n[hit]
        which = np.repeat(hit, times)
        dart = mix64(seed[which] + (ragged(np.zeros(len(hit), np.int64), times) + 1).astype(U64) * U64(0xA0761D6478BD642F))
        under = _unit(mix64(dart + U64(1))) < room[which]
        which, dart = which[under], dart[under]
        rank = low + (high - low) * _unit(mix64(dart + U64(2)))
        place = of[which] * k + (mix64(dart + U64(3)) % U64(k)).astype(np.int64)
        # the earliest dart of each coordinate
        order = np.lexsort((rank, place))
        place, rank, dart = place[order], rank[order], dart[order]
        head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if place.size else np.zeros(0, np.int64)
        place, rank, dart = place[head], rank[head], dart[head]
        earlier = rank < best_rank[place]
        best_rank[place[earlier]], best[place[earlier]] = rank[earlier], dart[earlier]
        open_sets &= np.isinf(best_rank).reshape(n_sets, k).any(axis=1)
        if not open_sets.any():
            return best.reshape(n_sets, k)
        left = open_sets[of]
        of, region, room = of[left], region[left], room[left]
        strip += 1


def shingles(docs: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Hashes of all shingles of all texts, how many each has, and the words."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in docs]
    sizes = np.array([len(w) for w in words], np.int64)
    digest = xxhash.xxh3_64_intdigest
    known: dict[bytes, int] = {}
    h = np.fromiter((known[w] if w in known else known.setdefault(w, digest(w)) for doc in words for w in doc), U64, int(sizes.sum()))
    n = np.where(sizes == 0, 0, np.maximum(1, sizes - WORDS + 1))
    starts = ragged(np.cumsum(sizes) - sizes, n)
    width = np.repeat(np.minimum(sizes, WORDS), n)
    out = width.astype(U64)
    padded = np.r_[h, np.zeros(WORDS, U64)]
    for i in range(WORDS):
        out = np.where(i < width, mix64(out * U64(0x9E3779B97F4A7C15) + padded[starts + i]), out)
    return out, n, words


def counted(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts: elements, weights, and how many elements each text has."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    head = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])]) if hashes.size else np.zeros(0, np.int64)
    return hashes[head], np.diff(np.r_[head, hashes.size]).astype(np.float64), np.bincount(of[head], minlength=len(sizes))


def _groups(sizes: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about _GROUP_DARTS darts in all: some 8 for each of a text's `k` coordinates, one a shingle at least."""
    ends, start = np.cumsum(np.maximum(sizes, 8 * k)), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _GROUP_DARTS, "right")))
        yield start, stop
        start = stop


def _contents(words: list[list[bytes]]) -> tuple[pa.Array, pa.Array]:
    """Digests of texts' words as two numbers each, null for no words."""
    digest = [xxhash.xxh3_128_intdigest(b" ".join(w)) if w else None for w in words]
    low = [None if d is None else (d & 0xFFFFFFFFFFFFFFFF) - (1 << 63) for d in digest]
    top = [None if d is None else (d >> 64) - (1 << 63) for d in digest]
    return pa.array(low, pa.int64()), pa.array(top, pa.int64())


def sign(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(`key` struct of the other columns, content, bands) of every row: a digest of its words and a hash of each band.

    Both are null for a text without words.
    """
    carried = [c for c in docs.columns if c != text]
    src = docs.select(*carried, F.col(text).alias("text"))
    schema = StructType([*src.schema.fields[:-1], StructField("content_a", LongType()), StructField("content_b", LongType()), StructField("bands", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=_SLICE):
            hashes, sizes, words = shingles(texts(b))
            elements, weights, n = counted(hashes, sizes)
            at, out = np.r_[0, np.cumsum(n)], np.zeros((len(n), bands), np.int64)
            there = np.flatnonzero(n)
            for s, e in _groups(n[there], bands * rows):
                mine = there[s:e]
                a, z = at[mine[0]], at[mine[-1] + 1]
                signature = dart_signatures(elements[a:z], weights[a:z], n[mine], bands * rows)
                band = np.broadcast_to(np.arange(bands, dtype=U64), (len(mine), bands)).copy()
                for i in range(rows):
                    band = mix64(band * U64(0x9E3779B97F4A7C15) + signature.reshape(len(mine), bands, rows)[:, :, i])
                out[mine] = band.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets(np.where(n > 0, bands, 0))), pa.array(out[n > 0].ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *_contents(words), lists], names=schema.names)

    return src.mapInArrow(run, schema)


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(key, content_a, content_b, elements): the shingles of every text of `rows` (key, text), a shingle's further occurrences as elements of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=_SLICE):
            hashes, sizes, words = shingles(texts(b))
            elements, weights, n = counted(hashes, sizes)
            times = weights.astype(np.int64)
            cell = ragged(np.zeros(len(times), np.int64), times)
            all_ = np.where(cell == 0, np.repeat(elements, times), mix64(np.repeat(elements, times) + cell.astype(U64)))
            yield pa.RecordBatch.from_arrays([b.column(0), *_contents(words), pa.ListArray.from_arrays(pa.array(offsets(sizes)), pa.array(all_.view(np.int64)))], names=["key", "content_a", "content_b", "elements"])

    return rows.select("key", "text").mapInArrow(run, "key bigint, content_a bigint, content_b bigint, elements array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """(node, class): each node of `links` (a, b) with the smallest node of its connected component.

    Alternates the two star contractions (every node's greater neighbours to the least neighbour; every
    node's smaller neighbours to the least one), which take logarithmically many rounds.
    """
    edges, _ = settled(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges, n = settled(small_star)
        # stars are done when each node has one parent and no parent has one
        nodes = edges.select("a").distinct().count()
        if nodes == n and not edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count():
            roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("class"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("class")).unionByName(roots)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similar) of pairs: whether their weighted Jaccard similarity, over `sets` (doc, elements), is at least SIMILARITY."""
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (shared >= SIMILARITY * (F.size("x") + F.size("y") - shared)).alias("similar"))


def _leaders(entries: DataFrame) -> DataFrame:
    """(bucket, leader): of each bucket with two members or more the member that shares most, the least key among equals."""
    best = entries.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("doc")).alias("minus"))).alias("m"), F.count(F.lit(1)).alias("n"))
    return best.filter("n > 1").select("bucket", (-F.col("m.minus")).alias("leader"))


def _ranked(sets: DataFrame) -> DataFrame:
    """(bucket, doc, at, size): the prefix of every text's shingles, those that fewest texts have first, of shingles in two prefixes or more.

    Two texts of sizes m <= n that reach SIMILARITY share m * SIMILARITY shingles at least, and so one of the first
    m - m * SIMILARITY + 1 of each: this parts texts without losing a pair.
    """
    each = sets.select("doc", F.explode("elements").alias("bucket"))
    often = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(often, "bucket").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("often", "bucket"))).alias("all"))
    size = F.size("all")
    prefix = F.slice("all", F.lit(1), size - F.ceil(SIMILARITY * size - 1e-6).cast("int") + 1)
    out = ranked.select("doc", size.alias("size"), F.posexplode(prefix).alias("at", "x")).filter("x.often > 1")
    return out.select("x.bucket", "doc", "at", "size")


def _mixed(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """`entries` with the class of each (`own`) and the number of members (`n`), of buckets that hold more than one class."""
    owned = entries.join(classes.withColumnRenamed("node", "doc"), "doc", "left").withColumn("own", F.coalesce("class", "doc")).drop("class")
    sizes = owned.groupBy("bucket").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count(F.lit(1)).alias("n"))
    return owned.join(sizes.filter("lo < hi").select("bucket", "n"), "bucket")


def _across(entries: DataFrame) -> DataFrame:
    """(a, b): pairs of different classes that may reach SIMILARITY.

    A shared shingle tells nothing where it stands so late in either text that what follows can't reach the overlap
    needed: a pair that reaches it shares an earlier one. So the shorter text of a pair enters with a shorter prefix
    (as for a partner of its own length), and late places make no pair. In large buckets both sides are dealt into
    blocks, so that a task gets a block of each and not all of the bucket.
    """
    needed = lambda m, n: SIMILARITY / (1 + SIMILARITY) * (m + n) - 1e-6
    early = F.col("size") - F.col("at") >= needed(F.col("size"), F.col("size"))
    counts = entries.groupBy("bucket").agg(F.count(F.when(early, 1)).alias("short"), F.count(F.lit(1)).alias("all")).filter("short > 0 AND all > 1")
    blocks = {c: F.ceil(F.col(c) / SMALL_BUCKET).cast("int") for c in ("short", "all")}
    dealt = entries.drop("n").join(counts.select("bucket", *(n.alias(c) for c, n in blocks.items())), "bucket")
    side = lambda c: F.pmod(F.xxhash64("doc"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    short = dealt.filter(early).select("bucket", side("short").alias("i"), every("all").alias("j"), "doc", "own", "at", "size")
    long_ = dealt.select("bucket", every("short").alias("i"), side("all").alias("j"), F.col("doc").alias("d"), F.col("own").alias("o"), F.col("at").alias("t"), F.col("size").alias("s"))
    need = needed(F.col("size"), F.col("s"))
    shorter = (F.col("size") < F.col("s")) | ((F.col("size") == F.col("s")) & (F.col("doc") < F.col("d")))
    pairs = short.join(long_, ["bucket", "i", "j"]).filter(shorter & (F.col("own") != F.col("o")) & (F.col("size") - F.col("at") >= need) & (F.col("s") - F.col("t") >= need))
    shared = pairs.groupBy("doc", "d", "size", "s").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"), F.max("t").alias("t"))
    # with all that lies before, beyond the last shared shingle it can share no more than what is left of the shorter rest
    may = F.col("n") + F.least(F.col("size") - F.col("at"), F.col("s") - F.col("t")) - 1 >= need
    return shared.filter(may).select(F.least("doc", "d").alias("a"), F.greatest("doc", "d").alias("b"))


def _among(rows: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    """`rows` joined with `pairs`, both with key, content_a and content_b: null keys are equal."""
    same = [rows["key"].eqNullSafe(pairs["key"]), rows["content_a"] == pairs["content_a"], rows["content_b"] == pairs["content_b"]]
    return rows.join(pairs, same[0] & same[1] & same[2], how)


def find_links(contents: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, class) of contents that are linked to others, directly or by way of others.

    `contents` has (doc, key, n, content_a, content_b, bands) of each, `rows` (key, text) of which `n` are equal.
    """
    exploded = contents.select("doc", F.posexplode("bands").alias("at", "band")).select(F.xxhash64("at", "band").alias("bucket"), "doc")
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries, _ = settled(exploded.join(shared, "bucket"))
    degrees, _ = settled(entries.groupBy("doc").agg(F.sum(F.col("n") - 1).alias("degree")))
    entries, _ = settled(entries.drop("n").join(degrees, "doc").select("bucket", "doc", "degree"))
    met, _ = settled(contents.drop("bands").join(small(degrees.select("doc")), "doc", "left_semi"))
    # one pass of Python over the texts with these keys; rows that share a key and not the content go after it
    near = small(met.select(F.col("key").alias("_key")))
    sets = _among(shingle_sets(rows.join(near, rows["key"].eqNullSafe(near["_key"]), "left_semi")), small(met), "inner").select("doc", "elements")
    if met.filter("n > 1").limit(1).count():  # rows that are equal, key and all
        sets = sets.groupBy("doc").agg(F.first("elements").alias("elements"))
    sets, _ = settled(sets, 2_000)
    none = contents.sparkSession.createDataFrame([], "a bigint, b bigint")
    classes, turned_down = none.toDF("node", "class"), none

    def join(pairs: DataFrame) -> int:
        """Test pairs that were not tested and let those that are similar join their classes; how many were."""
        nonlocal classes, turned_down
        tested, _ = settled(verified(pairs.join(turned_down, ["a", "b"], "left_anti"), sets))
        turned_down = turned_down.unionByName(tested.filter(~F.col("similar")).select("a", "b"))
        found = tested.filter("similar").select("a", "b")
        n = found.count()
        if n:
            classes, _ = settled(components(found.unionByName(classes.filter("node <> class").toDF("a", "b"))))
        return n

    def with_leaders(entries: DataFrame) -> DataFrame:
        led = entries.join(_leaders(entries), "bucket").filter("doc <> leader")
        if "own" in entries.columns:
            led = led.join(classes.toDF("leader", "led"), "leader", "left").filter("own <> coalesce(led, leader)")
        return led.select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b")).distinct()

    join(with_leaders(entries))
    # those in a bucket that is not one class by now
    left, n = settled(_mixed(entries, classes).select("doc").distinct())
    if not n:
        return classes
    ranked, _ = settled(_ranked(sets.join(small(left), "doc", "left_semi")))
    ranked = ranked.withColumn("degree", -F.col("at"))
    while True:  # families that lie apart in a bucket of bands have rare shingles of their own
        mixed, n = settled(_mixed(ranked, classes))
        if not n:
            return classes
        if not join(with_leaders(mixed)):
            break
    join(_across(mixed))
    return classes


def _written(text: str) -> Column:
    """A digest of a text as it is written: of equal ones the words are equal, too."""
    return F.md5(F.col(f"`{text}`").cast("binary"))


def _classified(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (key, written, content_a, content_b) in a checkpoint, pairs (key, content_a, content_b, n) with how many rows have each, and contents (content_a, content_b, class_id, chosen).

    `chosen` is a struct of the class's first key in that one of its contents that has it, else null.
    """
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    signed, _ = settled(sign(rows.withColumn("written", _written("text"))))
    # bands are a function of the content, so any copy's will do
    pairs = signed.filter(F.col("content_a").isNotNull()).groupBy("content_a", "content_b", "key").agg(F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    ahead = [F.col("key").isNull().alias("last"), "key"]
    firsts = pairs.groupBy("content_a", "content_b").agg(F.min(F.struct(*ahead, "n", "bands")).alias("m"))
    # keys may repeat, so contents are linked by numbers of their own
    contents, _ = settled(firsts.select("content_a", "content_b", "m.key", "m.n", "m.bands", F.monotonically_increasing_id().alias("doc")))
    classes = find_links(contents, rows).toDF("doc", "class")
    owned = contents.drop("bands", "n").join(classes, "doc", "left").withColumn("class", F.coalesce("class", "doc"))
    heads = owned.groupBy("class").agg(F.min(F.struct(*ahead, "doc")).alias("m")).select("class", F.col("m.key").alias("class_id"), F.col("m.doc").alias("head"))
    named = owned.join(heads, "class").select("content_a", "content_b", "class_id", F.when(F.col("doc") == F.col("head"), F.struct("key")).alias("chosen"))
    return signed.drop("bands"), pairs.drop("bands"), named


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id) of every row: the least key of its class of copies and near copies."""
    signed, _, named = _classified(docs, key, text)
    worded = signed.join(named, ["content_a", "content_b"]).select("key", "class_id")
    rest = signed.filter(F.col("content_a").isNull()).select("key", F.col("key").alias("class_id"))
    return worded.unionByName(rest).withColumnRenamed("key", key)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of copies and near copies, and all rows without words.

    It is one with the class's least key, null last; where rows share it, one of its first content. Rows are found again by their key and
    what is written in them, so that no row passes through Python a second time.
    """
    signed, pairs, named = _classified(docs, key, text)
    marked, _ = settled(pairs.join(named, ["content_a", "content_b"]).withColumn("kept", F.col("chosen").isNotNull() & F.col("chosen.key").eqNullSafe(F.col("key"))))
    kept = F.col("kept") & (F.col("n") == 1)
    others = marked.filter(~kept).select("key", "content_a", "content_b", F.col("kept").alias("again"))  # rows to drop, and those that are equal, key and all
    others = others.withColumnsRenamed({c: f"_{c}" for c in ("key", "content_a", "content_b")})
    same = signed["key"].eqNullSafe(others["_key"]) & (signed["content_a"] == others["_content_a"]) & (signed["content_b"] == others["_content_b"])
    found, _ = settled(signed.join(others, same).select("key", "written", "content_a", "content_b", "again").distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{key}`").cast("bigint").alias("key"), _written(text).alias("written"))

    def joined(found: DataFrame, how: str) -> DataFrame:
        told = found.withColumnsRenamed({"key": "_key", "written": "_written"})
        return rows.join(told, rows["key"].eqNullSafe(told["_key"]) & (rows["written"] == told["_written"]), how)

    out = joined(small(found.select("key", "written")), "left_anti").select("row")
    again = found.filter("again").drop("again")
    if again.limit(1).count():
        out = out.unionByName(joined(again, "inner").groupBy("key", "content_a", "content_b").agg(F.first("row").alias("row")).select("row"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_neardup": op4_neardup}
ORACLE: dict[str, str] = {}
