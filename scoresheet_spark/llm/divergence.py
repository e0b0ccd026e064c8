"""How far the sources of a language are apart in their words.

Terms are counted in one pass over the texts: a task sums (group, term) in a table of bounded size before anything is
shuffled. A language keeps the terms that enough of its documents have. Terms with the same sparse vector of counts
by source are one: every pair of sources is evaluated once for each distinct vector, and the value multiplied by how
many terms share it. The terms themselves are ranked for each group by their share against the whole language's.

Shares are whole numbers, p = 1 + floor(SCALE * (count + 1) / (N + V)), N the counts of the group or language, V its kept
terms; the divergence of p from q is floor((p - q)**2 / q). All arithmetic is exact: 64-bit integers with a long division by
digits of base 1000 for shares, decimals for the terms' values.

Hot keys: counts of a (language, source, term) meet as a row a task at most, vectors of a language are dealt to all
tasks, whose sums by pair of sources are what is shuffled, and a window ranks only what each task has left of
the first `top` terms of a group. The result has a row for each pair of sources of a language.

Edge cases: null text, lang and source are ''; a group without terms still has its pairs; a language without kept terms
has pairs of value 0 and no term rows; texts and terms may be of any length; repeated rows are counted each; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, slices, small, table

#: Documents of a language that a kept term must be in, and terms that are ranked for a group.
LEAST_DOCS, TOP_TERMS = 3, 200
SCALE = 1_000_000_000
#: Sums that a task holds before it hands them on, in entries and in bytes of terms.
MAX_ENTRIES, MAX_BYTES = 200_000, 16_000_000
#: Pairs of sources whose sums a task holds; with more, each batch's sums leave at once.
MAX_PAIRS = 1_000_000
#: A byte of a term as itself, in lower case; any other as a space. Bytes from 0x80 on belong to letters outside ASCII.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): partial sums of occurrences and of documents, a row a task and term or a few."""
    rows = df.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, list[int]] = {}
        size = 0

        def leave() -> Iterator[pa.RecordBatch]:
            keys, sums = list(counts), list(counts.values())
            for i in range(0, len(keys), 10_000):
                k, s = keys[i : i + 10_000], sums[i : i + 10_000]
                cols = [pa.array([x[0] for x in k]), pa.array([x[1] for x in k]), pa.array([x[2].decode() for x in k]), pa.array([x[0] for x in s], pa.int64()), pa.array([x[1] for x in s], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
            counts.clear()

        for b in slices(batches):
            for g, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                for term, n in Counter(t.translate(_TERM_BYTES).split()).items():
                    held = counts.get((g, s, term))
                    if held:
                        held[0] += n
                        held[1] += 1
                    else:
                        counts[g, s, term] = [n, 1]
                        size += len(term)
                if len(counts) > MAX_ENTRIES or size > MAX_BYTES:
                    yield from leave()
                    size = 0
        yield from leave()

    return rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def kept_terms(partial: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, counts): kept terms, each with its sources and counts there in the order of the sources' names."""
    dealt = partial.repartition("lang", "term")  # both sums keep this layout
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return terms.filter(F.col("docs") >= least).select("lang", "term", "counts")


def group_totals(df: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, total, terms) of every group that occurs, and of each language with source null: N and V."""
    groups = df.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    counted = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    sized = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    none = F.lit(0).cast("bigint")
    each = groups.join(counted, ["lang", "source"], "left").join(sized, "lang", "left").select("lang", "source", F.coalesce("total", none).alias("total"), F.coalesce("terms", none).alias("terms"))
    return each.unionByName(each.groupBy("lang").agg(F.lit(None).cast("string").alias("source"), F.sum("total").alias("total"), F.max("terms").alias("terms")).select("lang", "source", "total", "terms"))


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / totals) for arrays of 64-bit integers, totals below 2**53."""
    out, rest = np.divmod(counts + 1, totals)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1_000, totals)
        out = out * 1_000 + digit
    return out + 1


def pair_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, other, value) of every two sources of a language: the divergence of the first from the second, over all kept terms."""
    vectors = kept.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("times"))
    names = totals.filter("source IS NOT NULL").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("groups"), F.max("terms").alias("terms"))
    rows = vectors.join(small(names), "lang").select("lang", F.col("groups.source").alias("sources"), F.transform("groups", lambda g: g["total"] + F.col("terms")).alias("sizes"), "times", F.col("counts.source").alias("there"), F.col("counts.n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[list[str], np.ndarray]] = {}

        def leave() -> Iterator[pa.RecordBatch]:
            for lang, (sources, values) in sums.items():
                for i, name in enumerate(sources):
                    others = [j for j in range(len(sources)) if j != i]
                    if others:
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(others)), pa.array([name] * len(others)), pa.array([sources[j] for j in others]), pa.array(values[i, others])], names=["lang", "source", "other", "value"])
            sums.clear()

        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs):
                mine = b.take(pa.array(np.flatnonzero(langs == lang)))
                sources, sizes = mine.column("sources")[0].as_py(), np.array(mine.column("sizes")[0].as_py(), np.int64)
                place = {s: i for i, s in enumerate(sources)}
                _, values = sums.setdefault(lang, (sources, np.zeros((len(sources),) * 2, np.int64)))
                step = max(1, 2_000_000 // len(sources))
                for at in range(0, mine.num_rows, step):
                    part = mine.slice(at, step)
                    there = part.column("there")
                    counts = np.zeros((part.num_rows, len(sources)), np.int64)
                    owner = np.repeat(np.arange(part.num_rows), [len(x) for x in there])
                    counts[owner, [place[s] for s in there.flatten().to_pylist()]] = part.column("n").flatten().to_numpy()
                    p, times = _shares(counts, sizes), part.column("times").to_numpy()
                    for i in range(len(sources)):
                        values[i] += times @ ((p[:, i : i + 1] - p) ** 2 // p)
                if sum(len(v) ** 2 for _, v in sums.values()) > MAX_PAIRS:
                    yield from leave()
        yield from leave()

    found = rows.mapInArrow(run, "lang string, source string, other string, value bigint").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    # languages without kept terms have pairs as well
    every = totals.filter("source IS NOT NULL").select("lang", "source")
    bare = every.join(totals.filter("source IS NULL AND terms = 0").select("lang"), "lang", "left_semi")
    pairs = bare.join(bare.select("lang", F.col("source").alias("other")), "lang").filter("source <> other").select("lang", "source", "other", F.lit(0).cast("bigint").alias("value"))
    return found.unionByName(pairs)


def term_values(kept: DataFrame, totals: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, term, value, rank): the terms whose share of a group exceeds their share of the language by most, `top` for each group at most."""
    share = lambda n, total: F.expr(f"1 + (cast({n} + 1 as decimal(20,0)) * {SCALE}) div cast({total} + terms as decimal(20,0))")
    whole = totals.filter("source IS NULL").select("lang", F.col("total").alias("whole"))
    rows = kept.withColumn("all_n", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c["n"])).select("lang", "term", "all_n", F.explode("counts").alias("c")).select("lang", "term", "all_n", "c.source", "c.n")
    groups = totals.filter("source IS NOT NULL").join(whole, "lang")
    rows = rows.join(small(groups), ["lang", "source"]).select("lang", "source", "term", share("n", "total").alias("p"), share("all_n", "whole").alias("q")).filter("p > q")
    rows = rows.select("lang", "source", "term", F.expr("(p - q) * (p - q) div q").alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))).filter(F.col("rank") <= top)


def audit(df: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` lists the other sources of the language, `term` the group's words, each by value descending."""
    kept = cut(kept_terms(count_terms(df, text, lang, source), least))
    totals = cut(group_totals(df, kept, lang, source))
    pairs = pair_values(kept, totals)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")))
    part = lambda rows, name, item: rows.select("lang", "source", _name(name), F.col(item).alias("item"), "value", "rank")
    return part(ranked, "pair", "other").unionByName(part(term_values(kept, totals, top), "term", "term"))


def _name(part: str) -> Column:
    return F.lit(part).alias("part")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op13_divergence": op13_divergence}
ORACLE = {
    "op13_divergence": rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM grp g JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)),
totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
p AS (SELECT c.*, 1 + (1000000000::HUGEINT * (n + 1)) // (total::HUGEINT + v) AS p FROM cells c JOIN totals USING (lang, source) JOIN v USING (lang)),
wholes AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL),
q AS (SELECT x.lang, x.term, 1 + (1000000000::HUGEINT * (x.n::HUGEINT + 1)) // (t.total::HUGEINT + v) AS q FROM wholes x JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY ALL) t USING (lang) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM all_pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= {TOP_TERMS}""",
}
