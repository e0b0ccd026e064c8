"""Quality rules with risk-controlled thresholds.

Each document gets counts of its words, lines and symbols, and from them scores for a handful of rules
(high is bad). The rules of a stratum (the document's language) share one cutoff, which moves along a fixed grid from
the most lenient score to the strictest: a document fails as soon as one of its scores reaches it. Labelled
holdouts certify cutoffs in this order as long as an exact binomial test says that the rules together reject at
most a share `risk` of the good documents of the stratum. Testing in fixed order stops at the first failure, so
that the tests of a stratum need no correction among them, and any cutoff that passed may be used: the most
lenient one that rejects the most bad documents net of good ones is. Strata share the error `delta` by
Bonferroni's correction. With probability 1 - delta no stratum loses more than `risk` of its good documents.

A stratum whose good labels are so few that no cutoff could pass (under 228 at four strata) joins a pool of all
such strata, which counts as one more: there the bound holds for the pool as a whole and not for each of its strata.

Labels are joined once, by key; what is gathered are counts on the grid, by stratum, summed on the map side.
Cutoffs are a table of a row for each stratum and are joined by stratum. Only labelled texts are measured for them.

Edge cases: a null text has no words; a text of any length is read whole; a null stratum is its own; strata
without labels get no cutoffs, so only the base rule holds there; repeated rows are judged each; repeated
labels of a document count once, as good only if all say good; an empty table gives no rows; columns may have any
names, those of the counts included, but for the stratum column of `judge_documents`, which returns it beside the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import cut, slices, small, table, texts

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
#: Share of a stratum's good documents that the rules may reject, and the probability of exceeding it.
RISK, DELTA = 0.02, 0.05
#: Cutoffs tried, as scores from most lenient to strictest.
GRID = 64


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    size = len(known)
    pair = ids[:-1] * size + ids[1:]
    if size < 2_000_000:
        key = pair[:-1] * size + ids[2:]
    else:  # numbers of pairs, so that the product stays in range
        key = np.unique(pair[:-1], return_inverse=True)[1] * np.int64(size) + ids[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + n] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The COUNTS of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [line for line in raw.split(b"\n") if line.strip()] if b"\n" in raw else words[:1]
    return (
        len(words),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(lines),
    )


def count_words(df: DataFrame) -> DataFrame:
    """The COUNTS of every row of `df`, with the columns of its struct `row`, which holds a text."""
    schema = StructType([*(StructField(c, LongType()) for c in COUNTS), df.schema["row"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [measure(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*found, strict=True)), b.column("row")], names=schema.names)

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select("row").mapInArrow(run, schema).withColumn("base_failed", failed)


def rule_scores(c) -> dict[str, Column]:
    """Scores in 0..1, high for bad documents; `c` turns a count's name into its column."""
    words = F.greatest(c("n_words"), F.lit(1))
    mean = c("word_chars") / words
    return {
        "symbols": F.least(F.lit(1.0), c("n_symbols") / words),
        "dup_lines": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
        "repeats": c("n_repeat_words") / words,
        "upper": c("n_upper") / F.greatest(c("word_chars"), F.lit(1)),
        "word_length": F.least(F.lit(1.0), F.abs(mean - 6.0) / 12.0),
    }


def grid_step(score: Column) -> Column:
    """The strictest grid step that still rejects the score: step s rejects scores of 1 - s / GRID and more, step 0 none."""
    return F.greatest(F.lit(0), F.least(F.lit(GRID), F.floor((1 - score) * GRID) + 1)).cast("int")


def binomial_tail(k: int, n: int, p: float) -> float:
    """Exact P(X <= k) for X binomial with n trials of probability p: terms from k downwards until they vanish."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    last = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, i = math.exp(last), k
    while i > 0:
        down = np.arange(i, max(0, i - 65536), -1, dtype=np.float64)
        logs = last + np.cumsum(np.log(down) + math.log1p(-p) - np.log(n - down + 1) - math.log(p))
        total += float(np.exp(logs).sum())
        i -= len(down)
        if i < n * p and logs[-1] < math.log(total + 1e-300) - 45:
            break
        last = float(logs[-1])
    return min(1.0, total)


def certified_step(good: dict[int, int], bad: dict[int, int], n: int, risk: float, delta: float) -> int:
    """The grid step to cut at; -1 for none.

    `good` and `bad` have how many good and bad documents a step rejects and the step before it does not. Steps are
    certified in fixed order as long as their false rejections are shown to be at most `risk` of the `n` good
    documents; of those, the first counts that rejects the most bad documents net of good ones.
    """
    best, most, false, true = -1, 0, 0, 0
    for step in range(1, GRID + 1):
        false += good.get(step, 0)
        true += bad.get(step, 0)
        if n == 0 or binomial_tail(false, n, risk) > delta:
            break
        if true - false > most:
            best, most = step, true - false
    return best


def fit_cutoffs(counts: DataFrame, labels: DataFrame, strata: str = "lang", key: str = "doc_id", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(_stratum, _cutoff) from the labelled documents that pass the base rule. Labels are 1 (good) and 0."""
    first = F.least(*(grid_step(s) for s in rule_scores(F.col).values()))
    rows = counts.filter(~F.col("base_failed")).select(F.col(f"`{key}`").alias("_key"), F.col(f"`{strata}`").alias("_stratum"), first.alias("step"))
    counted = [F.count(F.when(F.col("_quality") == q, 1)).alias(name) for q, name in ((1, "good"), (0, "bad"))]
    seen = cut(rows.join(_said(labels, key), "_key").groupBy("_stratum", "step").agg(*counted))  # strata x grid rows
    sizes = seen.groupBy("_stratum").agg(F.sum("good").alias("n"))
    tests = sizes.agg((F.count(F.lit(1)) + 1).alias("n_tests"))  # the pool is one more
    enough = F.col("n") * math.log1p(-risk) <= F.log(F.lit(delta) / F.col("n_tests"))
    members = sizes.crossJoin(F.broadcast(tests)).select("_stratum", "n_tests", F.when(enough, F.struct("_stratum")).alias("of"))
    found = seen.join(members.withColumnRenamed("_stratum", "_s"), F.col("_stratum").eqNullSafe(F.col("_s"))).groupBy("of", "n_tests", "step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    found = found.groupBy("of", "n_tests").agg(F.sum("good").alias("n"), *(F.map_from_entries(F.collect_list(F.struct("step", c))).alias(c) for c in ("good", "bad")))
    schema = StructType([found.schema["of"], StructField("_cutoff", IntegerType())])

    def cutoffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = [certified_step(dict(x["good"]), dict(x["bad"]), x["n"], risk, delta / x["n_tests"]) for x in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("of"), pa.array(steps, pa.int32())], names=["of", "_cutoff"])

    fitted = found.mapInArrow(cutoffs, schema).withColumnRenamed("of", "_of")
    return members.join(fitted, F.col("of").eqNullSafe(F.col("_of"))).select("_stratum", "_cutoff")


def _said(labels: DataFrame, key: str) -> DataFrame:
    """(_key, _quality) of labelled documents."""
    return labels.filter(F.col("quality").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_key")).agg(F.min("quality").alias("_quality"))


def _judged(counts: DataFrame, cutoffs: DataFrame, stratum: Column) -> DataFrame:
    """`counts` with failed_rules and kept."""
    joined = counts.join(small(cut(cutoffs)), stratum.eqNullSafe(F.col("_stratum")), "left")
    over = [F.when((F.col("_cutoff") >= 1) & grid_step(s).between(1, F.col("_cutoff")), F.lit(r)) for r, s in rule_scores(F.col).items()]
    joined = joined.withColumn("failed_rules", F.array_compact(F.array(*over)))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def _counts(docs: DataFrame, strata: str, key: str) -> DataFrame:
    """Key, stratum, COUNTS and base_failed of documents."""
    rows = count_words(docs.select(F.struct(F.col(f"`{key}`"), F.col(f"`{strata}`"), "text").alias("row")))
    return rows.select(F.col(f"row.`{key}`").alias(key), F.col(f"row.`{strata}`").alias(strata), *COUNTS, "base_failed")


def judge_documents(docs: DataFrame, labels: DataFrame, strata: str = "lang", key: str = "doc_id") -> DataFrame:
    """Key, stratum, COUNTS, base_failed, failed_rules and kept of every document."""
    counts = cut(_counts(docs, strata, key))  # cutoffs and verdicts both read them
    judged = _judged(counts, fit_cutoffs(counts, labels, strata, key), F.col(f"`{strata}`"))
    return judged.select(F.col(f"`{key}`"), F.col(f"`{strata}`"), *COUNTS, "base_failed", "failed_rules", "kept")


#: Keys of labelled documents that are broadcast, at most; beyond, labels join by shuffle.
LABEL_KEYS = 1_000_000


def keep_documents(docs: DataFrame, labels: DataFrame, strata: str = "lang", key: str = "doc_id") -> DataFrame:
    """The documents that pass all rules, with all their columns. Texts are counted where they lie."""
    told = docs.join(small(_said(labels, key).select(F.col("_key").alias("_told")), LABEL_KEYS), F.col(f"`{key}`") == F.col("_told"), "left_semi")
    cutoffs = fit_cutoffs(_counts(told, strata, key), labels, strata, key)
    counts = count_words(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")))
    kept = _judged(counts, cutoffs, F.col(f"row.`{strata}`")).filter("kept")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


QUERIES = {"op6_quality": op6_quality}
ORACLE: dict[str, str] = {}
