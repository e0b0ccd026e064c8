"""Secret scans with DataFrame functions only.

Base patterns give spans as they are. Further candidates are long strings of key characters; a window slides
over each, and the Shannon entropy of its characters follows from counts that change by one character in and
one out. A candidate is a secret when some window's entropy reaches the threshold of its character class
(hexadecimal or base 64), unless an allow-list pattern fits it. Of a candidate that base spans overlap, what they
leave is judged.

Positions are code points, ends exclusive. They come from splitting the text at a pattern: the lengths of
what lies between matches and of the matches add up, in blocks, so that many matches cost no square.

Everything is a narrow projection: no shuffle, no state, no Python on the executors.

Edge cases: a null text is ''; texts are scanned whole, however long; a candidate shorter than the window
is judged by one window over all of it; repeated rows give repeated rows; an empty table gives no rows;
further columns are carried only by `redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Kinds in the order in which they are listed, with pattern, group that must be long enough, and its length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: What an entropy scan looks at: runs of key characters with a letter and a digit among them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Class, pattern of the whole candidate, bits a character that a window must have.
CLASSES = (("entropy_hex", "^[0-9A-Fa-f]+$", 3.0), ("entropy_base64", "", 3.7))
#: Words as in names and paths: letters in humps of a capital and two small letters or more, or all capitals; with a short number.
_WORD = r"(?:[A-Z]?[a-z]{2,}+(?:[A-Z][a-z]{2,}+)*+|[A-Z]++|[a-z])[0-9]{0,4}+"
_NAME = rf"(?:{_WORD}|[0-9]{{1,4}}+)(?:[-_=+]++(?:{_WORD}|[0-9]{{1,4}}+))*+[-_=+]*+"
#: Candidates that are not secrets; fixed values. Placeholder words and slashes count only where all of the value is made of words.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    rf"^(?=.*(?i:example|placeholder|changeme|dummy|sample))/*+{_NAME}(?:/++{_NAME})*+/*+$",
    r"^[a-z]+([_/=-][a-z]+)*[_/=-]?[0-9]{1,4}$",
    r"^(abcdefghij|0123456789|ABCDEFGHIJ)",
    rf"^(?=(?:[^/]*+/){{3}})/*+{_NAME}(?:/++{_NAME})*+/*+$",
)
BLOCK = 256
#: Characters of a candidate whose windows are counted in one go.
PIECE = 256


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body reads it: the optimizer would else put it into lambdas, for each element anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(sizes: Column) -> Column:
    """Sum of all sizes before each element: block sums first, then within a block."""

    def starts(sizes: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / BLOCK).cast("int")), lambda k: F.slice(sizes, k * BLOCK + 1, BLOCK))
        add = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
        total = lambda of: F.aggregate(of, F.lit(0), lambda a, x: a + x)
        before = F.aggregate(F.transform(blocks, total), F.array(F.lit(0)), add)
        within = lambda of, first: F.slice(F.aggregate(of, F.array(first), add), 1, F.size(of))
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), within))

    return F.when(F.size(sizes) > 0, _let(sizes, starts)).otherwise(F.array().cast("array<int>"))


def _matches(df: DataFrame, pattern: str, group: int, name: str) -> DataFrame:
    """`df` with `name`: array<struct<start, end, hit, part>> of the pattern's matches in `text`, leftmost first."""
    none = F.array().cast("array<string>")
    found = F.col("text").rlike(pattern)
    df = df.withColumn("_hits", F.when(found, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_part", F.when(F.size("_hits") > 0, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).otherwise(none) if group else F.col("_hits"))
    df = df.withColumn("_gaps", F.when(F.size("_hits") > 0, F.split("text", pattern, -1)).otherwise(none))
    df = df.withColumn("_sizes", F.zip_with("_gaps", "_hits", lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0))))
    df = df.withColumn("_before", _starts(F.col("_sizes")))
    spans = F.transform(
        F.arrays_zip("_hits", "_part", "_gaps", "_before"),
        lambda x: F.struct((x["_before"] + F.length(x["_gaps"])).alias("start"), (x["_before"] + F.length(x["_gaps"]) + F.length(x["_hits"])).alias("end"), x["_hits"].alias("hit"), x["_part"].alias("part")),
    )
    return df.withColumn(name, F.filter(spans, lambda x: x["hit"].isNotNull())).drop("_hits", "_part", "_gaps", "_sizes", "_before")


def _entropy(hit: Column) -> Column:
    """The greatest Shannon entropy, in bits, of a window over the string, or of all of it where it is shorter: in pieces that overlap by all but one of a window's characters."""
    step = PIECE - WINDOW + 1
    pieces = F.regexp_extract_all(hit, F.lit(rf"(?=(.{{1,{PIECE}}})).{{1,{step}}}"), F.lit(1))
    size = F.least(F.length(hit), F.lit(WINDOW))
    least = F.array_min(F.transform(F.filter(pieces, lambda p: F.length(p) >= size), _least_weight))
    return F.log2(size.cast("double")) - least / size


def _least_weight(piece: Column) -> Column:
    """The least sum of c * log2(c), over the counts c of a window's characters, of all windows of a piece.

    Counts are a string with a character for each of the alphabet, so that a step changes one of them and the sum by one
    look-up. Codes come in as positive numbers and go out as negative ones; 0 stands behind the first whole window.
    """
    weigh = lambda c: c * math.log2(c) if c > 1 else 0.0
    up = F.array(*(F.lit(weigh(c + 1) - weigh(c)) for c in range(WINDOW + 2)))
    down = F.array(*(F.lit(weigh(c - 1) - weigh(c)) for c in range(WINDOW + 2)))
    codes = F.transform(F.split(piece, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    later = F.flatten(F.zip_with(F.slice(codes, WINDOW + 1, PIECE), F.slice(codes, 1, F.greatest(F.length(piece) - WINDOW, F.lit(0))), lambda i, o: F.array(i, -o)))
    events = F.concat(F.slice(codes, 1, WINDOW), F.array(F.lit(0)), later)

    def step(a: Column, e: Column) -> Column:
        place = F.abs(e)
        count = F.ascii(F.substring(a["counts"], place, F.lit(1))) - ord("0")
        counts = F.when(e == 0, a["counts"]).otherwise(F.overlay(a["counts"], F.char(count + F.when(e > 0, ord("0") + 1).otherwise(ord("0") - 1)), place, F.lit(1)))
        total = a["sum"] + F.when(e > 0, F.get(up, count)).when(e < 0, F.get(down, count)).otherwise(0.0)
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(e <= 0, F.least(a["least"], total)).otherwise(a["least"]).alias("least"))

    start = F.struct(F.lit("0" * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(math.inf).alias("least"))
    return F.aggregate(events, start, step, lambda a: a["least"])


def find_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns as the struct `row`, the text, base spans by kind, and `spans`: array<struct<start, rank, end, kind>> of all."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for kind, pattern, group, least in BASE:
        if kind == "hex":  # runs that are too short are dropped in any case
            pattern = rf"(?<![0-9a-f])[0-9a-f]{{{least},}}+"
        rows = _matches(rows, pattern, group, kind)
        rows = rows.withColumn(kind, F.filter(kind, _long_enough(least)))
    rows = _matches(rows, CANDIDATE, 0, "_found")
    base = F.concat(*(F.col(kind) for kind, *_ in BASE))
    rows = rows.withColumn("_base", F.array_sort(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))))
    # base spans in blocks with their reach, so that a candidate meets those of its own neighbourhood
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size("_base") / BLOCK).cast("int")), lambda k: F.slice("_base", k * BLOCK + 1, BLOCK))
    reach = F.transform(blocks, lambda b: F.struct(F.array_min(b["start"]).alias("start"), F.array_max(b["end"]).alias("end"), b.alias("of")))
    rows = rows.withColumn("_reach", F.when((F.size("_base") > 0) & (F.size("_found") > 0), reach).otherwise(F.array().cast("array<struct<start:int,end:int,of:array<struct<start:int,end:int>>>>")))
    hides = lambda c: lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])
    near = lambda reach: lambda c: F.struct(c.alias("c"), F.flatten(F.transform(F.filter(reach, hides(c)), lambda r: F.filter(r["of"], hides(c)))).alias("by"))
    hidden = _let(F.struct(F.col("_reach").alias("reach"), F.col("_found").alias("found")), lambda v: F.transform(v["found"], near(v["reach"])))
    rows = rows.withColumn("_hidden", hidden)
    rows = rows.withColumn("_found", F.flatten(F.transform("_hidden", lambda h: F.when(F.size(h["by"]) > 0, _rest(h["c"], h["by"])).otherwise(F.array(h["c"])))))
    allowed = lambda c: F.expr("false") if not ALLOWED else _any([c["hit"].rlike(p) for p in ALLOWED])
    rows = rows.withColumn("_found", F.filter("_found", lambda c: ~allowed(c)))
    rank = len(BASE)
    listed = [F.transform(kind, _span(i, kind)) for i, (kind, *_) in enumerate(BASE)]
    is_hex = lambda c: c["hit"].rlike(CLASSES[0][1])
    judged = F.transform("_found", lambda c: F.struct(c["start"].alias("start"), F.when(is_hex(c), rank).otherwise(rank + 1).alias("rank"), c["end"].alias("end"), F.when(is_hex(c), CLASSES[0][0]).otherwise(CLASSES[1][0]).alias("kind"), _entropy(c["hit"]).alias("bits")))
    rows = rows.withColumn("_judged", F.filter(judged, lambda x: x["bits"] >= F.when(x["rank"] == rank, CLASSES[0][2]).otherwise(CLASSES[1][2])))
    added = F.transform("_judged", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    rows = rows.withColumn("base_spans", F.array_sort(F.concat(*listed))).withColumn("spans", F.array_sort(F.concat("base_spans", added)))
    return rows.drop("_found", "_base", "_reach", "_hidden", "_judged")


def _rest(c: Column, spans: Column) -> Column:
    """What base spans, in order, leave of a candidate, where that is a candidate itself."""
    piece = lambda start, end: F.struct(start.alias("start"), end.alias("end"), F.substring(c["hit"], start - c["start"] + 1, end - start).alias("hit"))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    step = lambda a, b: F.struct(F.greatest(a["at"], b["end"]).alias("at"), F.when(b["start"] > a["at"], F.concat(a["out"], F.array(piece(a["at"], b["start"])))).otherwise(a["out"]).alias("out"))
    last = lambda a: F.when(a["at"] < c["end"], F.concat(a["out"], F.array(piece(a["at"], c["end"])))).otherwise(a["out"])
    pieces = F.aggregate(spans, F.struct(c["start"].alias("at"), none.alias("out")), step, last)
    kept = F.filter(pieces, lambda x: (F.length(x["hit"]) >= WINDOW) & x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]"))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), x["hit"].alias("part")))


def _long_enough(least: int):
    return lambda x: F.length(x["part"]) >= least


def _span(rank: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def listing(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of `df` with every span of `text` replaced by `mark`; n_chars, where there, follows the text."""
    found = find_secrets(df, keep=tuple(df.columns))
    # spans that overlap or touch become one
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (x["start"] <= F.get(a, F.size(a) - 1)["end"]),
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.greatest(F.get(a, F.size(a) - 1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    found = found.withColumn("_merged", F.when(F.size("spans") > 0, merged))
    piece = lambda i: F.substring("text", F.coalesce(F.get("_merged", i - 1)["end"], F.lit(0)) + 1, F.coalesce(F.get("_merged", i)["start"], F.length("text")) - F.coalesce(F.get("_merged", i - 1)["end"], F.lit(0)))
    clean = F.when(F.size("spans") > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.size("_merged")), piece), mark)).otherwise(F.col("row.text"))
    found = found.withColumn("_clean", clean)
    out = {c: F.col(f"row.`{c}`") for c in df.columns} | {"text": F.col("_clean")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.size("spans") > 0, F.length("_clean").cast(df.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*(c.alias(n) for n, c in out.items()))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *(F.size(kind).cast("bigint").alias(f"n_{kind}") for kind, *_ in BASE),
        F.sha2(listing(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        listing(F.col("spans")).alias("spans"),
    )


QUERIES = {"op5_secrets": op5_secrets}
ORACLE: dict[str, str] = {}
