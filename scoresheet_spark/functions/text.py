"""Text and number functions on columns; all run in the JVM but `six_decimals`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def strip(c: Column) -> Column:
    """Without white space at both ends, tabs and newlines included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """What stands between runs of white space; none for a blank text."""
    bare = strip(c)
    return F.when(F.length(bare) > 0, F.split(bare, r"\s+")).otherwise(F.array().cast("array<string>"))


def not_blank(c: Column) -> Column:
    return F.length(strip(c)) > 0


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def label_path(path: Column) -> Column:
    """Where the labels of an image lie: the same path with the extension .txt."""
    return F.concat(without_extension(path), F.lit(".txt"))


def workspace_name(name: Column) -> Column:
    """A folder name for a project: blanks become underscores."""
    return F.replace(name, F.lit(" "), F.lit("_"))


def half_even(c: Column) -> Column:
    """Nearest integer, ties to the even one."""
    return F.rint(c).cast("int")


def truncated(c: Column) -> Column:
    """Integer part, toward zero."""
    return c.cast("int")


def clip(c: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(c, high))


def percent(share: Column) -> Column:
    """A share as whole percent, ties to even."""
    return half_even(share * 100)


def clock(time: Column) -> Column:
    return F.date_format(time, "HH:mm:ss")


def clamped_step(position: Column, step: int, total: Column) -> Column:
    """The position after a step that stays within 0..total - 1."""
    return clip(position + step, F.lit(0), total - 1)


@pandas_udf(StringType())
def six_decimals(x: pd.Series) -> pd.Series:
    """Six decimals of the exact binary value, ties to even: JVM formatters round the decimal notation instead."""
    return x.map(lambda v: None if v is None or v != v else f"{v:.6f}")


def range_checks(config: dict[str, Column]) -> Column:
    """Names of the fields outside their ranges, out of the RANGES below."""
    bad = [F.when(~config[k].between(low, high) | (F.pmod(config[k].cast("double"), F.lit(step)) != 0 if step else F.lit(False)), F.lit(k)) for k, (low, high, step) in RANGES.items() if k in config]
    return F.array_compact(F.array(*bad))


#: Least value, greatest value and step of the input fields; fixed values.
RANGES = {
    "mcq_count": (1, 150, 1),
    "mcq_points": (0.5, 100, 0.5),
    "essay_count": (1, 20, 1),
    "essay_points": (0.5, 50, None),
    "confidence": (0.01, 0.99, None),
    "overlap": (0.01, 0.99, None),
    "box_field": (0, 100000, None),
}
#: Points of an essay question unless given; fixed value.
DEFAULT_ESSAY_POINTS = 2.0
