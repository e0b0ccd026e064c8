"""URL filters: a trie over reversed host labels and path segments.

A rule is (action, host, path prefix). It fits a URL when the rule's host is the URL's host or one of
its parent domains and the URL's path starts with the rule's path. Of several fitting rules the longest
host wins, then the longest path, then block before allow. The trie is made on the driver, checked
against `MAX_RULES`, and shipped once as a broadcast variable; the URLs are never shuffled.

Edge cases: a null URL or one without `://` has an empty host and path and fits no rule; repeated URLs
give repeated rows; an empty table gives an empty one; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rules in one trie at most: about 100 bytes each on every executor.
MAX_RULES = 2_000_000

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _A, _Z), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleTrie:
    """Nodes by reversed host label, then by complete path segment; a node keeps the rules that end in it.

    A path prefix may end inside a segment, so each node holds its rules by the rest of that last segment.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root: dict = {"hosts": {}, "paths": None}
        self.size = 0
        for action, host, path in rules:
            self.add(action, host, path)

    def add(self, action: str, host: str, path: str) -> None:
        if action not in ("allow", "block"):
            raise ValueError(f"unknown action {action!r}")
        self.size += 1
        if self.size > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules: too many to ship to every executor")
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node["hosts"].setdefault(label, {"hosts": {}, "paths": None})
        if node["paths"] is None:
            node["paths"] = {"next": {}, "ends": {}}
        node = node["paths"]
        *whole, rest = path.split("/")
        for segment in whole:
            node = node["next"].setdefault(segment, {"next": {}, "ends": {}})
        known = node["ends"].get(rest)
        if known is None or action == "block":
            node["ends"][rest] = (action, host + path)

    @staticmethod
    def _in_paths(node: dict, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")
        for i, segment in enumerate(segments):
            ends = node["ends"]
            if ends:
                if len(ends) <= len(segment):
                    fitting = [x for x in ends if segment.startswith(x)]
                else:
                    fitting = [segment[:n] for n in range(len(segment) + 1) if segment[:n] in ends]
                if fitting:
                    best = ends[max(fitting, key=len)]
            node = node["next"].get(segment) if i < len(segments) - 1 else None
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(action, rule) of the winning rule, or None."""
        node, found = self.root, []
        if host:
            if node["paths"]:
                found.append(node["paths"])
            for label in reversed(host.split(".")):
                node = node["hosts"].get(label)
                if node is None:
                    break
                if node["paths"]:
                    found.append(node["paths"])
        for paths in reversed(found):
            if best := self._in_paths(paths, path):
                return best
        return None


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", keep: tuple[str, ...] = (), default: str = "allow") -> DataFrame:
    """`keep` columns of `df` with host, path, rule and verdict of each row's URL; `default` where no rule fits."""
    trie = df.sparkSession.sparkContext.broadcast(RuleTrie(rules))
    parsed = df.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_trie = trie.value
        for batch in batches:
            known: dict = {}
            rule, verdict = [], []
            for key in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if key not in known:
                    known[key] = rule_trie.match(*key) or (default, None)
                verdict.append(known[key][0])
                rule.append(known[key][1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    from pyspark.sql.types import StringType, StructField, StructType

    return parsed.mapInArrow(judge, StructType([*parsed.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())]))


#: The rules of the registered query.
PAGE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), PAGE_RULES, keep=("page_id",))


_SQL_RULES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in PAGE_RULES)
ORACLE = {
    "op3_url_filter": f"""
WITH parsed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_A}', '{_Z}'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(action, rhost, rpath) AS (VALUES {_SQL_RULES}),
ids AS (SELECT *, row_number() OVER () AS rid FROM parsed),
best AS (
  SELECT rid, arg_max(rhost || rpath, length(rhost) * 10000 + length(rpath)) AS rule,
         arg_max(action, length(rhost) * 10000 + length(rpath)) AS action
  FROM ids JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM ids LEFT JOIN best USING (rid)"""
}
QUERIES = {"op3_url_filter": op3_url_filter}
