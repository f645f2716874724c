"""URL filters: a broadcast trie over reversed host labels and path segments.

A rule is (verdict, host, path); it fits its host and all subdomains where the
url's path starts with the rule's. The deepest host wins, then the longest path,
then block over allow. Rules are a list or a table; up to MAX_TRIE_RULES of them are
broadcast as a trie, more are joined: a url's host suffixes meet the lengths of the
rules of that host, and the prefixes of its path of these lengths the rules. Urls of
one suffix are dealt to SALTS parts.

Cases: null url or one without ``://``: empty host and path, no rule, default
verdict. Null page_id: kept. Repeated rows: one result row each. Empty table or
empty rule list: no rows, or default verdicts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

Rule = tuple[str, str, str]

RULES: tuple[Rule, ...] = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MAX_TRIE_RULES = 500_000
SALTS = 16


class Trie:
    """Nodes are dicts: host labels from the right, then, under PATHS, path
    segments from the left; under RESTS the unfinished last segments, under SIZES
    their lengths, longest first."""

    PATHS, RESTS, SIZES = 0, 1, 2

    def __init__(self, rules: list[Rule]) -> None:
        self.root: dict = {}
        for verdict, host, path in sorted(rules, key=lambda r: r[0] == "block"):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, rest = path.split("/")
            node = node.setdefault(self.PATHS, {})
            for part in whole:
                node = node.setdefault(part, {})
            rests = node.setdefault(self.RESTS, {})
            rests[rest] = (verdict, host + path)
            if len(rest) not in (sizes := node.setdefault(self.SIZES, [])):
                sizes.append(len(rest))
                sizes.sort(reverse=True)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest match."""
        node, best = self.root, None
        labels = host.split(".")
        at = [node] if not host else []
        for label in reversed(labels):
            if (node := node.get(label)) is None:
                break
            at.append(node)
        for node in reversed(at):
            if self.PATHS in node and (best := self._below(node[self.PATHS], path.split("/"))):
                return best
        return best

    def _below(self, node: dict, parts: list[str]) -> tuple[str, str] | None:
        best = None
        for part in parts:
            for n in node.get(self.SIZES, ()):
                if n <= len(part) and (found := node[self.RESTS].get(part[:n])):
                    best = found
                    break
            if (node := node.get(part)) is None:
                break
        return best


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: list[Rule] | tuple[Rule, ...] | DataFrame = RULES, default: str = "allow", max_trie: int = MAX_TRIE_RULES) -> DataFrame:
    """page_id, host, path, rule (or null) and verdict of each row. A table of rules
    has the columns verdict, host and path."""
    known = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if isinstance(rules, DataFrame):
        some = [tuple(r) for r in rules.select("verdict", "host", "path").limit(max_trie + 1).collect()]
        if len(some) > max_trie:
            return judge_joined(known, rules, default)
        rules = some
    if len(rules) > max_trie:
        listed = pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
        return judge_joined(known, listed, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(list(rules)))

    @F.pandas_udf("struct<verdict: string, rule: string>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            each = [trie.value.find(h, p) or (default, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(each, columns=["verdict", "rule"], index=hosts.index, dtype=object)

    return known.withColumn("__f", found("host", "path")).select("page_id", "host", "path", F.col("__f.rule").alias("rule"), F.col("__f.verdict").alias("verdict"))


def judge_joined(known: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same for rules too many to broadcast; equal (host, path) pairs are judged
    once. No url meets a rule but those that fit it."""
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    listed = rules.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("block"))
    sizes = listed.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("sizes")).withColumn("salt", every)  # as many as lengths of paths
    pairs = known.select("host", "path").distinct().withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    labels = F.split("host", "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = pairs.withColumn("rule_host", F.explode(suffixes)).join(sizes, ["rule_host", "salt"])
    tried = tried.select("host", "path", "salt", "rule_host", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n"))
    met = tried.withColumn("rule_path", F.substring(F.col("path"), F.lit(1), F.col("n"))).join(listed.withColumn("salt", every), ["rule_host", "rule_path", "salt"])
    order = F.struct(F.size(F.split("rule_host", "\\.", -1)), "n")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.when(F.col("block") == 1, "block").otherwise("allow").alias("v")), order).alias("b"))
    return known.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.v", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP4_SQL = r"""
with u as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from pages
), r as (
  select *, case
    when (host = 'example.org' or host like '%.example.org') and path like '/en/1%' then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and path like '/es/%' then 'example.org/es/'
    when (host = 'org' or host like '%.org') and path like '/%' then 'org/'
    when (host = 'com' or host like '%.com') and path like '/fr/%' then 'com/fr/'
    when (host = 'com' or host like '%.com') and path like '/de/%' then 'com/de/' end as rule
  from u
)
select page_id, host, path, rule, case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' else 'allow' end as verdict from r
"""
