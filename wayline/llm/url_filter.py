"""URL filters: a trie over reversed host labels and path segments, with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read

#: A rule list is broadcast as a trie up to this many characters of rules; a longer one is joined.
MAX_TRIE_CHARS = 16_000_000


class Rule(NamedTuple):
    verdict: str  # "allow" or "block"
    host: str
    path: str  # a prefix of the url's path; "" fits every path

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules of ``op1_url_filter``.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class UrlTrie:
    """Host labels from the top-level domain down, then whole path segments, then the last, partial segment.

    Every node of the host part may hold the root of a path part. A path node keeps the rules that
    end in it by the length of their last segment, which need only begin the url's segment, and then by
    that segment: a url of any length is looked at no further than the rules go. The deepest host wins,
    then the longest path; an entry listed as both allow and block blocks.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {"labels": {}, "paths": None}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
            node["paths"] = at = node["paths"] or {"segments": {}, "ends": {}}
            *whole, last = rule.path.split("/")
            for segment in whole:
                at = at["segments"].setdefault(segment, {"segments": {}, "ends": {}})
            ends = at["ends"].setdefault(len(last), {})
            if last not in ends or rule.verdict == "block":
                ends[last] = (rule.text, rule.verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        node, fits = self.root, []
        for label in reversed(host.split(".")):
            node = node["labels"].get(label)
            if node is None:
                break
            if node["paths"]:
                fits.append(node["paths"])
        for top in reversed(fits):
            if found := self._match_path(top, path.split("/")):
                return found
        return None

    @staticmethod
    def _match_path(at: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for n in sorted(at["ends"], reverse=True):
                if n <= len(segment) and segment[:n] in at["ends"][n]:
                    best = at["ends"][n][segment[:n]]
                    break
            at = at["segments"].get(segment)
            if at is None:
                break
        return best


def filter_urls(
    pages: DataFrame,
    rules: Iterable[Rule] = RULES,
    url: str = "url",
    default: str = "allow",
    max_trie_chars: int = MAX_TRIE_CHARS,
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row; no row is dropped and nothing shuffles.

    A rule fits its host and all subdomains when the url's path starts with the rule's path. The
    longest match wins: more host labels first, then the longer path. Null urls and urls without
    ``://`` have an empty host and path and get ``default``, as does every url that no rule fits.
    Columns of those four names in ``pages`` are replaced; repeated rows are judged alike. A rule
    list of more than ``max_trie_chars`` characters is not broadcast but joined
    (:func:`join_urls`), with the same result.
    """
    rules = list(rules)
    if sum(len(r.text) for r in rules) > max_trie_chars:
        return join_urls(pages, rules, url, default)
    held = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = held.value
        for hosts, paths in batches:
            found = [trie.match(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    old = pages.withColumns({"host": host_of(pages[url]), "path": path_of(pages[url])})
    kept = [c for c in old.columns if c.lower() not in ("rule", "verdict")]
    judged = old.select(*kept, judge("host", "path").alias("__judged"))
    return judged.select(*kept, "__judged.rule", "__judged.verdict")


def join_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """:func:`filter_urls` for rule lists of any length, given as a DataFrame (verdict, host, path) or rules.

    Each distinct url meets the rules on (host suffix, whole leading segments), an equi-join with at
    most as many keys a url as the rules have lengths of hosts times depths of paths, however long it is; the verdicts
    return to the pages by url.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    keyed = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        F.col("host").alias("key_host"),
        F.regexp_extract("path", r"(?s)^(.*/)?", 0).alias("key_path"),
        F.col("path").alias("rule_path"),
        "verdict",
    )
    deepest = keyed.agg(F.max(F.size(F.split("key_host", r"\."))), F.max(F.size(F.split("key_path", "/"))), F.max(F.length("key_path"))).first()
    host_depth, path_depth, path_length = (n or 0 for n in deepest)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    base = pages.withColumns({"host": host_of(pages[url]), "path": path_of(pages[url])}).select(*kept, "host", "path")
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    distinct = base.select("host", "path").distinct()
    keys = (
        distinct.withColumn("key_host", F.explode(F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - host_depth + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
        .withColumn("key_path", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(max(0, path_depth - 1)))), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))))
        .where(F.length("key_path") <= path_length)
    )
    found = (
        keys.join(keyed, ["key_host", "key_path"])
        .where(F.expr("startswith(path, rule_path)"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("key_host", "rule_path").alias("rule"), "verdict"), F.struct(F.size(F.split("key_host", r"\.")), F.length("rule_path"))).alias("won"))
    )
    return base.join(found, ["host", "path"], "left").select(*kept, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM cut
), split AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM parts
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host) * 100000 + length(rule_path)) AS rule,
         arg_max(verdict, length(rule_host) * 100000 + length(rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM split) s
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, split.host, split.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM split LEFT JOIN best ON split.host = best.host AND split.path = best.path
"""
