"""URL filters: allow and block rules in a trie over reversed host labels and path segments, longest match first.

A rule (host, path) fits its host and all its subdomains if the URL's path starts with the rule's path. Among the rules that fit, the one
with most host labels wins, then the one with the longest path, then block before allow. The trie is broadcast if the rules are at most
MOST_RULES; a longer list is joined on (host suffix, path prefix) instead, with the same result.

Defined cases: a null URL or one without `://` has an empty host and path and fits no rule; a URL that fits no rule gets the default
verdict and a null rule; repeated rows are judged alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winback.llm.common import lower_ascii, only

#: (verdict, host, path) of the production list; fixed values.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT = "allow"
#: About 200 MB as Python dictionaries; beyond it the rules stay a distributed table.
MOST_RULES = 200_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substring(after, F.length(host) + F.lit(1), F.length(after)), r"^[^?#]*", 0)


class Trie:
    """Nodes by reversed host labels; each has a second trie of whole path segments with the rest of a rule's path at its end."""

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        for verdict, host, path in sorted(rules):  # allow sorts before block, so block overwrites
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})  # no label holds a slash
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault("/", {})[rest] = (host + path, verdict)

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple = (None, None)
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            best = self._deepest(node.get("/"), segments) or best
        return best

    @staticmethod
    def _deepest(node: dict | None, segments: list[str]) -> tuple | None:
        best = None
        for segment in segments:
            if node is None:
                break
            rests = node.get("/", {})
            fit = [r for r in rests if segment.startswith(r)]
            if fit:
                best = rests[max(fit, key=len)]
            node = node.get(segment)
        return best


def by_trie(urls: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for host, path in batches:
            found = [trie.value.match(h, p) for h, p in zip(host, path)]
            yield pd.DataFrame({"rule": [r for r, _ in found], "verdict": [v or default for _, v in found]}, dtype=object)

    return urls.withColumn("found", judge("host", "path")).select("page_id", "host", "path", "found.rule", "found.verdict")


def by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same judgement with rules as a table: each URL meets the rules of its host suffixes whose path length occurs there."""
    listed = rules.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max("verdict").alias("verdict"))
    lengths = listed.groupBy("h").agg(F.collect_set(F.length("p")).alias("lengths"))  # as many as a host's paths have lengths
    rows = urls.withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    keyed = (rows.withColumn("labels", labels).withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("labels"))))
             .withColumn("h", F.array_join(F.slice("labels", -F.col("depth"), F.col("depth")), ".")))
    tried = keyed.join(lengths, "h").withColumn("n", F.explode("lengths")).where("length(path) >= n").withColumn("p", F.expr("substring(path, 1, n)"))
    won = tried.join(listed, ["h", "p"]).groupBy("row").agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), "verdict"), F.struct("depth", "n")).alias("found"))
    return rows.join(won, "row", "left").select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    rules = RULES if rules is None else rules
    host, path = parts(F.col("url"))
    urls = only(pages, page_id="page_id", url="url").select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    if isinstance(rules, DataFrame):
        few = rules.select("verdict", "host", "path").limit(MOST_RULES + 1).collect()
        if len(few) > MOST_RULES:
            return by_join(urls, rules, default)
        rules = [tuple(r) for r in few]
    return by_trie(urls, rules, default)
