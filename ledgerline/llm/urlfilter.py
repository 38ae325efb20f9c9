"""URL filters: allow and block rules in a trie over reversed host labels and path segments.

A rule fits its host and all subdomains when the url's path starts with the rule's path. Of the fitting rules the
one with the most host labels wins, then the longest path, then block over allow. A url without a fitting rule gets
``default`` as its verdict.

Rules are broadcast as a trie only up to ``max_broadcast_rules`` rows; a longer rule table is joined instead (each
url meets the rules of its own host suffixes), with the same results.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lower_ascii

RULE_SCHEMA = "action string, host string, path string"


class UrlTrie:
    """Labels from the top-level domain inwards, then path segments; a rule's last, open segment is kept as a prefix."""

    def __init__(self, rules):
        self.root = {}
        for action, host, path in rules:
            if action not in ("allow", "block"):
                raise ValueError(f"a rule's action is allow or block, not {action!r}")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            entry = (action, host + path)
            if not path:
                ends = node.setdefault(None, {}).setdefault(None, {})
                if action == "block" or "" not in ends:
                    ends[""] = entry
                continue
            if not path.startswith("/"):
                continue  # no url path starts like that
            *full, last = path[1:].split("/")
            at = node.setdefault(None, {}).setdefault("/", {})
            for seg in full:
                at = at.setdefault(seg, {})
            open_ends = at.setdefault(None, {})
            at[0] = max(at.get(0, 0), len(last))  # a longer part of a url's segment can't be a rule's
            if action == "block" or last not in open_ends:
                open_ends[last] = entry

    @staticmethod
    def _path(paths, path):
        best = paths.get(None, {}).get("")
        at = paths.get("/")
        if at is None or not path.startswith("/"):
            return best
        segs = path[1:].split("/")
        for i, seg in enumerate(segs):
            ends = at.get(None)
            if ends:
                for k in range(min(len(seg), at[0]), -1, -1):
                    if seg[:k] in ends:
                        best = ends[seg[:k]]
                        break
            if i == len(segs) - 1 or seg not in at:
                break
            at = at[seg]
        return best

    def find(self, host, path):
        """(action, rule text) of the winning rule, or None."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._path(node[None], path) or best
        return best


def host_and_path(url):
    """Columns host and path: host after the first ``://`` up to ``/ ? #`` with A-Z lowered; both empty for null or other urls."""
    u = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(u, "://([^/?#]*)", 1)), F.regexp_extract(u, "://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules, url_col: str = "url", default: str = "allow", max_broadcast_rules: int = 200_000) -> DataFrame:
    """All rows of ``pages`` with columns host, path, rule (``host + path`` of the winning rule, or null) and verdict added.

    ``rules``: (action, host, path) tuples, or a DataFrame of them (``RULE_SCHEMA``). Null urls, urls without ``://``
    and an empty rule list give empty or unmatched results; repeated rows stay; urls of any length are read whole; an
    empty table gives an empty one. Columns of those four names in ``pages`` are replaced, others may have any name.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    parted = pages.withColumns({"host": host, "path": path})
    if isinstance(rules, DataFrame):
        if rules.limit(max_broadcast_rules + 1).count() > max_broadcast_rules:
            return _joined(parted, rules, default)
        rules = [tuple(r) for r in rules.select("action", "host", "path").collect()]
    rules = list(rules)
    if len(rules) > max_broadcast_rules:
        return _joined(parted, spark.createDataFrame(rules, RULE_SCHEMA), default)
    trie = spark.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [trie.value.find(h, p) for h, p in zip(host, path)]
        return pd.DataFrame({"rule": [f[1] if f else None for f in found], "verdict": [f[0] if f else default for f in found]}, dtype=object)

    own = fresh(parted, "judged")
    return parted.withColumn(own, judge("host", "path")).withColumns({"rule": F.col(own)["rule"], "verdict": F.col(own)["verdict"]}).drop(own)


def _joined(parted: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by an equi-join of each distinct (host, path), by host suffix and leading folders, with the rules' hosts and folders.

    Only as many labels and folders of a url are tried as the longest rules have, so rows grow with the rules' depth, not a url's length.
    """
    folder = lambda c: F.regexp_extract(c, "(?s)^(.*/)?", 0)
    slashes = lambda c: F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    rules = rules.select("action", F.col("host").alias("suffix"), F.col("path").alias("rule_path"), folder(F.col("path")).alias("folder"))
    labels_most, deepest = rules.agg(F.max(F.size(F.split("suffix", "\\."))), F.max(slashes(F.col("folder")))).first()
    urls = parted.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - F.lit((labels_most or 1) - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    folders = F.transform(F.sequence(F.lit(0), F.least(slashes(F.col("path")), F.lit(deepest or 0))), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(F.split("path", "/"), 1, i), "/"), F.lit("/"))))
    tried = urls.withColumn("suffix", F.explode(suffixes)).withColumn("folder", F.explode(folders))
    rank = F.struct(F.size(F.split("suffix", "\\.")).alias("labels"), F.length("rule_path").alias("length"), (F.col("action") == "block").alias("block"), F.concat("suffix", "rule_path").alias("rule"))
    won = fresh(parted, "won")
    best = tried.join(rules, ["suffix", "folder"]).filter(F.startswith("path", "rule_path")).groupBy("host", "path").agg(F.max(rank).alias(won))
    out = parted.drop("rule", "verdict").join(best, ["host", "path"], "left")
    verdict = F.when(F.col(won).isNull(), default).when(F.col(won)["block"], "block").otherwise("allow")
    return out.withColumns({"rule": F.col(won)["rule"], "verdict": verdict}).drop(won)


#: The rules of query op10.
OP10_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def op10_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, OP10_RULES).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost) DESC, length(rpath) DESC) AS rn
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, CASE WHEN action IS NULL THEN NULL ELSE rhost || rpath END AS rule, coalesce(action, 'allow') AS verdict
FROM m WHERE rn = 1
"""
