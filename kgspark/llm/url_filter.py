"""URL filter: a trie over reversed host labels, then path, with longest match."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: At most so many rules are sent to the tasks.
MAX_RULES = 1_000_000


def parse_rules(entries: Iterable[tuple[str, str]]) -> list[Rule]:
    """``("allow", "example.org/es/")`` becomes host ``example.org``, path ``/es/``."""
    rules = []
    for verdict, entry in entries:
        host, slash, rest = entry.partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {verdict} {entry}")
        rules.append(Rule(verdict, host.lower(), slash + rest))
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return rules


class UrlTrie:
    """Host labels from the right, each node with a trie of path segments.

    A rule's last path segment may be cut short (``/en/1`` fits ``/en/17``);
    those ends are kept at the node of the segments before it, with the length
    of the longest, beyond which no start of a segment is looked up.
    """

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root: dict = {"next": {}, "paths": None}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"next": {}, "ends": {}, "longest": 0}
            *full, last = rule.path.split("/")
            at = node["paths"]
            for segment in full:
                at = at["next"].setdefault(segment, {"next": {}, "ends": {}, "longest": 0})
            at["ends"].setdefault(last, rule)  # of equal rules the first holds
            at["longest"] = max(at["longest"], len(last))

    @staticmethod
    def _longest(paths: dict, path: str) -> Rule | None:
        best, at = None, paths
        for segment in path.split("/"):
            for k in range(min(len(segment), at["longest"]), -1, -1):
                if segment[:k] in at["ends"]:
                    best = at["ends"][segment[:k]]
                    break
            at = at["next"].get(segment)
            if at is None:
                break
        return best

    def find(self, host: str, path: str) -> Rule | None:
        """The rule with most host labels, then the longest path."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            if node["paths"] is not None:
                best = self._longest(node["paths"], path) or best
        return best


def filter_urls(pages: DataFrame, entries: Iterable[tuple[str, str]], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict for every row of ``pages``: key, host, path, rule, verdict.

    The trie is broadcast; its size is bounded by MAX_RULES.  A url that is
    null or has no ``://`` has an empty host and path, fits no rule and gets
    ``default``; so does an empty host.  Repeated rows and null keys are kept.
    Other columns of ``pages`` are not read.
    """
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(UrlTrie(parse_rules(entries)))
    # Only the ASCII letters of a host are lower-cased.
    rest = F.when(F.col(url).contains("://"), F.regexp_replace(F.regexp_replace(F.col(url), r"(?s)^.*?://", ""), r"(?s)[?#].*$", ""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_replace(rest, r"(?s)/.*$", ""), upper, lower)
    path = F.regexp_extract(rest, r"(?s)^[^/]*(/.*)?$", 1)
    parts = pages.select(F.col(key).alias(key), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trie.value
        for batch in batches:
            found = [tree.find(h, p) if h else None for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            rules = pa.array([r and r.host + r.path for r in found], pa.string())
            verdicts = pa.array([r.verdict if r else default for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch[key], batch["host"], batch["path"], rules, verdicts], names=[key, "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    return parts.mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, verdict string")
