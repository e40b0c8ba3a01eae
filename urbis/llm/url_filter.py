"""URL filter: a trie over reversed host labels and path segments, with longest-match precedence.

A rule is (host, path prefix, verdict). It fits its host and every subdomain if the url's path starts
with the rule's path. Of the rules that fit, the one with the most host labels wins, then the one with
the longest path; of equal rules the first listed wins. Without a fitting rule the verdict is `default`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are broadcast; a longer list is refused rather than sent to every executor.
MAX_RULES = 2_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class RuleTrie:
    """Nodes are dicts; "" holds a host node's path trie, None a path node's list of (rest, name, verdict)."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for count, (host, path, verdict) in enumerate(rules, 1):
            if count > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("", {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, [])
            if all(rest != known for known, _, _ in ends):
                ends.append((rest, host + path, verdict))

    @staticmethod
    def _by_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        found, last = None, len(segments) - 1
        for depth, segment in enumerate(segments):
            fits = [e for e in node.get(None, ()) if segment.startswith(e[0])]
            if fits:
                found = max(fits, key=lambda e: len(e[0]))[1:]
            if depth == last or segment not in node:
                break
            node = node[segment]
        return found

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, else None."""
        found, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            if not label or label not in node:
                break
            node = node[label]
            if "" in node:
                found = self._by_path(node[""], segments) or found
        return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path of a url; both empty without "://" or for null."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (null without one), verdict.

    Null or malformed urls have empty host and path and get the default verdict. Repeated rows are
    judged alike, other columns are ignored, an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(RuleTrie(rules))
    host, path = host_and_path(F.col(url_col))
    slim = df.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo = shared.value, {}
        for batch in batches:
            named, verdicts = [], []
            for key in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key not in memo:
                    if len(memo) >= 100_000:
                        memo.clear()
                    memo[key] = trie.judge(*key) or (None, default)
                rule, verdict = memo[key]
                named.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named, pa.string()), pa.array(verdicts, pa.string())], [*batch.schema.names, "rule", "verdict"])

    schema = f"`{id_col}` {slim.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return slim.mapInArrow(judge, schema)
