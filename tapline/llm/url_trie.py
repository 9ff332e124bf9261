"""Allow and block rules for URLs in a trie, with longest-match precedence.

The trie is keyed by reversed host labels, then by path segments.  It is a small
table of rules (checked against ``MAX_RULES``), broadcast to every task; pages
are judged in one pass over the scan, without a shuffle.

A rule fits its host and all its subdomains if the URL's path begins with the
rule's path.  Of the rules that fit, the longest host wins, then the longest
path; the same rule given both ways counts as a block.  A URL that no rule fits
gets the method's own verdict: ``block`` if a word of its host (labels, parted
at hyphens) is one of the built-in block words, else ``allow``.

Rows: a null URL or one without ``://`` has an empty host and path and no rule;
such pages, whose source is unknown, are allowed.  Repeated rows are judged
alike; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: (verdict, host, path prefix); the fixed rule set of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Words that block a host no rule fits.
BLOCK_WORDS = frozenset({"spam", "pills", "casino", "xxx", "warez"})
#: The trie is broadcast; more rules than this are refused (about 1 GB of trie at worst).
MAX_RULES = 1_000_000


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: behind the first ``://`` up to / ? # or the end, A-Z lower-cased.  Path: from there up to ? or #."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return host.translate(_FOLD), path


_FOLD = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


class Trie:
    """Node: [children by label or segment, paths node, rules that end inside a segment]."""

    def __init__(self, rules):
        rules = list(rules)
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; the trie is broadcast, at most {MAX_RULES} are taken")
        self.hosts: dict = {}
        for verdict, host, path in rules:
            node = self.hosts
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})  # no label holds a slash
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault(("s", segment), {})
            ends = node.setdefault("ends", {})
            if ends.get(tail, (None,))[0] != "block":
                ends[tail] = (verdict, host + path)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        node, best = self.hosts, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/" in node:
                best = self._path(node["/"], path) or best
        return best

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")
        for i, segment in enumerate(segments):
            fits = [(len(t), r) for t, r in node.get("ends", {}).items() if segment.startswith(t)]
            if fits:
                best = max(fits)[1]
            if i == len(segments) - 1:
                break
            node = node.get(("s", segment))
            if node is None:
                break
        return best


def own_verdict(host: str) -> str:
    """The method's verdict where no rule fits."""
    return "block" if BLOCK_WORDS.intersection(host.replace("-", ".").split(".")) else "allow"


def judge(pages: DataFrame, rules=RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict."""
    shipped = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    id_type = pages.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shipped.value
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column(1).to_pylist()]
            found = [trie.match(h, p) for h, p in parts]
            verdicts = [f[0] if f else own_verdict(h) for f, (h, _) in zip(found, parts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                 pa.array([f[1] if f else None for f in found], pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(id_column, url_column).mapInArrow(
        run, f"page_id {id_type}, host string, path string, rule string, verdict string")
