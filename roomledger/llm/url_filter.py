"""URL filters: a trie over reversed host labels, then over path segments.

A rule (host, path, verdict) fits its host and all subdomains of it, for URLs
whose path starts with the rule's path.  Of the rules that fit, the one with
the longest host wins, among those the one with the longest path; of equal
rules with both verdicts, block.  URLs that no rule fits get ``default``.

Rules go to the tasks as tries of at most ``BLOCK_CHARS`` characters each; a
longer list is handled block after block, each keeping the best match so far.

Defined results: host and path are empty (and only ``default`` applies) for a
null URL or one without ``://``; an empty table gives an empty result;
repeated rows give repeated results; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roomledger.llm.common import unused, with_fields

BLOCK_CHARS = 16_000_000
LOWER = {c: c + 32 for c in range(65, 91)}  # A-Z only
HOST = re.compile(r"[^/?#]*")
PATH = re.compile(r"[^?#]*")


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def parts(url: str | None) -> tuple[str, str]:
    """Lower-cased host, and path."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host = HOST.match(url, at + 3)
    return host[0].translate(LOWER), PATH.match(url, host.end())[0]


def segments(path: str) -> list[str]:
    """The path cut after each slash; the last part has none, or is empty."""
    out = [s + "/" for s in path.split("/")]
    out[-1] = out[-1][:-1]
    return out


class Node:
    """``next``: child by host label or by segment with its slash; ``path``: root of
    a host's path trie; ``starts``: rules whose path ends within a segment; ``rule``:
    the rule that ends here."""

    __slots__ = ("next", "path", "starts", "rule")

    def __init__(self):
        self.next: dict[str, Node] = {}
        self.path: Node | None = None
        self.starts: dict[str, Rule] = {}
        self.rule: Rule | None = None


def build(rules: Iterable[Rule]) -> Node:
    root = Node()
    for rule in rules:
        node = root
        for label in reversed(rule.host.translate(LOWER).split(".")):
            node = node.next.setdefault(label, Node())
        node.path = node = node.path or Node()
        *whole, last = segments(rule.path)
        for s in whole:
            node = node.next.setdefault(s, Node())
        old = node.starts.get(last) if last else node.rule
        new = old if old is not None and old.verdict == "block" else rule
        if last:
            node.starts[last] = new
        else:
            node.rule = new
    return root


def longest(root: Node, host: str, path: str) -> Rule | None:
    node, hosts = root, []
    for label in reversed(host.split(".")):
        node = node.next.get(label)
        if node is None:
            break
        if node.path is not None:
            hosts.append(node.path)
    cut = segments(path)
    for node in reversed(hosts):
        best = None
        for s in cut:
            best = node.rule or best
            fits = [p for p in node.starts if s.startswith(p)] if node.starts else ()
            if fits:
                best = node.starts[max(fits, key=len)]
            node = node.next.get(s)
            if node is None:
                break
        else:
            best = node.rule or best
        if best is not None:
            return best
    return None


def blocks(rules: Iterable[Rule]) -> Iterator[list[Rule]]:
    some, chars = [], 0
    for rule in rules:
        some.append(rule)
        chars += len(rule.host) + len(rule.path)
        if chars >= BLOCK_CHARS:
            yield some
            some, chars = [], 0
    if some:
        yield some


def judge(pages: DataFrame, rules: Iterable[Rule], default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the one that
    decides, else null) and ``verdict``; names taken get underscores before them."""
    names = unused(pages, "host", "path", "rule", "verdict")
    schema = with_fields(pages, **dict.fromkeys(names, T.StringType()))
    out, own, fields = pages, len(pages.columns), schema.names

    def step(trie: Node, first: bool):
        def run(batches):
            for batch in batches:
                old = [None] * batch.num_rows if first else [
                    None if r is None else Rule(*key(r), v) for r, v in zip(
                        batch.column(names[2]).to_pylist(), batch.column(names[3]).to_pylist())]
                cut = [parts(u) for u in batch.column("url").to_pylist()]
                got = [better(o, longest(trie, h, p)) for o, (h, p) in zip(old, cut)]
                mine = [[h for h, _ in cut], [p for _, p in cut], [None if r is None else r.host + r.path for r in got],
                        [default if r is None else r.verdict for r in got]]
                columns = batch.columns[:own] + [pa.array(x, pa.string()) for x in mine]
                yield pa.RecordBatch.from_arrays(columns, names=fields)
        return run

    for k, some in enumerate(list(blocks(rules)) or [[]]):
        out = out.mapInArrow(step(build(some), k == 0), schema)
    return out


def key(rule: str) -> tuple[str, str]:
    at = rule.find("/")
    return (rule, "") if at < 0 else (rule[:at], rule[at:])


def better(a: Rule | None, b: Rule | None) -> Rule | None:
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda r: (len(r.host), len(r.path), r.verdict == "block"))
