"""URL filters by host and path prefix, as a sort-merge range join.

A host becomes its labels in reverse, each followed by a dot (``a.example.org`` is ``org.example.a.``). All hosts at or below a rule's host
then start with the rule's key, so the rule is an interval of keys, and intervals nest or are disjoint. Each partition sorts its own URLs
by key and path and sweeps once over URLs and rules, keeping a stack of the rule hosts whose interval holds the current key. The paths of a
rule host are intervals of paths in the same way: sorted, each with the longest other one that it starts with. The last path that is not
behind the URL's, or the nearest of those it starts with that the URL's path starts with too, is the longest that fits: one binary search
for each open host, however many rules it has. The longest host and path wins; of equally long ones the longer host, then ``block``.

The URLs are never shuffled, so a host with a third of all rows is as good as any. Rules are dealt by host and path into blocks of about
``block_chars``, so that even the rules of one host may be many blocks; ``TOGETHER`` of them at a time go to the executors, and each
block's sweep improves on the best rule so far.

A null url, or one without ``://``, has an empty host and path. No fitting rule gives a null ``rule`` and the verdict ``default``. Rules
with a null host or path count as empty there; an empty host fits every host. Of rules with one host and path, ``block`` counts before any
other verdict and otherwise the first in the alphabet; one without a verdict is no rule. Repeated rows are judged alike; empty tables are
fine. Kept columns may have any names (see ``columns``).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.llm.columns import Kept, named
from quireline.llm.storage import written

#: Characters of rules in a block, and blocks that one pass over the URLs holds.
BLOCK_CHARS, TOGETHER = 16 << 20, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def reversed_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def key_of(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


def _order(text: str) -> bytes:
    """Spark sorts strings by their UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass")


def strength(host: str, path: str, verdict: str) -> tuple:
    return (len(host) + len(path), len(host), verdict == "block", path)


class Paths:
    """The rules of one host: paths in order, their verdicts, and for each the place of the longest other path that it starts with."""

    def __init__(self, host: str, rules: dict[str, str]):
        self.host, self.paths = host, sorted(rules)
        self.verdicts, self.outer, nested = [rules[p] for p in self.paths], [], []
        for i, path in enumerate(self.paths):
            while nested and not path.startswith(self.paths[nested[-1]]):
                nested.pop()
            self.outer.append(nested[-1] if nested else -1)
            nested.append(i)

    def longest(self, path: str) -> int:
        """Place of the longest path that ``path`` starts with, or -1."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return at


def _sweep(rules):
    """One block's pass over batches (..., rkey, path, rule_host, rule_path, verdict) in the order of rkey."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts = rules.value
        stack: list[tuple[str, Paths]] = []
        upcoming = 0
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out = [column[n].to_pylist() for n in ("rule_host", "rule_path", "verdict")]
            for row, (key, path) in enumerate(zip(column["rkey"].to_pylist(), column["path"].to_pylist(), strict=True)):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                here = _order(key)
                while upcoming < len(hosts) and hosts[upcoming][0] <= here:
                    opened = hosts[upcoming][1]
                    if key.startswith(opened):
                        stack.append((opened, hosts[upcoming][2]))
                    upcoming += 1
                best = (strength(out[0][row], out[1][row], out[2][row]), out[0][row], out[1][row], out[2][row]) if out[0][row] is not None else None
                for _, own in stack:
                    at = own.longest(path)
                    if at >= 0:
                        found = (own.host, own.paths[at], own.verdicts[at])
                        if best is None or strength(*found) > best[0]:
                            best = (strength(*found), *found)
                if best is not None:
                    out[0][row], out[1][row], out[2][row] = best[1:]
            column |= {n: pa.array(v, pa.string()) for n, v in zip(("rule_host", "rule_path", "verdict"), out, strict=True)}
            yield pa.RecordBatch.from_arrays([column[n] for n in batch.schema.names], names=batch.schema.names)

    return run


def _block(rows) -> list[tuple[bytes, str, Paths]]:
    """(sort key, key, rules of this host) in sweep order."""
    by_host: dict[str, dict[str, str]] = {}
    for r in rows:
        by_host.setdefault(r.host, {})[r.path] = r.verdict
    return sorted(((_order(key_of(h)), key_of(h), Paths(h, own)) for h, own in by_host.items()), key=lambda x: x[0])


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns ``keep``, ``host``, ``path``, ``rule`` (host and path of the rule, or null) and ``verdict``. ``rules``: host, path, verdict."""
    spark = pages.sparkSession
    held = rules.select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict"))
    held = held.filter("verdict IS NOT NULL").groupBy("host", "path").agg(F.min_by("verdict", F.struct(F.col("verdict") != "block", "verdict")).alias("verdict"))
    chars = held.agg(F.sum(F.length("host") + F.length("path") + 8)).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    if blocks > 1:
        held = written(held, "url-rules")
    none = F.lit(None).cast("string")
    kept = Kept(keep, ("host", "path", "rule", "verdict"))
    host = host_of(named(url))
    out = pages.select(*kept.held(), host.alias("host"), path_of(named(url)).alias("path"), reversed_key(host).alias("rkey"), none.alias("rule_host"), none.alias("rule_path"), none.alias("verdict"))
    for block in range(blocks):
        if block and block % TOGETHER == 0:
            out = written(out, "url-blocks")
        if block % TOGETHER == 0:
            out = out.sortWithinPartitions("rkey")
        own = spark.sparkContext.broadcast(_block(held.filter(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == block).collect()))
        out = out.mapInArrow(_sweep(own), out.schema)
    return out.select(*kept.back(), "host", "path", F.concat("rule_host", "rule_path").alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"))


def brute_force(url: str | None, rules: list[tuple[str, str, str]], default: str = "allow") -> tuple:
    """(host, path, rule, verdict) by trying every rule."""
    import re

    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1].translate(str.maketrans(_UPPER, _LOWER)), found[2]) if found else ("", "")
    fits = [r for r in rules if (not r[0] or host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: strength(*r), default=None)
    return (host, path, best and best[0] + best[1], best[2] if best else default)
