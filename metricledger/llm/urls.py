"""URL filter: one bit-parallel wildcard automaton for all rules.

A canonical URL is ``.`` + host + ``/`` + path, so that ``.`` begins every domain label and the first ``/`` ends the host. A
rule is a glob over it: ``*`` stands for any run of bytes without ``/``, ``**`` for any run of bytes. All globs are packed into
one multiword Shift-And automaton: a bit for each position of each glob, a mask of positions for each byte, and a mask
of self-loops for the wildcards. One step over a byte moves all globs at once, and numpy takes that step for all URLs of a
block at once. Of the globs that match, the one with the highest priority decides; without any the default verdict holds.

* Null URLs and such without ``://``: host and path are empty, no rule fits, the default verdict holds.
* Hosts are compared with A-Z in lower case; paths as they are.
* Very long URLs are stepped in blocks of few: a block holds at most ``BLOCK_BYTES`` padded bytes, or one URL.
* Rows are kept one to one, repeated ones as well. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: URLs stepped together, after sorting a batch by length, and the bytes that they take when padded to the longest.
BLOCK, BLOCK_BYTES = 2_048, 1 << 22
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str | None
    glob: str
    verdict: str
    priority: int


def scoped_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, all its subdomains and a path prefix. The longer the rule, the higher its priority."""
    return Rule(host + path, f"*.{host}/{path}**", verdict, 1_000 + len(host + path))


def host_glob(verdict: str, pattern: str) -> Rule:
    """A nameless rule over hosts, below all scoped ones: ``*pills*`` fits every host with ``pills`` in it."""
    return Rule(None, f"{pattern}/**", verdict, 0)


#: The contract's rules, and the globs that give a verdict where none of them fits.
RULES = (
    scoped_rule("block", "net", "/"),
    scoped_rule("allow", "example.net", "/en/"),
    scoped_rule("block", "example.com", "/de/"),
    scoped_rule("allow", "org", "/fr/"),
    host_glob("block", "*spam*"),
    host_glob("block", "*cheap*pill*"),
    host_glob("block", "*casino*"),
)


def blocks(lengths: Sequence[int]) -> Iterator[list[int]]:
    """Places of the lengths in blocks of similar ones, shortest first."""
    held: list[int] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if held and (len(held) == BLOCK or (len(held) + 1) * lengths[i] > BLOCK_BYTES):
            yield held
            held = []
        held.append(i)
    if held:
        yield held


class Automaton:
    """Masks of all globs. ``loops[b]`` holds the positions that may stay on byte ``b``, ``moves[b]`` those entered by it."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        moves: list[set[int]] = [set() for _ in range(256)]
        loops: list[set[int]] = [set() for _ in range(256)]
        first, last, at = [], [], 0
        for rule in rules:
            first.append(at)
            for part in re.findall(rb"\*+|[^*]", rule.glob.encode(), re.S):
                if part[:1] == b"*":
                    for b in range(256):
                        if len(part) > 1 or b != ord("/"):
                            loops[b].add(at)
                else:
                    at += 1
                    moves[part[0]].add(at)
            last.append(at)
            at += 1
        self.words = -(-at // 64)
        self.moves, self.loops = self._pack(moves), self._pack(loops)
        self.start = self._pack([set(first)])[0]
        # no bit may cross from one glob into the next: position 0 of a glob is never entered
        self.last = last

    def _pack(self, sets: Sequence[set[int]]) -> np.ndarray:
        out = np.zeros((len(sets), self.words), np.uint64)
        for i, positions in enumerate(sets):
            for p in positions:
                out[i, p // 64] |= np.uint64(1 << (p % 64))
        return out

    def _block(self, urls: list[bytes]) -> np.ndarray:
        """(URLs, globs): which globs fit."""
        lengths = np.array([len(u) for u in urls])
        width = int(lengths.max(initial=0))
        codes = np.zeros((len(urls), width), np.uint8)
        flat = np.frombuffer(b"".join(urls), np.uint8)
        codes[np.arange(width) < lengths[:, None]] = flat
        state = np.repeat(self.start[None, :], len(urls), 0)
        one, top = np.uint64(1), np.uint64(63)
        for i in range(width):
            live = np.flatnonzero(lengths > i)
            now, byte = state[live], codes[live, i]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[live] = (shifted & self.moves[byte]) | (now & self.loops[byte])
        return np.stack([(state[:, p // 64] >> np.uint64(p % 64)) & one for p in self.last], 1).astype(bool)

    def match(self, urls: list[bytes]) -> np.ndarray:
        out = np.zeros((len(urls), len(self.last)), bool)
        if not self.last:
            return out
        for block in blocks([len(u) for u in urls]):
            out[block] = self._block([urls[j] for j in block])
        return out


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, verdict of every row."""
    ordered = sorted(rules, key=lambda r: -r.priority)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(ordered)
        names = [r.name for r in ordered] + [None]
        verdicts = [r.verdict for r in ordered] + [default]
        for b in batches:
            ids, links, hosts, paths = (b.column(i) for i in range(4))
            canonical = [f".{h}/{p}".encode() if h or p else b"" for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            fits = automaton.match(canonical)
            best = np.where(fits.any(1), fits.argmax(1), len(ordered)) if len(ordered) else np.zeros(len(canonical), int)
            yield pa.RecordBatch.from_arrays([ids, links, hosts, paths, pa.array([names[i] for i in best], pa.string()), pa.array([verdicts[i] for i in best], pa.string())], schema=schema)

    link = F.col(url).cast("string")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), link.alias("url"), host_of(link).alias("host"), path_of(link).alias("path"))
    return rows.mapInArrow(run, "page_id long, url string, host string, path string, rule string, verdict string")
