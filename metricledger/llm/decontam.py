"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of letters and digits, in lower case; a shingle is five words (of an item with fewer words, the whole item).
Over every document slide windows with as many words as each benchmark item has. The SimHash of a window (128 bits, each
shingle weighted by how often it occurs) is looked up in a multi-index over the items' SimHashes: 16 blocks of 8
bits, each found with up to one bit off. By the pigeonhole principle that finds *every* fingerprint within 31 bits. What is found and
within the radius is verified by the exact weighted Jaccard similarity of the shingles, which has to reach 0.8.

Windows of which more than half the shingles occur nowhere in the benchmark are below similarity 0.8 (below 1/3) with every item, so
they are not fingerprinted. All others are, whatever items their shingles come from.
At similarity 0.8 two fingerprints differ in 19 of 128 bits on average, with a deviation of 4: the radius is three deviations wider.

The benchmark is taken in blocks of bounded size, each sent to all tasks; documents are only mapped, never shuffled.

* Null and empty texts and items match nothing. Items of equal text are all reported.
* Repeated rows of a document give one row for each item.
* Very long texts are fingerprinted in stretches around the shingles they share with the benchmark.
* An empty benchmark or table gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricledger.llm.common import batches_from, by_size, handed_back, parts_for, rows_of, texts, with_rows, written

SHINGLE_WORDS = 5
LEAST_SIMILARITY = 0.8
BITS, BLOCK_BITS = 128, 8
BLOCKS = BITS // BLOCK_BITS
#: One bit off in each block is looked up: pigeonhole gives this radius.
RADIUS = 2 * BLOCKS - 1
#: Bytes of benchmark text sent to the tasks at once.
BENCHMARK_BYTES = 32 << 20
#: Shingles fingerprinted together.
STRETCH = 4_096
_WORD = re.compile(r"[^\W_]+")
_FIRST_VALUE = np.arange(BLOCKS) * 256
_NEAR = np.array([v ^ m for v in range(256) for m in (0, 1, 2, 4, 8, 16, 32, 64, 128)], np.uint8).reshape(256, 9)


def lowered(text: str) -> str:
    """Lower case, every character still at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(lowered(text or ""))


def word_hashes(words: list[str]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return _mixed(out)


def _bit_rows(s: np.ndarray) -> np.ndarray:
    both = np.stack([_mixed(s + np.uint64(0x632BE59BD9B4E019)), _mixed(s ^ np.uint64(0xA0761D6478BD642F))], 1)
    return np.unpackbits(both.view(np.uint8), axis=1)


def simhashes(s: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """(windows, 16 bytes): the SimHash of the ``width`` shingles from each start."""
    sums = np.zeros((len(s) + 1, BITS), np.int32)
    np.cumsum(_bit_rows(s), axis=0, out=sums[1:])
    return np.packbits(2 * (sums[starts + width] - sums[starts]) > width, axis=1)


@dataclass
class _Sized:
    """Items of one number of words, with the multi-index over their fingerprints."""

    width: int  # shingles in an item
    items: list[int]
    counts: list[Counter]
    prints: np.ndarray
    #: where the items of each block value begin among the owners, block after block
    bounds: np.ndarray = field(init=False)
    owners: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        values = (_NEAR[self.prints].astype(np.int64) + _FIRST_VALUE[None, :, None]).ravel()
        owners = np.repeat(np.arange(len(self.items)), BLOCKS * 9)
        order = np.argsort(values, kind="stable")
        self.bounds, self.owners = np.searchsorted(values[order], np.arange(256 * BLOCKS + 1)), owners[order]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for all pairs within the radius."""
        value = (prints + _FIRST_VALUE).ravel()
        first, n = self.bounds[value], self.bounds[value + 1] - self.bounds[value]
        window = np.repeat(np.arange(len(value)) // BLOCKS, n)
        at = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        pairs = np.unique(window * len(self.items) + self.owners[at])
        window, item = pairs // len(self.items), pairs % len(self.items)
        near = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1) <= RADIUS
        return window[near], item[near]


class Benchmark:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if words:
                by_size.setdefault(len(words), []).append((item_id, shingles(word_hashes(words), min(SHINGLE_WORDS, len(words)))))
        self.sized: dict[int, _Sized] = {}
        known: dict[int, list[np.ndarray]] = {}
        for size, rows in sorted(by_size.items()):
            width = len(rows[0][1])
            prints = np.concatenate([simhashes(s, np.array([0]), width) for _, s in rows])
            self.sized[size] = _Sized(width, [i for i, _ in rows], [Counter(s.tolist()) for _, s in rows], prints)
            known.setdefault(min(SHINGLE_WORDS, size), []).extend(s for _, s in rows)
        #: by words in a shingle: the hashes, and a table of their top 20 bits
        self.known = {}
        for k, parts in known.items():
            hashes = np.unique(np.concatenate(parts))
            table = np.zeros(1 << 20, bool)
            table[hashes >> np.uint64(44)] = True
            self.known[k] = hashes, table

    def _hits(self, s: np.ndarray, k: int) -> np.ndarray:
        hashes, table = self.known[k]
        may = np.flatnonzero(table[s >> np.uint64(44)])
        if not len(may):
            return may
        at = np.minimum(np.searchsorted(hashes, s[may]), len(hashes) - 1)
        return may[hashes[at] == s[may]]

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int, float]]:
        """item, first word, words, differing bits, similarity of every window that reaches the similarity."""
        hashes = word_hashes(words_of(text))
        for k in self.known:
            s = shingles(hashes, k)
            hits = self._hits(s, k)
            if len(hits):
                for size, sized in self.sized.items():
                    if min(SHINGLE_WORDS, size) == k and sized.width <= len(s):
                        yield from self._windows(s, hits, size, sized)

    @staticmethod
    def _windows(s: np.ndarray, hits: np.ndarray, size: int, sized: _Sized) -> Iterator[tuple[int, int, int, int, float]]:
        w, last = sized.width, len(s) - sized.width
        held = np.zeros(len(s) + 1, np.int32)
        held[hits + 1] = 1
        held = np.cumsum(held)
        starts = np.flatnonzero(2 * (held[w:] - held[: last + 1]) >= w)
        while len(starts):
            here = starts[: np.searchsorted(starts, starts[0] + STRETCH)]
            starts = starts[len(here) :]
            base = here[0]
            stretch = s[base : here[-1] + w]
            prints = simhashes(stretch, here - base, w)
            for window, item in zip(*sized.candidates(prints), strict=True):
                at = int(here[window])
                mine = Counter(s[at : at + w].tolist())
                shared = (mine & sized.counts[item]).total()
                similarity = shared / (2 * w - shared)
                if similarity >= LEAST_SIMILARITY:
                    yield sized.items[item], at, size, int(np.bitwise_count(prints[window] ^ sized.prints[item]).sum()), similarity


@lru_cache(maxsize=1)
def index_of(sent: Broadcast) -> Benchmark:
    """One for each Python worker, which serves many tasks: a worker keeps one object for a broadcast."""
    return Benchmark(sent.value)


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str | None]]]:
    items = texts(benchmark, item, text).where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = parts_for(size, BENCHMARK_BYTES)
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == i).collect()
        if rows:
            yield [(r["doc_id"], r["text"]) for r in sorted(rows)]


def leaks(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, n_words, start_char, end_char, bits_off, similarity, windows, passage.

    One row for each document and item: its most similar window (of equal ones the first), and how many windows reach
    the similarity.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("bits_off", pa.int32()), ("similarity", pa.float64()), ("windows", pa.int64()), ("passage", pa.string())]
    )
    ddl = "doc_id long, item_id long, start_word long, n_words int, start_char long, end_char long, bits_off int, similarity double, windows long, passage string"
    spark = docs.sparkSession
    rows = texts(docs).where("text IS NOT NULL")
    found = spark.createDataFrame([], ddl)
    for block in _blocks(benchmark, item, text):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = index_of(sent)

            def rows() -> Iterator[tuple]:
                for b in batches:
                    for doc_id, doc in rows_of(b, "doc_id", "text"):
                        best: dict[int, tuple] = {}
                        n: Counter = Counter()
                        for item_id, at, size, off, similarity in known.matches(doc):
                            n[item_id] += 1
                            best[item_id] = max(best.get(item_id, (0.0, 0, 0, 0)), (similarity, -at, size, off))
                        if best:
                            spans = [m.span() for m in _WORD.finditer(lowered(doc))]
                            for item_id, (similarity, at, size, off) in best.items():
                                begin, end = spans[-at][0], spans[size - at - 1][1]
                                yield doc_id, item_id, -at, size, begin, end, off, similarity, n[item_id], doc[begin:end]

            yield from batches_from(rows(), schema)

        found = found.unionByName(rows.mapInArrow(handed_back(run), ddl))
    order = F.struct(F.col("similarity"), -F.col("start_word"), F.struct(*(c for c in found.columns if c not in ("doc_id", "item_id"))))
    best = found.groupBy("doc_id", "item_id").agg(F.max(order).alias("best"))
    return best.select("doc_id", "item_id", *(f"best.col3.{c}" for c in found.columns if c not in ("doc_id", "item_id")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they were. Rows with a null doc_id are judged by a place of their own."""
    row = "_decontam_row"
    numbered = with_rows(docs, row)
    found = leaks(numbered.select(F.col(row).alias("doc_id"), "text"), benchmark)
    dirty = written(found.select(F.col("doc_id").alias(row)).distinct(), "leaks")
    return numbered.join(by_size(dirty), row, "left_anti").drop(row)
