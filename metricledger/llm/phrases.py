"""Phrase collocation mining by sampling (Toivonen).

Texts are lower-cased in A-Z and split into pieces at punctuation and line ends, pieces into words. A phrase is 2 to ``MOST_WORDS`` words that follow
each other in a piece. What is looked for is every phrase that a language has ``SUPPORT`` times or more, with exact counts.

*Sample.* A share of the documents, chosen by hash, is mined level by level with a lowered threshold: it proposes words and phrases.

*Full pass.* All documents are read, and every run of words is counted both of whose parts (all but the last word, all but the first) were proposed: the
proposed ones and their negative border, as far as it occurs at all. The border is large, nearly all of it rare: so the pass counts by hash, and no run is
taken for rarer than it is. Runs whose count reaches the support are marked.

*Closing pass.* All documents are read again. Marked runs are counted by their words. Where a marked run was not proposed the border has failed: runs over it have not
been counted yet. This pass admits them, and whatever longer runs these admit in turn, and counts them by their words as well; so it
closes the border at all levels at once. No phrase is missed and every count is exact, whatever the sample held and however hashes collide.

*Memory.* Proposals and marks are sent to the tasks as bitmaps of hashed runs of fixed size (``CELLS`` bits, 16 MB each). Two runs that share a bit cost a superfluous
count, never a wrong one. Tasks count about a million words at a time and hand on what they have: hashes packed into a few rows, so a hot word or
phrase is one entry of each load. Ranking takes the best of each of 64 parts of a language first.

* Null texts count as empty, null languages as ``und``. Repeated rows count each time.
* Texts of any length are read whole, in windows; words are any bytes but blanks, tabs and the separators.
* Ties in score and count are ordered by the phrase's UTF-8 bytes. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricledger.llm.common import batches_from, handed_back, slices, written

MOST_WORDS, SUPPORT, OVERLAP_PCT, BEST, SCALE = 4, 30, 80, 2_000, 2_000_000
#: Share of the documents in the sample, and how much of its share of the support makes a proposal there.
SAMPLE, LOWERED = 0.2, 0.5
CELLS = 1 << 27
#: Words counted at once in a task.
LOAD = 1_000_000
_WINDOW = 1 << 20
_BREAK = b"\xff"  # in no UTF-8 text
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _BREAK * 10 + b" ")
_BY_WORDS = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
_PACKED = pa.schema([("slice", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
#: Bits of a hash that are packed, below those that name its slice.
_KEPT = 40
#: Bytes of text for each slice of the hashes, and the least and the most slices, as powers of 2.
SLICE_BYTES, _SLICES = 1 << 25, (6, 14)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Proposals:
    """Runs of words by hash, as a bitmap."""

    def __init__(self, bits: np.ndarray | None = None) -> None:
        self.bits = np.zeros(CELLS // 8, np.uint8) if bits is None else bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - CELLS.bit_length() + 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def with_runs(self, runs: DataFrame) -> Proposals:
        """``runs``: a column hash. What reaches the driver is at most the bitmap."""
        cell = F.shiftrightunsigned("hash", 64 - CELLS.bit_length() + 1) + 1
        parts = runs.groupBy(F.bitmap_bucket_number(cell).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits"))
        bits = self.bits.copy()
        for r in parts.toLocalIterator():
            data = np.frombuffer(bytes(r["bits"]), np.uint8)
            at = (r["part"] - 1) * len(data)
            bits[at : at + len(data)] |= data[: len(bits) - at]
        return Proposals(bits)


class _Load:
    """Words of many texts as numbers; 0 stands between pieces."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids, self.next = array("i"), count(1)
        self.known: dict[str, defaultdict] = {}

    def add(self, lang: str, text: bytes) -> Iterator[None]:
        """Yields at places between pieces where the load is to be counted and cleared."""
        at, data = 0, text.lower().translate(_PIECES).replace(_BREAK, b" \xff ")
        while at < len(data):
            end = data.find(b" ", at + _WINDOW)
            end = len(data) if end < 0 else end
            if lang not in self.known:
                self.known[lang] = defaultdict(self.next.__next__, {_BREAK: 0})
            self.ids.extend(map(self.known[lang].__getitem__, data[at:end].split()))
            at = end
            if at < len(data) and len(self.ids) >= LOAD and not self.ids[-1]:
                yield
        self.ids.append(0)

    def levels(self, most: int, now: Proposals, before: Proposals | None = None) -> Iterator[_Level]:
        """Runs of 1, 2, ... words whose parts are held. Held is what ``now`` holds, and what was not admitted ``before``."""
        run = np.frombuffer(self.ids, np.int32).astype(np.int64)
        words = sorted(((i, lang, word) for lang, known in self.known.items() for word, i in known.items() if i), key=lambda w: w[0])
        seeds = {lang: xxhash.xxh64_intdigest(lang) for lang in self.known}
        names, langs = [b"", *(w for _, _, w in words)], ["", *(lang for _, lang, _ in words)]
        word_hash = np.fromiter((xxhash.xxh64_intdigest(w, seeds[lang]) for _, lang, w in words), np.uint64, len(words))
        word_hash = np.concatenate([np.zeros(1, np.uint64), word_hash])
        # place[i]: number of the run of k words that begins at i; runs are numbered from 1, 0 is none
        place, hashes, n = run, word_hash, np.bincount(run, minlength=len(names))
        first, admitted_before = np.zeros(len(names), np.int64), np.ones(len(names), bool)
        for k in range(1, most + 1):
            if k > 1:
                starts = np.flatnonzero(held[place[:-1]] & held[place[1:]])
                if not len(starts):
                    return
                last = run[starts + k - 1]
                _, at, number, n = np.unique(place[starts] * len(names) + last, return_index=True, return_inverse=True, return_counts=True)
                first, n = np.concatenate([[0], starts[at]]), np.concatenate([[0], n])
                mixed = _mixed(hashes[place[first]] * np.uint64(0x9E3779B97F4A7C15) + word_hash[run[first + k - 1]] + np.uint64(k))
                if before:
                    admitted_before = member[place[first]] & member[place[first + 1]]
                place = np.zeros(len(run), np.int64)
                place[starts] = number + 1
                hashes = mixed
            held = now.holds(hashes)
            if before:
                held |= ~admitted_before
                member = before.holds(hashes) & admitted_before
            held[0] = False
            yield _Level(k, hashes, n, held, first, run, names, langs)

    def totals(self) -> pa.RecordBatch:
        """How many words each language has."""
        n = np.bincount(np.frombuffer(self.ids, np.int32))
        rows = [{"lang": lang, "words": 0, "phrase": "", "f": int(n[[i for i in known.values() if i]].sum())} for lang, known in self.known.items()]
        return pa.RecordBatch.from_pylist(rows, schema=_BY_WORDS)


@dataclass
class _Level:
    """Runs of k words by number; entry 0 is none."""

    k: int
    hashes: np.ndarray
    n: np.ndarray
    held: np.ndarray
    first: np.ndarray
    run: np.ndarray
    names: list
    langs: list

    def by_words(self) -> Iterator[pa.RecordBatch]:
        """The runs that are held, with their counts."""
        held = np.flatnonzero(self.held)
        for at in range(0, len(held), 65_536):
            part = held[at : at + 65_536]
            own = [part.tolist()] if self.k == 1 else [self.run[self.first[part] + j].tolist() for j in range(self.k)]
            phrases = [b" ".join(w) for w in zip(*([self.names[i] for i in o] for o in own), strict=True)]
            columns = [
                pa.array([self.langs[i] for i in own[0]], pa.string()),
                pa.array(np.full(len(part), self.k, np.int32)),
                pa.array(phrases, pa.binary()).cast(pa.string()),
                pa.array(self.n[part].astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_BY_WORDS)


def _packed(levels: list[_Level], bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """Hashes and counts (up to ``most``) of all runs of the levels, a row for each slice of the hashes."""
    hashes = np.concatenate([level.hashes[1:] for level in levels]) >> np.uint64(64 - _KEPT - bits)
    n = np.minimum(np.concatenate([level.n[1:] for level in levels]), most).astype(_count_type(most))
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    ends = np.searchsorted(hashes, np.arange(1, (1 << bits) + 1, dtype=np.uint64) << np.uint64(_KEPT))
    rows, start = [], 0
    for part, end in enumerate(ends.tolist()):
        if end > start:
            rows.append((part, hashes[start:end].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _KEPT // 8].tobytes(), n[start:end].tobytes()))
            start = end
    yield from batches_from(rows, _PACKED, 256)


def _count_type(most: int) -> type:
    return np.uint8 if most < 256 else np.uint32


def _frequent_hashes(packed: DataFrame, bits: int, least: int) -> DataFrame:
    """hash of all runs that are counted ``least`` times or more; a task holds a slice of the hashes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        known, n = b"".join(table.column("hashes").to_pylist()), b"".join(table.column("counts").to_pylist())
        width = _KEPT // 8
        hashes = np.zeros((len(known) // width, 8), np.uint8)
        hashes[:, :width] = np.frombuffer(known, np.uint8).reshape(-1, width)
        hashes = hashes.view("<u8").ravel()
        order = np.argsort(hashes)
        hashes, n = hashes[order], np.frombuffer(n, _count_type(least))[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        found = hashes[starts[np.add.reduceat(n, starts) >= least]].astype(np.uint64)
        whole = (np.uint64(key[0].as_py()) << np.uint64(_KEPT) | found) << np.uint64(64 - _KEPT - bits)
        return pa.table({"hash": pa.array(whole.view(np.int64))})

    return packed.groupBy("slice").applyInArrow(run, "hash long")


def _over_loads(docs: DataFrame, each: Callable[[_Load], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """What ``each`` makes of the loads of all documents. ``docs``: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _Load()
        for b in batches:
            for part in slices(b, 64):
                langs, data = part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()
                for lang, text in zip(langs, data, strict=True):
                    for _ in load.add(lang, text or b""):
                        yield from each(load)
                        load.clear()
                if len(load.ids) >= LOAD:
                    yield from each(load)
                    load.clear()
        if load.known:
            yield from each(load)

    return docs.mapInArrow(handed_back(run), ddl)


def marked(docs: DataFrame, lengths: range, now: Proposals, bits: int, least: int) -> DataFrame:
    """hash of the runs of those lengths that ``now`` admits and that may be there ``least`` times: all that are, and hardly any others."""
    sent = docs.sparkSession.sparkContext.broadcast(now)

    def each(load: _Load) -> Iterator[pa.RecordBatch]:
        levels = [level for level in load.levels(max(lengths), sent.value) if level.k in lengths]
        return _packed(levels, bits, least) if levels else iter(())

    packed = _over_loads(docs, each, "slice int, hashes binary, counts binary")
    return written(_frequent_hashes(packed, bits, least), "marked")


def counts(docs: DataFrame, marks: Proposals, before: Proposals) -> DataFrame:
    """lang, words, phrase, f of all runs that are marked or were not admitted ``before``; words 0: all words of a language."""
    sent = docs.sparkSession.sparkContext.broadcast((marks, before))

    def each(load: _Load) -> Iterator[pa.RecordBatch]:
        yield load.totals()
        for level in load.levels(MOST_WORDS, *sent.value):
            yield from level.by_words()

    found = _over_loads(docs, each, "lang string, words int, phrase string, f long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.select(lang, F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("drawn"))


def slice_bits(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max((size // SLICE_BYTES).bit_length(), _SLICES[0]), _SLICES[1])


def propose(docs: DataFrame, bits: int, support: int = SUPPORT, share: float = SAMPLE) -> Proposals:
    """Words and phrases (but the longest) that the sample holds often enough, level by level."""
    sample = docs.where(F.pmod("drawn", F.lit(1_000_000)) < int(share * 1_000_000)).drop("drawn")
    least, found = max(2, int(LOWERED * support * share)), Proposals()
    for k in range(1, MOST_WORDS):
        found = found.with_runs(marked(sample, range(k, k + 1), found, bits, least))
    return found


def frequent(docs: DataFrame, support: int = SUPPORT, share: float = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """lang, words, phrase, f of all runs of up to ``MOST_WORDS`` words with the support; and lang, n: all words of a language."""
    rows = _texts(docs)
    bits = slice_bits(rows)
    proposed = propose(rows, bits, support, share)
    rows = rows.drop("drawn")
    marks = Proposals().with_runs(marked(rows, range(1, MOST_WORDS + 1), proposed, bits, support))
    counted = counts(rows, marks, proposed).where((F.col("f") >= support) | (F.col("words") == 0))
    counted = written(counted, "phrases")
    return counted.where("words > 0"), counted.where("words = 0").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, support: int = SUPPORT, best: int = BEST, share: float = SAMPLE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language, without those that a longer one nearly always holds."""
    found, totals = frequent(docs, support, share)
    candidates = found.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    # the weakest cut
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    first = F.expr("substring_index(phrase, ' ', cut)")
    cuts = cuts.withColumn("first", first).withColumn("rest", F.expr("substring(phrase, char_length(first) + 2)"))
    part = found.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), "f")
    left, right = part.withColumnRenamed("f", "l"), part.withColumnRenamed("f", "r")
    joined = cuts.join(left, (F.col("lang") == left["of"]) & (F.col("first") == left["part"])).drop("of", "part")
    joined = joined.join(right, (F.col("lang") == right["of"]) & (F.col("rest") == right["part"])).drop("of", "part")
    score = F.expr(f"CAST(a AS DECIMAL(20,0)) * {SCALE} div (CAST(l AS DECIMAL(20,0)) + r)")
    scored = joined.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("least"))
    # phrases inside longer candidates
    spans = "flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(split(phrase, ' '), i, k), ' '))))"
    inner = candidates.where("words > 2").select("lang", F.explode(F.expr(spans)).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left")
    wide = {c: F.col(c).cast("decimal(20,0)") for c in ("longer", "a")}
    kept = kept.where(F.col("longer").isNull() | (100 * wide["longer"] < OVERLAP_PCT * wide["a"]))
    kept = kept.select("lang", "phrase", "a", "least.l", "least.r", "least.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
