"""Best-fit packing by swap-based local search.

Documents become token ids with a closing id, are cut where they are longer than a sequence, and the pieces are packed into
as few sequences as possible. Pieces are dealt evenly into groups of about ``GROUP_PIECES``, each packed by one task: best fit
first, then local search on the bins that are not full. It takes the emptiest of these and tries, for each of its
pieces, to

* move it into another bin,
* exchange it for a smaller piece of another bin, or
* exchange it for two smaller pieces of another bin, or two of its pieces for one of another bin,

always so that the fuller bin gains; where none of these is possible, two other bins exchange pieces alike. The sum of squared
fills grows with each step, so the search ends. A bin that has lost all its pieces is gone; where a bin cannot be emptied, its
pieces stay as they were. Bins left with much room are gathered over all groups and packed once more.

* Null texts are empty; an empty text is one piece with the closing id only.
* Repeated rows are packed as often as they occur.
* Very long texts are cut into full pieces; those are sequences of their own and take no part in the search.
* An empty table gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricledger.llm.common import batches_from, handed_back, rows_of, texts, written

SEQUENCE_TOKENS = 2_048
CLOSING_ID = 0
#: Pieces packed by one task.
GROUP_PIECES = 8_192
#: Distinct words whose ids a task remembers.
REMEMBERED_WORDS = 400_000
#: Steps of the local search for one bin that is being emptied.
STEPS_A_BIN = 200
#: Bins in a row that cannot be emptied, after which the search ends: later ones are fuller still.
TRIES = 24
#: Share of room from which a bin is packed once more with those of other groups.
OPEN_SHARE = 0.02

PIECES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def _ranks(path: str) -> dict[bytes, int]:
    """The vocabulary by bytes; the mark of a word's end is the byte 255, which UTF-8 never uses.

    Ids grow in the order of the merges, so they serve as ranks.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return {bytes(byte_of[c] for c in t.removesuffix("</w>")) + b"\xff" * t.endswith("</w>"): i for t, i in vocabulary.items()}


class Ids:
    """Little-endian 32-bit ids of texts. White space separates words for this tokenizer, so each distinct word is encoded once.

    Words of plain Latin letters, with or without marks after them, are merged directly, which is several times faster;
    all others go through the tokenizer. The ids are the same.
    """

    _PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=_ranks(path), special_tokens={})._core_bpe.encode_single_piece

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        out, others, plain, merge, pack = {}, [], self._PLAIN.fullmatch, self.merge, struct.pack
        for w in words:
            if m := plain(w):
                letters, marks = m.groups()
                ids = merge(letters.lower().encode() + b"\xff")
                if marks:
                    ids += merge(marks.encode() + b"\xff")
                out[w] = pack(f"<{len(ids)}I", *ids)
            else:
                others.append(w)
        for w, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            out[w] = pack(f"<{len(e.ids)}I", *e.ids)
        return out

    def __call__(self, text: str) -> bytes:
        words, known = text.replace("\n", " ").split(" "), self.known
        new = [w for w in {*words} if w not in known]
        if new:
            if len(known) + len(new) > REMEMBERED_WORDS:
                known = self.known = {"": b""}
                new = [w for w in {*words} if w]
            known.update(self._encode(new))
        return b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=1)
def ids_of(path: str) -> Ids:
    """One for each Python worker, which serves many tasks."""
    return Ids(path)


def tokenize(docs: DataFrame, tokenizer: str, tokens: int = SEQUENCE_TOKENS, closing: int = CLOSING_ID) -> DataFrame:
    """doc_id, row, piece, start, length, ids (little-endian 32-bit) of every piece. ``row`` tells repeated documents apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, width = ids_of(tokenizer), np.array([closing], "<u4").tobytes(), 4 * tokens

        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc_id, row, text in rows_of(b, "doc_id", "row", "text"):
                    data = ids(text or "") + end
                    for i, at in enumerate(range(0, len(data), width)):
                        part = data[at : at + width]
                        yield doc_id, row, i, at // 4, len(part) // 4, part

        yield from batches_from(rows(), PIECES, 1_024)

    rows = texts(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(handed_back(run), "doc_id long, row long, piece int, start long, length long, ids binary")


class _Bins:
    """Pieces in bins; ``room`` is what is left in each."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.of = np.empty(len(sizes), np.int64)
        room: list[int] = []
        by_room: dict[int, list[int]] = {}
        filled = 0  # bit r: some bin has exactly r left
        for i in np.argsort(-sizes, kind="stable").tolist():
            size = int(sizes[i])
            fits = filled >> size
            if fits:
                left = size + (fits & -fits).bit_length() - 1
                k = by_room[left].pop()
                if not by_room[left]:
                    filled &= ~(1 << left)
            else:
                k, left = len(room), capacity
                room.append(capacity)
            self.of[i] = k
            room[k] = left = left - size
            if left:
                by_room.setdefault(left, []).append(k)
                filled |= 1 << left
        self.room = np.array(room, np.int64)

    def search(self) -> None:
        """Empties bins, the emptiest first, until none can be emptied or no fewer can hold the pieces."""
        fewest, bins, failed = -(-int(self.sizes.sum()) // self.capacity), len(self.room), 0
        for victim in np.argsort(-self.room, kind="stable").tolist():
            if bins <= fewest or not self.room[victim] or failed >= TRIES:
                break
            kept = self.of.copy(), self.room.copy()
            if self._empty(victim):
                bins, failed = bins - 1, 0
            else:
                (self.of, self.room), failed = kept, failed + 1

    def _empty(self, victim: int) -> bool:
        """Moves all pieces of a bin elsewhere; each step leaves less in it."""
        open_bins = (self.room > 0) & (self.room < self.capacity)
        open_bins[victim] = False
        others = np.flatnonzero(open_bins[self.of])
        if not len(others):
            return False
        mine = sorted(np.flatnonzero(self.of == victim).tolist(), key=lambda i: -self.sizes[i])
        for _ in range(STEPS_A_BIN):
            if not mine:
                return True
            if self.capacity - self.room[victim] > int(self.room[open_bins].sum()):
                return False  # it cannot all fit
            if not (
                self._move(victim, mine, open_bins)
                or self._one_for_one(victim, mine, others)
                or self._one_for_two(victim, mine, others)
                or self._between(others)
            ):
                return False
        return False

    def _put(self, piece: int, to: int) -> None:
        self.room[self.of[piece]] += self.sizes[piece]
        self.room[to] -= self.sizes[piece]
        self.of[piece] = to

    def _move(self, victim: int, mine: list[int], open_bins: np.ndarray) -> bool:
        bins = np.flatnonzero(open_bins)
        room = self.room[bins]
        for piece in mine:
            fits = room >= self.sizes[piece]
            if fits.any():
                self._put(piece, int(bins[np.where(fits, room, self.capacity + 1).argmin()]))
                mine.remove(piece)
                return True
        return False

    def _one_for_one(self, victim: int, mine: list[int], others: np.ndarray) -> bool:
        sizes, room = self.sizes[others], self.room[self.of[others]]
        for piece in mine:
            gain = self.sizes[piece] - sizes  # what the other bin gains
            fits = (gain > 0) & (gain <= room)
            if fits.any():
                other = int(others[np.where(fits, gain, -1).argmax()])
                to = int(self.of[other])
                self._put(other, victim)
                self._put(piece, to)
                mine[mine.index(piece)] = other
                others[others == other] = piece
                mine.sort(key=lambda i: -self.sizes[i])
                return True
        return False

    def _between(self, others: np.ndarray) -> bool:
        """Exchanges two pieces between other bins, so that the fuller bin gains and room gathers in the emptier one."""
        order = np.argsort(self.sizes[others], kind="stable")
        ranked, sizes = others[order], self.sizes[others]
        of, room = self.of[others], self.room[self.of[others]]
        at = np.searchsorted(sizes[order], sizes + room, "right") - 1  # the largest piece that fits in place of each
        other = ranked[at]
        gain, their_room = self.sizes[other] - sizes, self.room[self.of[other]]
        squares = np.where((gain > 0) & (self.of[other] != of) & (room <= their_room), gain * (their_room - room + gain), 0)
        k = int(squares.argmax())
        if not squares[k]:
            return False
        x, y, a, b = int(others[k]), int(other[k]), int(of[k]), int(self.of[other[k]])
        self._put(x, b)
        self._put(y, a)
        return True

    def _one_for_two(self, victim: int, mine: list[int], others: np.ndarray) -> bool:
        """A piece of the victim for two smaller ones, or two of its pieces for one smaller than both together."""
        order = np.lexsort((self.sizes[others], self.of[others]))
        ranked = others[order]
        bins = self.of[ranked]
        for step in (1, 2, 3):  # pairs of near ranks in their bin
            a, b = ranked[:-step], ranked[step:]
            same = bins[:-step] == bins[step:]
            both, room = self.sizes[a] + self.sizes[b], self.room[bins[:-step]]
            for piece in mine:
                gain = self.sizes[piece] - both
                fits = same & (gain > 0) & (gain <= room)
                if fits.any():
                    k = int(np.where(fits, gain, -1).argmax())
                    x, y, to = int(a[k]), int(b[k]), int(bins[k])
                    self._put(x, victim)
                    self._put(y, victim)
                    self._put(piece, to)
                    mine[mine.index(piece)] = x
                    mine.append(y)
                    others[others == x] = piece
                    others[:] = np.where(others == y, piece, others)
                    mine.sort(key=lambda i: -self.sizes[i])
                    return True
        sizes, room = self.sizes[others], self.room[self.of[others]]
        for i, x in enumerate(mine):
            for y in mine[i + 1 :]:
                gain = self.sizes[x] + self.sizes[y] - sizes
                fits = (gain > 0) & (gain <= room)
                if fits.any():
                    other = int(others[np.where(fits, gain, -1).argmax()])
                    to = int(self.of[other])
                    self._put(other, victim)
                    self._put(x, to)
                    self._put(y, to)
                    mine.remove(x)
                    mine[mine.index(y)] = other
                    others[others == other] = x
                    mine.sort(key=lambda i: -self.sizes[i])
                    return True
        return False


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece, numbered from 0 without gaps."""
    bins = _Bins(np.asarray(sizes, np.int64), capacity)
    bins.search()
    return np.unique(bins.of, return_inverse=True)[1]


_PACKED = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, sequence_id long, room long"


def _pack_groups(pieces: DataFrame, groups: int, base: int, tokens: int) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "row", "piece"], kind="stable")
        of = pack_sizes(pdf["length"].to_numpy(), tokens)
        room = tokens - np.bincount(of, weights=pdf["length"].to_numpy()).astype(np.int64)
        return pdf.drop(columns="part").assign(sequence_id=((base + int(key[0])) << 32) + of, room=room[of])

    part = F.pmod(F.xxhash64("doc_id", "row", "piece", F.lit(base)), F.lit(groups))
    return pieces.withColumn("part", part).groupBy("part").applyInPandas(run, _PACKED)


def pack(pieces: DataFrame, tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """Adds sequence_id and offset. ``pieces``: doc_id, row, piece, start, length, ids_crc32."""
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
    short = pieces.where(F.col("length") < tokens)
    full = pieces.where(F.col("length") == tokens).select(
        *names, F.xxhash64("doc_id", "row", "piece").alias("sequence_id"), F.lit(0).cast("long").alias("room")
    )
    # full pieces are numbered below all others
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    groups = max(1, -(-short.count() // GROUP_PIECES))
    first = written(_pack_groups(short, groups, 0, tokens), "packed")
    open_bins = F.col("room") > OPEN_SHARE * tokens
    left = first.where(open_bins)
    again = max(1, -(-left.count() // GROUP_PIECES))
    second = _pack_groups(left.select(*names), again, groups, tokens)
    placed = full.unionByName(first.where(~open_bins)).unionByName(second)
    before = Window.partitionBy("sequence_id").orderBy("doc_id", "row", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("room")


def pack_documents(docs: DataFrame, tokenizer: str, tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = tokenize(docs, tokenizer, tokens)
    return pack(written(_without_ids(pieces), "pieces"), tokens)


def _without_ids(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "row", "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"))


def packed_sequences(docs: DataFrame, tokenizer: str, tokens: int = SEQUENCE_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The places of all pieces, as :func:`pack_documents` gives them, and the sequences with their ids."""
    pieces = written(tokenize(docs, tokenizer, tokens), "pieces_with_ids")
    packed = written(pack(_without_ids(pieces), tokens), "places")
    return packed, sequences(pieces, packed)


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (little-endian 32-bit).

    ``pieces`` come from :func:`tokenize` and must be a written table, the one that ``packed`` was made of: a second run of it may number rows anew.
    """
    parts = pieces.select("doc_id", "row", "piece", "ids").join(packed.select("doc_id", "row", "piece", "sequence_id", "offset"), ["doc_id", "row", "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return parts.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["ids"]), "")).alias("ids"))
