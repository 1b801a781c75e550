"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams.

The ratio compares two multinomials over hashed byte n-grams: one counted over a trusted target (documents labelled as good), one over
the raw corpus (all documents). A document's ratio is the mean over its n-grams, so length does not matter. The
threshold is a fixed number of standard deviations below the mean ratio of the trusted documents: every document is decided
by its own ratio, none by chance. The base rules come first: too few words, or too many words in repeated 8-word windows.

* Null texts count as empty ones: no words, so the base rules fail.
* Texts too short for an n-gram have ratio 0.
* Without trusted documents the ratio decides nothing, and only the base rules hold.
* Repeated rows get equal results. An empty table gives an empty result.
* Very long texts are counted as a whole; a task holds one text and some numbers for each of its words and bytes.
* Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricledger.llm.common import batches_from, by_size, rows_of, slices, texts, written

LEAST_WORDS, WINDOW, MOST_REPEATED_PCT = 20, 8, 30
#: Lengths of the n-grams in bytes, and the buckets that they are hashed to.
GRAMS, BUCKETS = (2, 3, 4), 1 << 16
#: Added to every bucket's count.
SMOOTHING = 1.0
#: Standard deviations of the trusted documents' ratios below their mean: the threshold.
DEVIATIONS = 4.0
#: Bytes hashed at once.
STRETCH = 1 << 20
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that stand twice or more in the text. Exact: windows are compared by rank, doubled in length."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    length = 1
    while length < window:
        pairs = rank[:-length] * (int(rank.max()) + 1) + rank[length:]
        rank = np.unique(pairs, return_inverse=True)[1]
        length *= 2
    again = np.bincount(rank)[rank] > 1
    change = np.zeros(n + 1, np.int64)
    change[: len(again)] += again
    change[window : window + len(again)] -= again
    return int((np.cumsum(change) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()  # of bytes: ASCII white space
    chars = len(b"".join(words).decode())
    lines = [x for x in text.split(b"\n") if _WORD.search(x)]
    return len(words), chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def hashed(text: bytes) -> Iterator[np.ndarray]:
    """The buckets of all n-grams, in stretches."""
    for at in range(0, len(text), STRETCH):
        for k in GRAMS:
            d = np.frombuffer(text[at : at + STRETCH + k - 1], np.uint8).astype(np.uint32)
            n = len(d) - k + 1
            if n > 0:
                h = np.full(n, k * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
                for i in range(k):
                    h = (h ^ d[i : i + n]) * np.uint32(0x01000193)
                yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def gram_counts(text: bytes) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for h in hashed(text):
        out += np.bincount(h, minlength=BUCKETS)
    return out


@dataclass
class Ratio:
    """Log ratio of each bucket, and the threshold."""

    buckets: np.ndarray
    threshold: float

    def of(self, text: bytes) -> float:
        total, n = 0.0, 0
        for h in hashed(text):
            total += float(self.buckets[h].sum())
            n += len(h)
        return total / n if n else 0.0


def _as_bytes(b: pa.RecordBatch) -> Iterator[bytes]:
    at = b.schema.get_field_index("text")
    return (t or b"" for part in slices(b) for t in part.column(at).cast(pa.binary()).to_pylist())


def _flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, trusted of every row: trusted if all labels of its doc_id say that it is good."""
    key = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    good = key.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    return texts(docs).join(by_size(written(good, "trusted")).withColumn("trusted", F.lit(True)), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))


def fit(docs: DataFrame, labels: DataFrame, deviations: float = DEVIATIONS) -> Ratio:
    """Both multinomials over all documents. What reaches the driver is at most a row for each bucket."""
    spark = docs.sparkSession
    rows = _flagged(docs, labels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text, trusted in zip(_as_bytes(b), b.column(1).to_pylist(), strict=True):
                for h in hashed(text):
                    n = np.bincount(h, minlength=BUCKETS) if len(h) > 4_096 else None
                    for into in (raw, target) if trusted else (raw,):
                        if n is None:
                            np.add.at(into, h, 1)
                        else:
                            into += n
        at = np.flatnonzero(raw)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return Ratio(np.zeros(BUCKETS), -1.0)
    logs = np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS))
    ratio = Ratio(logs, 0.0)
    sent = spark.sparkContext.broadcast(ratio)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # whole numbers: sums do not depend on the order of rows
            values = [round(sent.value.of(t) * 1e9) for t in _as_bytes(b)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64())], names=["ratio"])

    x = F.col("ratio").cast("decimal(20,0)")
    trusted = rows.where("trusted").select("text").mapInArrow(rate, "ratio long").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum((x * x).cast("decimal(38,0)")).alias("q")).first()
    n, s, q = int(trusted["n"]), int(trusted["s"]), int(trusted["q"])
    ratio.threshold = (s / n - deviations * (max(0, q * n - s * s) ** 0.5) / n) / 1e9
    return ratio


RESULT = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("ratio", pa.float64()), ("kept", pa.bool_())]
)


def judge(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value

        def rows() -> Iterator[tuple]:
            for b in batches:
                for (doc_id,), text in zip(rows_of(b, "doc_id"), _as_bytes(b), strict=True):
                    n, chars, symbols, lines, repeated = base_counts(text)
                    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PCT * n
                    x = known.of(text)
                    yield doc_id, n, chars, symbols, lines, repeated, failed, x, not failed and x >= known.threshold

        yield from batches_from(rows(), RESULT)

    ddl = ", ".join(f"{f.name} {'boolean' if f.type == pa.bool_() else 'double' if f.type == pa.float64() else 'long'}" for f in RESULT)
    return texts(docs).mapInArrow(run, ddl)
