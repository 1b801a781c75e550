"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text: ``h = (h << 4) + gear[byte]`` in 32 bits, so it depends on the last 8 bytes only. A
chunk ends where the hash is the largest within ``REACH`` bytes on both sides. Such ends depend on
the bytes around them and on nothing else: an insertion shifts chunks but changes only those it touches, and two copies
of a passage are cut alike. Chunks are at least ``REACH + 1`` bytes long, about twice that on average. Text that repeats itself
every few bytes has no such ends; there a chunk is divided every ``LONGEST`` bytes from its start.

Chunks are deduplicated by a 128-bit digest: the document with the smallest identifier keeps a chunk, every later document
has it as a repeat. Neighbouring repeats form a run; a run with at least ``LEAST_WORDS`` words is a repeated passage. As chunks at the
rim of a passage are cut differently, a run is shorter than its passage by some words, which is why the bound is below
the 50 words from which on passages have to be found. Lines and phrases that many texts share stay below it.

* Null texts and texts without repeats are unchanged. Repeats within one document only are left to the quality rules.
* Repeated rows of one doc_id count as one document: none of them is a repeat of the other.
* Rows with a null doc_id have no place in the order; they are unchanged and keep nothing.
* Very long texts are chunked as a whole; a task holds one text and eight bytes for each of its bytes.
* An empty table gives an empty result. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricledger.llm.common import handed_back, rows_of, texts, written

#: Bytes on both sides within which the hash at a chunk's end is the largest.
REACH = 16
#: Bytes from which on a chunk is divided.
LONGEST = 128
#: Words from which on a run of repeated chunks is a repeated passage.
LEAST_WORDS = 28
GEAR = np.random.default_rng(20_240_101).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Spans (24 bytes each) up to which a table of them is sent to all tasks.
SENT_SPANS = 1_000_000
#: Chunks handed to the JVM at once.
CHUNK_ROWS = 32_768


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, by doubling the span it covers: 1, 2, 4, 8 bytes."""
    h = GEAR[data]
    for span in (1, 2, 4):
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(4 * span)
        h = longer
    return h


def _slid(h: np.ndarray, reach: int, ahead: bool) -> np.ndarray:
    """The largest of the ``reach`` values after (or before) each one; 0 where there are none."""
    best = np.zeros_like(h)
    if ahead:
        best[:-1] = h[1:]
    else:
        best[1:] = h[:-1]
    covered = 1
    while covered < reach:
        step = min(covered, reach - covered)
        moved = np.zeros_like(best)
        if ahead:
            moved[:-step] = best[step:]
        else:
            moved[step:] = best[:-step]
        best = np.maximum(best, moved)
        covered += step
    return best


def chunk_ends(data: np.ndarray, reach: int = REACH, longest: int = LONGEST) -> np.ndarray:
    """Where chunks end (exclusive), the end of the text included."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.array([n])
    if n > reach:
        h = gear_hash(data)
        tops = np.flatnonzero((h > _slid(h, reach, False)) & (h >= _slid(h, reach, True))) + 1
        ends = np.append(tops[(tops > reach) & (tops < n)], n)
    sizes = np.diff(ends, prepend=0)
    more = (sizes - 1) // longest  # divisions within each chunk
    if more.any():
        of = np.repeat(np.arange(len(ends)), more)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.sort(np.concatenate([ends, (ends - sizes)[of] + nth * longest]))
    for _ in range(3):  # no character is divided
        ends = ends + ((ends < n) & (data[np.minimum(ends, n - 1)] & 0xC0 == 0x80))
    return np.unique(ends)


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, number, start, length (bytes), words (that begin in it), high, low (the digest) of every chunk."""
    schema = pa.schema([("doc_id", pa.int64()), ("number", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("words", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])

    def columns(doc_id: int, text: bytes) -> list[np.ndarray]:
        data = np.frombuffer(text, np.uint8)
        ends = chunk_ends(data)
        starts = np.concatenate([[0], ends[:-1]])
        space = _SPACE[data]
        begins = ~space
        begins[1:] &= space[:-1]
        words = np.add.reduceat(begins, starts, dtype=np.int32)
        digest = xxhash.xxh3_128_digest
        digests = np.frombuffer(b"".join([digest(text[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]), ">i8").astype(np.int64).reshape(-1, 2)
        n = len(ends)
        return [np.full(n, doc_id), np.arange(n, dtype=np.int32), starts, (ends - starts).astype(np.int32), words, digests[:, 0], digests[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            b = b.set_column(1, "text", b.column(1).cast(pa.binary()))
            for doc_id, text in rows_of(b, "doc_id", "text"):
                if text:
                    held.append(columns(doc_id, text))
                    rows += len(held[-1][0])
                if rows >= CHUNK_ROWS:
                    yield _batch(held, schema)
                    held, rows = [], 0
        if held:
            yield _batch(held, schema)

    rows = texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(handed_back(run), "doc_id long, number int, start long, length int, words int, high long, low long")


def _batch(held: list[list[np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, start, length (bytes), words, chunks, first_doc_id of every passage that an earlier document has.

    first_doc_id is the earliest document that holds a chunk of the passage.
    """
    found = chunks(docs)
    firsts = found.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("latest"))
    firsts = written(firsts.where("first < latest").select("high", "low", "first"), "chunk_firsts")
    again = found.join(firsts, ["high", "low"]).where("first < doc_id").select("doc_id", "number", "start", "length", "words", "first")
    # repeated rows of a document bring their chunks twice
    again = again.groupBy("doc_id", "number", "start", "length", "words").agg(F.min("first").alias("first"))
    by_place = Window.partitionBy("doc_id").orderBy("number", "start")
    begins = (F.coalesce(F.lag(F.col("start") + F.col("length")).over(by_place), F.lit(-1)) != F.col("start")).cast("long")
    runs = again.withColumn("begins", begins).withColumn("run", F.sum("begins").over(by_place)).groupBy("doc_id", "run")
    merged = runs.agg(
        F.min("start").alias("start"),
        F.sum("length").alias("length"),
        F.sum("words").alias("words"),
        F.count("*").alias("chunks"),
        F.min("first").alias("first_doc_id"),
    )
    return merged.where(F.col("words") >= least_words).drop("run")


def cut(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents without their repeated passages; n_chars follows the text. All columns and their order stay.

    Documents of which no word is left are gone.
    """
    found = written(repeats(docs, least_words).select(F.col("doc_id").alias("_cut_doc"), "start", "length"), "repeats")
    spans = found.groupBy("_cut_doc").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("_cut_spans"))
    if found.count() <= SENT_SPANS:
        spans = F.broadcast(spans)  # the texts then stay where they are; else they are shuffled, with the same result
    joined = docs.join(spans, docs["doc_id"] == F.col("_cut_doc"), "left")
    data, none = F.col("text").cast("binary"), F.col("_cut_spans").isNull()
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cut_spans", lambda s: s["start"] + s["length"]))
    stops = F.concat(F.transform("_cut_spans", lambda s: s["start"]), F.array(F.octet_length("text").cast("long")))
    kept = F.zip_with(begins, stops, lambda b, e: F.hex(F.substring(data, (b + 1).cast("int"), (e - b).cast("int"))))
    joined = joined.withColumn("_cut_text", F.when(none, F.col("text")).otherwise(F.unhex(F.array_join(kept, "")).cast("string")))
    joined = joined.where(none | F.col("_cut_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("_cut_text"), "n_chars": F.when(none, docs["n_chars"]).otherwise(F.length("_cut_text")) if "n_chars" in docs.columns else None}
    return joined.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else docs[c] for c in docs.columns))
