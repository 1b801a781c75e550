"""SimHash near-duplicates by deletion-variant signatures.

Texts are lower-cased in A-Z, split at ASCII white space into words and hashed as 3-word shingles. Two fingerprints of 64 bits
are linked if they differ in at most 3 bits; a component is what links reach.

*Finding links.* A fingerprint is cut in two segments of 32 bits. If two differ in at most 3 bits, one of their segments
differs in at most one. So each fingerprint is indexed under 64 signatures: a segment with one of its bits
cleared, for every bit. Linked fingerprints meet in at least one signature; those that meet are verified.

*Crowded signatures.* Only distinct fingerprints are indexed, so copies cost nothing. A group of very many near copies
may still crowd a signature. Its members are then indexed further by the other segment in the same way: 32 variants of its
two halves, and, where that still is crowded, 16 variants of the last half's bytes. Then 53 of the 64 bits are fixed, so that no
signature holds more than 2 048 fingerprints. Nothing is capped: each level keeps the guarantee that linked fingerprints meet.

*Links of a signature* are given as a spanning forest of its members, not as all their pairs; components are the same.

* Null texts and texts without words have fingerprint 0 and are linked like any other; with fewer than 3 words the
  whole sequence is the one shingle.
* Repeated rows stay; they have one fingerprint. Rows with a null doc_id get the component of their text.
* An empty table gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricledger.llm.common import batches_from, by_size, handed_back, slices, texts, with_rows, written
from metricledger.llm.components import stars

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 3
#: From this many members on a signature is indexed further.
CROWDED = 1_024
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts, stops = (ends - lengths)[: 1 - SHINGLE_WORDS].tolist(), ends[SHINGLE_WORDS - 1 :].tolist()
        h = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)), np.uint64, len(starts))
    parts = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        counts = np.unpackbits(parts, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(parts[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (signed long) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [fingerprint(t) for part in slices(b) for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.int64())], schema=schema)

    return texts(docs).mapInArrow(handed_back(run), "doc_id long, fingerprint long")


def _variants(part: str, bits: int) -> str:
    """SQL for the signatures of a number of that many bits: which half, which bit is cleared, and the rest of the half."""
    half = bits // 2
    segment = f"CASE WHEN p < {half} THEN {part} & {(1 << half) - 1}L ELSE shiftrightunsigned({part}, {half}) & {(1 << half) - 1}L END"
    return f"shiftleft(CAST(p AS BIGINT), {half}) | (({segment}) & ~shiftleft(1L, p % {half}))"


def _signed(members: DataFrame, level: int) -> DataFrame:
    """fp, k1, k2, k3: the signatures of a level added."""
    if level == 1:
        part, bits = "fp", 64
    elif level == 2:  # the segment that the first signature does not fix: the high one if its number is below 32
        part, bits = "(CASE WHEN shiftright(k1, 32) < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END)", 32
    else:
        part = "(CASE WHEN shiftright(k1, 32) < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END)"
        part, bits = f"(CASE WHEN shiftright(k2, 16) < 16 THEN shiftrightunsigned({part}, 16) ELSE {part} & 65535L END)", 16
    spread = members.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    return spread.withColumn(f"k{level}", F.expr(_variants(part, bits))).drop("p")


def forest(members: list[int]) -> list[tuple[int, int]]:
    """Edges (larger, smaller) that connect whatever links connect."""
    edges = []
    if len(members) <= 24:
        rest = list(members)
        while rest:
            front = [rest.pop()]
            while front:
                u, far = front.pop(), []
                for v in rest:
                    if ((u ^ v) & 0xFFFFFFFFFFFFFFFF).bit_count() <= RADIUS:
                        edges.append((max(u, v), min(u, v)))
                        front.append(v)
                    else:
                        far.append(v)
                rest = far
        return edges
    left = np.array(members, np.int64)
    while len(left):
        front, left = [int(left[-1])], left[:-1]
        while front and len(left):
            u = front.pop()
            near = np.bitwise_count((left ^ np.int64(u)).view(np.uint64)) <= RADIUS
            found = left[near].tolist()
            edges += [(max(u, v), min(u, v)) for v in found]
            front += found
            left = left[~near]
    return edges


def _forests(buckets: DataFrame) -> DataFrame:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_from((e for b in batches for fps in b.column(0).to_pylist() for e in forest(fps)), schema)

    return buckets.mapInArrow(handed_back(run), "u long, v long")


def links(nodes: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """u, v (u > v): edges that connect all fingerprints within reach of each other. ``nodes``: distinct fp."""
    members, edges = nodes.select("fp"), []
    for level in (1, 2, 3):
        keys = [f"k{i + 1}" for i in range(level)]
        met = _signed(members, level).withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n > 1")
        met = written(met.select("fp", *keys, "n"), f"signatures{level}")  # few: what shares its signature
        pairs = met.where("n = 2").groupBy(*keys).agg(F.min("fp").alias("v"), F.max("fp").alias("u"))
        edges.append(pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).select("u", "v"))
        some = F.col("n") > 2
        if level < 3:
            some = some & (F.col("n") <= crowded)
        edges.append(_forests(met.where(some).groupBy(*keys).agg(F.collect_list("fp").alias("fps")).select("fps")))
        members = met.where(F.col("n") > crowded).drop("n")
        if level == 3 or members.isEmpty():
            break
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row; a component is named by its smallest doc_id."""
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("doc")), "nodes")
    roots = nodes.join(stars(links(nodes)).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = roots.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = written(roots.join(names, "root").select(F.col("fp").alias("fingerprint"), "component_id"), "named")
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hexadecimal(fp: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that of its smallest doc_id, all columns as they were.

    Of several rows with that doc_id one stays. Of components without any doc_id one row stays as well.
    """
    row = "_near_duplicate_row"
    numbered = with_rows(docs, row)
    found = components(numbered.select(F.col(row).alias("doc_id"), "text"))
    # rows are named by their place here; the kept one is that of the smallest doc_id, then of the first place
    placed = found.withColumnRenamed("doc_id", row).join(numbered.select(row, "doc_id"), row)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    kept = placed.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col(f"first.{row}").alias(row))
    return numbered.join(by_size(written(kept, "kept")), row, "left_semi").drop(row)
