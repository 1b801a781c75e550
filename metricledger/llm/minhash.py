"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's set holds its distinct shingles of 5 words. Two documents are linked if their sets have a Jaccard similarity of 0.85 or more; a component is
what links reach. Only distinct sets are compared: copies cost nothing.

*Signatures.* 64 minima of 16 bits each. A place of two signatures differs with probability 1 - similarity, so sets of 0.85 differ in 9.6 places on
average; the threshold is 23 places, which a pair of exactly 0.85 exceeds with probability 9e-6, and a pair of 0.9 with 5e-9.

*Candidates.* A signature is cut in 12 chunks. If two differ in at most 23 places, one chunk differs in at most one; so each chunk is indexed once for every
place left out, and signatures within the threshold meet under one of 64 keys at least. What meets is joined into groups: the members of a key to its smallest.
A group is a superset of the components in it.

*Verification.* Sets are made again for members of groups only, and each group is settled where its sets are: pairs within the signature threshold, nearest
first, unless connected already, are confirmed on the full sets. A group too large for one task is dealt into blocks. Each block is settled by itself; then one member
of the largest component of each block is compared with those of the others; what then is outside a group's largest component is compared
with all blocks. Pairs within one component need no comparison, so every pair is connected, compared or beyond the threshold.

* Null texts and texts without words have an empty set, are linked with nothing and stand alone. With fewer than 5 words the whole sequence is the shingle.
* Repeated rows stay, with one component. Rows with a null doc_id get the component of their set (null if no row of it has a doc_id); they are not kept.
* An empty table gives an empty result. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricledger.llm.common import by_size, slices, texts, written
from metricledger.llm.components import stars

SHINGLE_WORDS, LINK_PCT = 5, 85
PLACES, RADIUS, CHUNKS = 64, 23, 12
#: Members of a block, and shingles of all its members together.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
_RANDOM = np.random.default_rng(20240101)
_FACTORS = _RANDOM.integers(0, 1 << 63, (PLACES, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, (PLACES, 1), np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, each worked out once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes | None, words: _Words) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    found = (text or b"").lower().split()  # of bytes: A-Z only, and ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(SHINGLE_WORDS, len(h))
    s = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        s = _mixed(s) * _PRIME + h[j : len(h) - k + 1 + j]
    return np.unique(_mixed(s + np.uint64(k)))


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4_096):
        np.minimum(least, (found[None, at : at + 4_096] * _FACTORS + _TERMS).min(1), out=least)
    return (_mixed(least) >> np.uint64(48)).astype("<u2")


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (of the set) and signature of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            for part in slices(b):
                sets = [shingles(t, words) for t in part.column(1).cast(pa.binary()).to_pylist()]
                columns = [
                    part.column(0),
                    part.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, signature binary")


def keys(signatures: np.ndarray) -> np.ndarray:
    """A row of keys for each signature: a chunk without one of its places."""
    columns = []
    for chunk, places in enumerate(np.array_split(np.arange(PLACES), CHUNKS)):
        for left_out in places:
            h = np.full(len(signatures), np.uint64(chunk << 8 | left_out), np.uint64)
            for p in places[places != left_out]:
                h = _mixed(h) * _PRIME + signatures[:, p].astype(np.uint64)
            columns.append(_mixed(h))
    return np.stack(columns, 1)


def _keyed(nodes: DataFrame) -> DataFrame:
    """node, key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1_024):
                found = keys(np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, PLACES))
                node = np.repeat(part.column(0).to_numpy(), found.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(found.ravel().view(np.int64))], names=["node", "key"])

    return nodes.select("node", "signature").mapInArrow(run, "node long, key long")


def met(nodes: DataFrame) -> DataFrame:
    """u, v (u > v): members of a key and its smallest. Within the threshold means connected here."""
    keyed = _keyed(nodes)
    shared = keyed.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("u")).where("u <> v")
    shared = written(shared, "shared_keys")
    return keyed.join(shared.select("key", "v"), "key").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


class _Linked:
    """Union and find over the rows of a block."""

    def __init__(self, components: list[int]) -> None:
        first: dict[int, int] = {}
        self.parent = [first.setdefault(c, i) for i, c in enumerate(components)]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    low, high = sorted((len(a), len(b)))
    if 100 * low < LINK_PCT * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= LINK_PCT * (low + high - both)


def confirmed(nodes: list[int], components: list[int], signatures: np.ndarray, sets: list[np.ndarray], left: list[bool]) -> Iterator[tuple[int, int]]:
    """Links that connect whatever links connect. Compared are rows marked ``left`` with all, within the signature threshold."""
    linked = _Linked(components)
    which = np.flatnonzero(left)
    found = []
    for i in which.tolist():
        far = (signatures != signatures[i]).sum(1)
        near = np.flatnonzero(far <= RADIUS)
        found += [(int(far[j]), i, j) for j in near.tolist() if j != i and not (left[j] and j < i)]
    for _, i, j in sorted(found):
        a, b = linked.root(i), linked.root(j)
        if a != b and similar(sets[i], sets[j]):
            linked.parent[max(a, b)] = min(a, b)
            yield nodes[i], nodes[j]


def _confirm(rows: DataFrame, *group: str) -> DataFrame:
    """u, v (u > v). ``rows``: node, component, signature, hashes, left; a group is a block or two."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        by_node = {}
        for r in zip(*(table.column(c).to_pylist() for c in ("node", "component", "signature", "hashes", "left")), strict=True):
            by_node[r[0]] = r if r[4] or r[0] not in by_node else by_node[r[0]]
        nodes, components, signatures, hashes, left = zip(*(by_node[n] for n in sorted(by_node)), strict=True)
        matrix = np.frombuffer(b"".join(signatures), "<u2").reshape(-1, PLACES)
        edges = list(confirmed(list(nodes), list(components), matrix, [np.frombuffer(h, "<u8") for h in hashes], list(left)))
        return pa.table({"u": pa.array([max(e) for e in edges], pa.int64()), "v": pa.array([min(e) for e in edges], pa.int64())})

    return rows.select(*group, "node", "component", "signature", "hashes", "left").groupBy(*group).applyInArrow(run, "u long, v long")


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The members with signature and hashes of their sets, made again from the text of the row that stands for each; a member is sent in 48 bytes."""
    kept = ["node", "root", "block", "blocks"]
    ddl = "node long, root long, block long, blocks long, signature binary, hashes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Words(), set()
        for b in batches:
            for part in slices(b):
                new = [i for i, n in enumerate(part.column(0).to_pylist()) if n not in seen and not seen.add(n)]
                part = part.take(pa.array(new, pa.int64()))
                sets = [shingles(t, words) for t in part.column(4).cast(pa.binary()).to_pylist()]
                made = [pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *made], names=[*kept, "signature", "hashes"])

    rows = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    rep = members.select(*kept, F.col("doc").alias("of"), F.col("text_hash").alias("its_hash"))
    joined = rows.join(by_size(rep), (F.col("text_hash") == F.col("its_hash")) & F.col("doc_id").eqNullSafe(F.col("of")))
    return joined.select(*kept, "text").mapInArrow(run, ddl)


def _components(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """``sets`` with the component of each node so far."""
    found = stars(edges).select("node", F.col("root").alias("component"))
    return sets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def links(docs: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v (u > v): confirmed links that connect whatever links connect. ``nodes``: node, doc, text_hash, n_shingles, signature."""
    groups = stars(met(nodes))
    groups = written(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()), "groups")
    sizes = nodes.join(groups, "node").groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks")
    )
    members = nodes.join(groups, "node").join(written(sizes, "group_sizes"), "root")
    members = written(members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")), "members")
    sets = written(_sets(docs, members), "sets")
    alone = sets.withColumn("component", F.col("node")).withColumn("left", F.lit(True))
    edges = written(_confirm(alone, "root", "block"), "links")
    large = sets.where("blocks > 1")
    if large.isEmpty():
        return edges
    # one member of the largest component of each block against those of other blocks
    now = written(_components(large, edges).select("root", "block", "blocks", "node", "component"), "settled")
    count = F.count("*").alias("n")
    order = [F.desc("n"), "component"]
    most = now.groupBy("root", "block", "blocks", "component").agg(count)
    most = most.withColumn("at", F.row_number().over(Window.partitionBy("root", "block").orderBy(*order))).where("at = 1")
    heads = most.select(F.col("component").alias("node"), F.pmod(F.xxhash64("block"), F.ceil(F.col("blocks") / block)).alias("part"))
    picked = alone.join(by_size(written(heads, "heads")), "node")
    edges = written(edges.unionByName(_confirm(picked, "root", "part")), "links")
    # what is outside a group's largest component against all blocks
    now = written(_components(large, edges), "settled")
    totals = written(now.groupBy("root", "component").agg(count), "totals")
    parts = totals.withColumn("part", F.pmod(F.xxhash64("component"), F.lit(64)))
    for by in (("root", "part"), ("root",)):
        parts = parts.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("at = 1")
    all_members = totals.groupBy("root").agg(F.sum("n").alias("all"))
    largest = parts.join(all_members, "root").select("root", F.col("component").alias("largest"), F.ceil((F.col("all") - F.col("n")) / block).cast("long").alias("rests"))
    now = now.join(written(largest.where("rests > 0"), "largest"), "root")  # else settled
    outside = F.col("component") != F.col("largest")
    rest = F.pmod(F.xxhash64("node", F.lit(1)), F.col("rests"))
    # a pair of blocks holds the rows outside that fall to it, marked, and a block of all
    lefts = now.where(outside).withColumn("left", F.lit(True)).withColumn("rest", rest).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rights = now.withColumn("left", F.lit(False)).withColumn("rest", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
    columns = ["root", "rest", "block", "node", "component", "signature", "hashes", "left"]
    both = lefts.select(columns).unionByName(rights.select(columns))
    return written(edges.unionByName(_confirm(both, "root", "rest", "block")), "links")


def components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; a component is named by its smallest doc_id."""
    rows = written(prints(docs), "prints")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "n_shingles", "signature")).alias("r")
    nodes = rows.where("n_shingles > 0").groupBy("digest").agg(least)
    nodes = nodes.select("digest", F.col("r.doc_id").alias("doc"), "r.text_hash", "r.n_shingles", "r.signature")
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = stars(links(docs, nodes, block))
    roots = nodes.select("node", "digest", "doc").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = roots.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = written(roots.join(names, "root").select("digest", "component_id"), "named")
    out = rows.join(named, "digest", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return out.select("doc_id", "n_shingles", "component_id", kept)
