"""Minimax contiguous sharding.

Documents with equal texts are one atomic group. Groups are ordered by the MD5 of their text, and the
ordered row of group sizes is cut into ``n`` contiguous shards whose largest is as small as any such
cut allows. The smallest feasible capacity is found by binary search; a capacity is checked greedily.

The search never needs all groups at once. It starts from the sizes of 4 096 cells of the digest range and
lets the greedy check cut *inside* a cell, which can only make a capacity look more feasible than it is. The
smallest capacity feasible in this sense is a lower bound. If its cuts meet no cell of several groups, it is the
exact optimum; else the (at most ``n - 1``) cells it cuts are split in 256, and the search is repeated. So the
driver holds some thousand cells, whatever the number of documents.

The cuts are digests, so a document's shard is an expression over its text: no join carries it back.
All of it is DataFrame operations.

* Null texts: size 1, CRC 0, a group of their own. Empty texts: size 1, another group.
* Repeated rows: each is a row of its own with its own slot.
* An empty table gives an empty result.
* Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricledger.llm.common import texts, written

#: Hex digits of a digest that name a first cell, and that a split adds.
FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Rows that are numbered together.
SLOT_ROWS = 2_048


@dataclass(frozen=True)
class Cell:
    """The groups whose digest begins with ``prefix``."""

    prefix: str
    groups: int
    size: int


def digest(text: Column) -> Column:
    """The order of groups; null texts come first."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def _greedy(cells: list[Cell], ends: list[int], capacity: int, shards: int) -> tuple[bool, list[int], list[int]]:
    """Whether ``shards`` of this capacity suffice, the cells that start a new shard, and the cells cut inside."""
    at, starts, inside = 0, [], []
    for _ in range(shards):
        target = at + capacity
        if target >= ends[-1]:
            return True, starts, inside
        i = bisect_right(ends, target)  # the cell that holds the target, or begins there
        begin = ends[i] - cells[i].size
        if begin < target and cells[i].groups > 1:
            inside.append(i)
            at = target
        elif begin <= at:
            return False, starts, inside  # one group larger than the capacity
        else:
            starts.append(i)
            at = begin
    return False, starts, inside


def _smallest(cells: list[Cell], shards: int) -> tuple[int, list[int], list[int]]:
    ends, total = [], 0
    for c in cells:
        total += c.size
        ends.append(total)
    low, high = -(-total // shards), total
    while low < high:
        middle = (low + high) // 2
        if _greedy(cells, ends, middle, shards)[0]:
            high = middle
        else:
            low = middle + 1
    return low, *_greedy(cells, ends, low, shards)[1:]


def _cells(groups: DataFrame, split: list[str] | None) -> list[Cell]:
    if split is None:
        cell, wanted = F.substring("digest", 1, FIRST_DIGITS), F.lit(True)
    else:
        cell, wanted = F.lit(None).cast("string"), F.lit(False)
        for p in split:
            cell = F.when(F.col("digest").startswith(p), F.substring("digest", 1, len(p) + MORE_DIGITS)).otherwise(cell)
            wanted = wanted | F.col("digest").startswith(p)
    rows = groups.where(wanted).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    return [Cell(r["cell"], r["n"], r["size"]) for r in rows]


def cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity, and the digests at which shards 1, 2, ... begin. ``groups``: digest, size."""
    cells = sorted(_cells(groups, None), key=lambda c: c.prefix)
    while cells:
        capacity, starts, inside = _smallest(cells, shards)
        if not inside:
            return capacity, [cells[i].prefix for i in starts]
        split = {cells[i].prefix for i in inside}
        cells = sorted([c for c in cells if c.prefix not in split] + _cells(groups, sorted(split)), key=lambda c: c.prefix)
    return 0, []


def shard_of(text_digest: Column, starts: list[str]) -> Column:
    shard = F.lit(0)
    for s in starts:
        shard = shard + (text_digest >= s).cast("int")
    return shard


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, digest, shard, slot of every row; slots are gapless from 0 in each shard."""
    text = F.col("text")
    rows = written(
        texts(docs).select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            digest(text).alias("digest"),
        ),
        "shard_rows",
    )
    groups = written(
        rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count("*").alias("n")).repartitionByRange("digest").sortWithinPartitions("digest"),
        "shard_groups",
    )
    _, starts = cuts(groups, shards)
    shard = shard_of(F.col("digest"), starts)
    held = {r["shard"]: r["n"] for r in groups.groupBy(shard.alias("shard")).agg(F.sum("n").alias("n")).collect()}
    buckets = F.array(*(F.lit(held.get(s, 0) // SLOT_ROWS + 1) for s in range(shards)))
    dealt = rows.withColumn("shard", shard).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.element_at(buckets, F.col("shard") + 1)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest", "size")
    return (
        dealt.withColumn("number", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "digest", "shard", (F.col("before") + F.col("number")).cast("long").alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, text: str = "text") -> None:
    """The documents themselves, one folder a shard. A column called ``shard`` is replaced."""
    groups = docs.groupBy(digest(F.col(text)).alias("digest")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1).alias("size"))
    _, starts = cuts(written(groups, "shard_groups"), shards)
    docs.withColumn("shard", shard_of(digest(F.col(text)), starts)).write.partitionBy("shard").parquet(path)
