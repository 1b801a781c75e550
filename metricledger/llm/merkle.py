"""Merkle manifest of a dataset: built levels are stored, a recursive query climbs them for every leaf.

Rows are the leaves of a binary tree for each language; the roots of these trees are, in the order of the languages, the leaves of
one more tree. A node is the SHA-256 of its children's hex digests, one after the other; the last node of a level may have one child.

*Order.* Leaves are range-partitioned by (language, doc_id, leaf) and numbered where they stand. A language that holds most rows
lies in many partitions; its parts are put together by their counts, so no task holds a language.

*Stored levels.* ``SPAN`` levels are built at once: 256 neighbours become a block, written with all digests between them and their
common ancestor. Blocks are rows of the next ones, until a tree has one node. A node row, cut from the stored blocks, holds a
node's siblings on the way to its ancestor ``SPAN`` levels up, and the link to that ancestor's own row; the last row of a language's
tree links to its place in the tree of languages.

*Climb.* ``WITH RECURSIVE``: a leaf, original or changed, starts with the siblings in its own block; each round follows the link, appends the
siblings that it finds there and folds the digest with them, until there is no link. That is one round for ``SPAN`` levels: three or four for
billions of rows. Near the top very many leaves follow one link; node rows are sent to all tasks up to ``SENT_NODES`` of them, beyond that adaptive
execution splits the skewed join.

* A null field counts as ``-`` and differs from an empty one. Null languages come first and are a tree of their own; null doc_ids come first in theirs.
* Repeated rows are leaves of their own; leaves with equal doc_id are ordered by digest, so results are the same on every run.
* An empty table gives an empty result. A table with one row has that row's leaf as its root, and an empty proof.
* Only doc_id, source, lang, n_chars and text are read; other columns may be called anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricledger.llm.common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SPAN = 8
#: Node rows (about 300 bytes each) up to which they are sent to all tasks.
SENT_NODES = 100_000
#: The number of the tree of languages; other trees are numbered from 0 up.
TOP = -1
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def leaf_of(fields: list[Column]) -> Column:
    """Hex digest of a row: every field as its UTF-8 length, a colon and the value, or ``-``."""
    texts = [f.cast("string") for f in fields]
    coded = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*coded), 256)


def is_tampered(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, seen of every row: the digest, and that of the row after one is added to n_chars where the key says so."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    more = F.col("n_chars").cast("decimal(20,0)") + F.lit(1).cast("decimal(20,0)")
    changed = leaf_of([more if f == "n_chars" else F.col(f) for f in FIELDS])
    leaf = leaf_of([F.col(f) for f in FIELDS])
    return rows.select("doc_id", "lang", F.unhex(leaf).alias("leaf"), F.unhex(F.when(is_tampered(F.col("doc_id")), changed)).alias("changed"))


def in_order(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds tree (number of the group, ascending with it), pos (from 0 within it) and n (rows of the group)."""
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = written(ranged.withColumn("place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("place", 33)
    # a row for each partition and each group in it: at most their number together
    runs = placed.groupBy(F.col(group).alias("of"), part.alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    all_runs = Window.partitionBy("of")
    before = all_runs.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "of",
        "part",
        F.min("first").over(all_runs).alias("tree"),
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(all_runs).alias("n"),
    )
    joined = placed.join(runs, placed[group].eqNullSafe(runs["of"]) & (part == runs["part"]))
    return joined.withColumn("pos", F.col("place") + F.col("shift")).drop("place", "shift", "of", "part")


def _steps(n: str, segment: int) -> Column:
    """Levels of a segment that a tree of n leaves has."""
    height = F.when(F.col(n) > 1, F.length(F.bin(F.col(n) - 1))).otherwise(0)
    return F.least(F.lit(SPAN), F.greatest(height - SPAN * segment, F.lit(0)))


_UP = """transform(sequence(0, (size(element_at(acc, -1)) - 1) div 2), i -> sha2(concat(
             element_at(acc, -1)[2 * i], coalesce(get(element_at(acc, -1), 2 * i + 1), '')), 256))"""
_LEVELS = f"""aggregate(slice(sequence(1, {SPAN}), 1, steps), array(transform(members, m -> lower(hex(m.h)))),
                        (acc, j) -> concat(acc, array({_UP})))"""
_SIBLINGS = f"""transform(slice(sequence(0, {SPAN - 1}), 1, steps), j -> struct(
                    (shiftright(i, j) & 1) = 1 AS left, get(levels[j], shiftright(i, j) ^ 1) AS h))"""


def _blocks(nodes: DataFrame, segment: int) -> DataFrame:
    """tree, n, block, steps, members (in order), levels: 256 neighbours each. ``nodes``: tree, n, pos, h and what goes with a node."""
    member = F.struct("pos", "h", *(c for c in nodes.columns if c not in ("tree", "n", "pos", "h")))
    grouped = nodes.groupBy("tree", "n", F.shiftright("pos", SPAN).alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    levels = grouped.withColumn("steps", _steps("n", segment)).withColumn("levels", F.expr(_LEVELS))
    return levels.withColumn("levels", F.expr("transform(levels, l -> transform(l, x -> unhex(x)))"))


def _node_rows(blocks: DataFrame, segment: int) -> DataFrame:
    """One row for each node at the foot of a segment: its siblings on the way up, its place and the link to the next row."""
    rows = blocks.select("tree", "block", "steps", "levels", _last(segment).alias("last"), F.posexplode("members").alias("i", "m"))
    return rows.select(
        "tree",
        F.lit(segment).alias("segment"),
        "m.*",
        F.expr(_SIBLINGS).alias("siblings"),
        F.when(~F.col("last"), F.col("tree")).alias("to_tree"),
        F.lit(segment + 1).alias("to_segment"),
        F.col("block").alias("to_pos"),
    )


def _last(segment: int) -> Column:
    return _steps("n", segment + 1) == 0


@dataclass(frozen=True)
class Forest:
    """Stored blocks by segment, and a row with its root for each tree."""

    segments: list[DataFrame]
    roots: DataFrame

    def upper(self) -> list[DataFrame]:
        return [_node_rows(blocks, s).select("tree", "segment", "pos", "siblings", "to_tree", "to_segment", "to_pos") for s, blocks in enumerate(self.segments) if s]

    def feet(self) -> DataFrame:
        return _node_rows(self.segments[0], 0)


def build(nodes: DataFrame) -> Forest:
    """All levels of all trees. ``nodes``: tree, n, pos, h, and columns that go with a leaf."""
    segments, roots, segment = [], None, 0
    while True:
        blocks = written(_blocks(nodes, segment), f"blocks{segment}")
        segments.append(blocks)
        tops = blocks.select("tree", "n", F.col("block").alias("pos"), F.expr("levels[steps][0]").alias("h"), _last(segment).alias("last"))
        done = tops.where("last").select("tree", F.col("h").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        nodes, segment = tops.where("NOT last").drop("last"), segment + 1
        if nodes.isEmpty():
            return Forest(segments, written(roots, "roots"))


@dataclass(frozen=True)
class Manifest:
    """``languages``: the trees of the rows; ``top``: the tree of their roots; ``subroots``: tree, subroot, and its place in the top tree."""

    languages: Forest
    top: Forest
    subroots: DataFrame
    root: str | None


def manifest(rows: DataFrame) -> Manifest:
    """Builds both storeys. ``rows``: doc_id, lang, leaf and columns that go with a leaf."""
    ordered = in_order(written(rows, "leaves"), "lang", ["doc_id", "leaf"])
    languages = build(ordered.withColumnRenamed("leaf", "h").drop("lang"))
    subroots = languages.roots.select(F.lit(TOP).cast("long").alias("all"), F.col("tree").alias("language"), F.col("root").alias("h"))
    placed = written(in_order(subroots, "all", ["language"]).withColumn("tree", F.lit(TOP).cast("long")).drop("all"), "subroots")
    top = build(placed)
    root = top.roots.select(F.lower(F.hex("root")).alias("root")).first()
    named = placed.select(F.col("language").alias("tree"), F.col("h").alias("subroot"), F.col("pos").alias("top_pos"))
    return Manifest(languages, top, named, root and root["root"])


_FOLD = """aggregate({siblings}, {folded}, (f, s) -> unhex(sha2(CASE WHEN s.h IS NULL THEN lower(hex(f)) WHEN s.left THEN lower(hex(concat(s.h, f)))
                     ELSE lower(hex(concat(f, s.h))) END, 256)))"""
_APPEND = "aggregate({siblings}, {proof}, (p, s) -> CASE WHEN s.h IS NULL THEN p ELSE concat(p, s.h) END)"


def climb(made: Manifest, seen: str) -> DataFrame:
    """doc_id, tree, leaf, folded, proof of every leaf: ``seen`` (null: the leaf) folded with the stored siblings up to the root."""
    tops = made.subroots.select("tree", "top_pos")

    def linked(rows: DataFrame) -> DataFrame:
        """The last row of a language's tree links to the tree of languages."""
        to = rows.join(tops, "tree", "left")
        up = F.col("to_tree").isNull()
        return to.select(
            *(c for c in rows.columns if not c.startswith("to_")),
            F.coalesce("to_tree", F.lit(TOP).cast("long")).alias("to_tree"),
            F.when(up, 0).otherwise(F.col("to_segment")).alias("to_segment"),
            F.when(up, F.col("top_pos")).otherwise(F.col("to_pos")).alias("to_pos"),
        )

    own = ["tree", "segment", "pos", "siblings", "to_tree", "to_segment", "to_pos"]
    nodes = made.top.feet().select(own)
    for rows in made.top.upper():
        nodes = nodes.unionByName(rows)
    for rows in made.languages.upper():
        nodes = nodes.unionByName(linked(rows).select(own))
    nodes = written(nodes, "node_rows")
    sent = F.broadcast(nodes) if nodes.count() <= SENT_NODES else nodes
    feet = linked(made.languages.feet())
    spark = nodes.sparkSession
    query = f"""
        WITH RECURSIVE climb (doc_id, tree, leaf, folded, proof, to_tree, to_segment, to_pos) AS (
            SELECT doc_id, tree, h, {_FOLD.format(siblings="siblings", folded=f"coalesce({seen}, h)")}, {_APPEND.format(siblings="siblings", proof="X''")},
                   to_tree, to_segment, to_pos
            FROM {{feet}}
            UNION ALL
            SELECT c.doc_id, c.tree, c.leaf, {_FOLD.format(siblings="n.siblings", folded="c.folded")}, {_APPEND.format(siblings="n.siblings", proof="c.proof")},
                   n.to_tree, n.to_segment, n.to_pos
            FROM climb c JOIN {{nodes}} n ON n.tree = c.to_tree AND n.segment = c.to_segment AND n.pos = c.to_pos
        )
        SELECT doc_id, tree, leaf, folded, proof FROM climb WHERE to_tree IS NULL"""
    # the rows of a climb are those of the table, so the limit on rows of a recursive query is lifted while it runs
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return written(spark.sql(query, feet=feet, nodes=sent), "climbed")
    finally:
        spark.conf.set(ROW_LIMIT, limit)


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (as stored), folded_root (of the row as it is seen, climbed) and whether they agree."""
    made = manifest(leaves(docs))
    rows = climb(made, "changed").join(made.subroots.select("tree", "subroot"), "tree")
    text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "folded")}
    root = F.lit(made.root).cast("string")
    return rows.select(
        "doc_id",
        text["leaf"].alias("leaf"),
        text["subroot"].alias("subroot"),
        root.alias("root"),
        F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"),
        text["folded"].alias("folded_root"),
        (text["folded"] == root).alias("verified"),
    )
