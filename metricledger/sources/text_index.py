"""Trigram index of the catalog: names and help texts by the runs of three characters they hold.

Two tables. *Postings* have a row for each (gram, field, name), in folders by a hash of the gram and sorted by it: a search reads the folders of its grams, and
of their files the row groups. *Rows* is the catalog in folders by a hash of the name: names found are joined to it, and only folders that hold one of
them are read (dynamic partition pruning). What is found is checked with ``ILIKE`` itself, so postings may be too many, never too few.

New texts of a name are added to the postings; those of its old text stay, and the check drops what they find.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricledger.operators.filters import ilike_any
from metricledger.session import new_table_path

FIELDS = ("name", "help")
GRAM = 3
#: Folders of each table. A catalog of some hundred million names wants more.
PARTS = 64
#: Grams that a search looks up; any of a text's grams narrow it down, the check does the rest.
MOST_GRAMS = 12


def grams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-case text, none if it is shorter or null."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - (GRAM - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.when(F.length(low) >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def grams_of_pattern(text: str) -> list[str]:
    """Grams that every match of ``%text%`` holds: of the literal ASCII runs between wildcards.

    Other characters end a run, because databases and languages differ in how they lower-case them.
    """
    runs, run, literal = [], "", False
    for ch in text:
        if ch == "\\" and not literal:
            literal = True
            continue
        if ch.isascii() and (literal or ch not in "%_"):
            run += ch.lower()
        else:
            runs.append(run)
            run = ""
        literal = False
    found = {r[i : i + GRAM] for r in [*runs, run] for i in range(len(r) - GRAM + 1)}
    return sorted(found)


def _part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")


def _postings(catalog: DataFrame) -> DataFrame:
    """part, gram, field, name."""
    fields = [F.struct(F.lit(f).alias("field"), grams(F.col(f)).alias("grams")) for f in FIELDS]
    each = catalog.select("name", F.explode(F.array(*fields)).alias("f"))
    rows = each.select("name", F.col("f.field").alias("field"), F.explode("f.grams").alias("gram"))
    return rows.select(_part(F.col("gram")), "gram", "field", "name")


def _write(rows: DataFrame, path: str, order: str, mode: str) -> None:
    # rebalanced, so that the folder of a very common gram is written by several tasks
    parts = rows.hint("rebalance", "part").sortWithinPartitions("part", order)
    parts.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


class TextIndex:
    """The index of a catalog under ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, catalog: DataFrame) -> TextIndex:
        """Indexes a catalog; ``root`` must be new."""
        _write(_postings(catalog), f"{self.root}/postings", "gram", "error")
        _write(catalog.withColumn("part", _part(F.col("name"))), f"{self.root}/rows", "name", "error")
        return self

    def update(self, changed: DataFrame) -> None:
        """Takes in new and changed catalog rows, one for each name; folders without any of them are left as they are.

        Postings come first: until the rows are there, a search finds what it found before.
        """
        staged = new_table_path(self.spark, "changed_rows")
        changed.select(self._rows().drop("part").columns).withColumn("part", _part(F.col("name"))).write.parquet(staged)
        new = self.spark.read.parquet(staged)
        _write(_postings(new), f"{self.root}/postings", "gram", "append")
        touched = self._rows().join(F.broadcast(new.select("part").distinct()), "part")  # at most PARTS rows
        left = touched.join(new.select("name"), "name", "left_anti").select(new.columns)
        merged = new_table_path(self.spark, "merged_rows")
        left.unionByName(new).write.parquet(merged)  # the folders cannot be read while they are overwritten
        _write(self.spark.read.parquet(merged), f"{self.root}/rows", "name", "overwrite")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def search(self, text: str, fields: Sequence[str] = FIELDS) -> DataFrame:
        """The catalog rows whose fields match ``ILIKE %text%``. Without a gram in the text the rows are scanned."""
        looked_up = grams_of_pattern(text)[:MOST_GRAMS]
        rows = self._rows()
        if not looked_up:
            return ilike_any(rows, fields, text).drop("part")
        keys = self.spark.createDataFrame([(g,) for g in looked_up], "gram string").select(_part(F.col("gram"))).distinct()
        folders = [r["part"] for r in keys.collect()]  # at most MOST_GRAMS
        postings = self.spark.read.parquet(f"{self.root}/postings").where(F.col("part").isin(folders) & F.col("gram").isin(looked_up) & F.col("field").isin(list(fields)))
        # a name's posting may be there once for each of its texts
        hits = postings.groupBy("name", "field", "gram").agg(F.lit(1).alias("one")).groupBy("name", "field").agg(F.sum("one").alias("grams"))
        names = hits.where(F.col("grams") == len(looked_up)).select("name").distinct().withColumn("part", _part(F.col("name")))
        return ilike_any(rows, fields, text).join(names, ["part", "name"], "left_semi").drop("part")
