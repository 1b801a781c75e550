"""The dictionary of a streamed log, as runs of texts that are merged while batches come in.

Batch ``n`` adds run ``n`` of level 0: the texts that no earlier batch held. Sixteen runs of a level are merged into one of the
next, so run ``m`` of level ``j`` holds the texts of the batches from ``m * 16**j`` to ``(m + 1) * 16**j``. Which runs make up the
batches before ``n`` follows from ``n`` alone; there is no list of runs to keep, and a repeated batch reads and writes the same ones.
A batch reads at most 15 runs of each level, and a text is rewritten once a level.

Runs above level 0 lie in folders by the hash of the text. A batch with few texts reads only the folders that may hold them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricledger.operators import enrich
from metricledger.sources import folders

#: Runs of a level that are merged into one of the next.
WIDTH = 16
#: Folders by hash. Fixed for the life of a dictionary.
PARTS = 64


def runs_before(batch: int, width: int = WIDTH) -> list[tuple[int, int]]:
    """(level, run) pairs that together hold the batches before this one, each once, widest first."""
    level = 0
    while width ** (level + 1) <= batch:
        level += 1
    found, at = [], 0
    for level in range(level, -1, -1):
        span = width**level
        while at + span <= batch:
            found.append((level, at // span))
            at += span
    return found


def merges_at(batch: int, width: int = WIDTH) -> list[tuple[int, int]]:
    """Runs that become complete when this batch begins, lowest level first."""
    found, level = [], 1
    while batch and batch % width**level == 0:
        found.append((level, batch // width**level - 1))
        level += 1
    return found


class DictionaryRuns:
    def __init__(self, spark: SparkSession, root: str, width: int = WIDTH, parts: int = PARTS):
        self.spark, self.root, self.width, self.parts = spark, root, width, parts
        empty = spark.createDataFrame([], "query_param string")
        self.schema = enrich.expression_dictionary(empty).schema
        self._stored = T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())])

    def _path(self, level: int, run: int) -> str:
        return f"{self.root}/level={level}/run={run}"

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("query_param"), F.lit(self.parts)).cast("int").alias("part")

    def _read(self, runs: Sequence[tuple[int, int]]) -> DataFrame:
        rows = self.spark.createDataFrame([], self._stored)
        for chosen in ([r for r in runs if r[0] == 0], [r for r in runs if r[0] > 0]):  # without and with folders by hash
            if chosen:
                read = self.spark.read.schema(self._stored).option("basePath", self.root)
                rows = rows.unionByName(read.parquet(*[self._path(*r) for r in chosen]).select(*self._stored.names))
        return rows

    def _write(self, rows: DataFrame, level: int, run: int) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy("part") if level else writer).parquet(self._path(level, run))

    def settle(self, batch: int) -> None:
        """Before batch ``batch``: merges the runs that are complete, and removes those merged before the last batch, which is committed by now."""
        for level, run in merges_at(batch, self.width):
            inner = [(level - 1, run * self.width + i) for i in range(self.width)]
            self._write(self._read(inner).hint("rebalance", F.col("part")), level, run)
        for level, run in merges_at(batch - 1, self.width):
            for i in range(self.width):
                folders.remove(self.spark, self._path(level - 1, run * self.width + i))

    def known(self, texts: DataFrame, batch: int) -> DataFrame:
        """Each text (column ``query_param``) with its row of the dictionary as it was before the batch; ``part`` is null where it has none."""
        touched = [r.part for r in texts.select(self._part()).distinct().collect()]  # at most ``parts`` numbers
        rows = self._read(runs_before(batch, self.width)).where(F.col("part").isin(touched))
        return texts.select("query_param").join(rows, "query_param", "left").select(*self._stored.names)

    def add(self, fresh: DataFrame, batch: int) -> DataFrame:
        """Stores the batch's new texts and gives them as stored."""
        self._write(fresh.select(*self.schema.names, self._part()), 0, batch)
        return self._read([(0, batch)]).select(*self.schema.names)

    def all(self, batch: int) -> DataFrame:
        """The whole dictionary as it was before the batch."""
        return self._read(runs_before(batch, self.width)).select(*self.schema.names)
