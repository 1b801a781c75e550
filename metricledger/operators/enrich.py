"""Query enrichment: identity and label matchers.

A log repeats few texts many times, so the expressions run once per distinct text. The
dictionary of texts is a table: it is written (or persisted) first, so the join knows its real
size. Spark then broadcasts it when it is below ``spark.sql.autoBroadcastJoinThreshold``; otherwise
the log side is shuffled and a text that holds a large share of the log is split by the adaptive
skew join. A dictionary computed inside the same plan would get neither: the log is shuffled
before its size shows, and the skew join only splits plain shuffles.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricledger.functions import promql
from metricledger.operators.filters import names_of, selector_names
from metricledger.session import new_table_path

IDENTITY_COLUMNS = ["fingerprint", "label_matchers", "metric_names"]


@lru_cache(maxsize=8)
def _describe(_application: str, column: str) -> Column:
    return promql.describe(F.col(column))


def _described(df: DataFrame, column: str) -> DataFrame:
    key = df.sparkSession.sparkContext.applicationId
    return df.withColumn("_d", _describe(key, column))


def distinct_texts(log: DataFrame) -> DataFrame:
    """The texts of a log, each once; a missing text counts as the empty one."""
    return log.select(F.coalesce(F.col("query_param"), F.lit("")).alias("query_param")).distinct()


def described_shapes(texts: DataFrame) -> DataFrame:
    """(shape, _of): the shapes of texts, each once, and their descriptions.

    A task gets the same number of shapes whatever their bytes: adaptive execution would put small texts that are costly to describe
    into few tasks. A repartition by the shape itself would be dropped, the distinct shapes lie that way already."""
    spread = texts.select("shape").distinct().repartition(_tasks(texts), F.xxhash64("shape"))
    return _described(spread, "shape").withColumnRenamed("_d", "_of")


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def expression_dictionary(log: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per distinct text with its identity, with and without ranges, and its matchers.

    Texts that differ in metric names and label values only have one shape (:func:`promql.shape`), which is described once; the
    names and values are put back in. Shapes are joined by a plain shuffle: adaptive execution broadcasts them while they are
    small, and otherwise splits a shape that many texts have.

    Identities never change, so with a ``known`` dictionary only new texts are worked out and
    returned; the whole dictionary is the union of both.
    """
    texts = distinct_texts(log)
    if known is not None:
        texts = texts.join(known.select("query_param"), "query_param", "left_anti")
    if log.isStreaming:
        rows = _described(texts, "query_param")
    else:
        shaped = texts.repartition(_tasks(log), F.xxhash64("query_param")).withColumn("_s", promql.shape(F.col("query_param")))
        # never null, so Spark does not look for nulls in the shapes of all rows of the log
        shaped = shaped.select("query_param", "_s", F.coalesce("_s.shape", F.lit("")).alias("shape"))
        rows = shaped.join(described_shapes(shaped), "shape", "left").withColumn("_d", promql.filled(F.col("_of"), F.col("_s.held")))
    return rows.select(
        "query_param",
        F.col("_d.canonical").alias("canonical"),
        promql.hash_identity(F.col("_d.canonical")).alias("fingerprint"),
        F.col("_d.canonical_any_range").alias("canonical_any_range"),
        promql.hash_identity(F.col("_d.canonical_any_range")).alias("fingerprint_any_range"),
        F.col("_d.matchers").alias("label_matchers"),
        names_of(F.col("_d.matchers")).alias("metric_names"),
    )


def stored_dictionary(log: DataFrame, path: str | None = None) -> DataFrame:
    """The dictionary written to the shared folder and read back."""
    spark: SparkSession = log.sparkSession
    path = path or new_table_path(spark, "expressions")
    expression_dictionary(log).write.parquet(path)
    return spark.read.parquet(path)


def _join_identity(log: DataFrame, dictionary: DataFrame, columns: list[str]) -> DataFrame:
    keep = [c for c in log.columns if c not in columns]
    return log.select(*keep).join(dictionary.select("query_param", *columns), "query_param", "left").select(
        *keep, *columns
    )


def with_fingerprint(log: DataFrame, dictionary: DataFrame, ignore_ranges: bool = False) -> DataFrame:
    suffix = "_any_range" if ignore_ranges else ""
    picked = dictionary.select(
        "query_param",
        F.col(f"canonical{suffix}").alias("canonical"),
        F.col(f"fingerprint{suffix}").alias("fingerprint"),
    )
    return _join_identity(log, picked, ["canonical", "fingerprint"])


def with_label_matchers(log: DataFrame, dictionary: DataFrame) -> DataFrame:
    return _join_identity(log, dictionary, ["label_matchers", "metric_names"])


def enrich(log: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Log with fingerprint, label matchers and metric names; invalid texts share ``''`` and NULL."""
    joined = _join_identity(log, dictionary, IDENTITY_COLUMNS)
    return joined.withColumn("fingerprint", F.coalesce(F.col("fingerprint"), F.lit("")))


def enrich_inline(log: DataFrame) -> DataFrame:
    """The same without a join: the expressions run on every row.

    For streams and small batches; no shuffle, but repeated texts are worked out repeatedly.
    """
    keep = [c for c in log.columns if c not in IDENTITY_COLUMNS]
    return _described(log, "query_param").select(
        *keep,
        promql.hash_identity(F.col("_d.canonical")).alias("fingerprint"),
        F.col("_d.matchers").alias("label_matchers"),
        names_of(F.col("_d.matchers")).alias("metric_names"),
    )


#: What the reads by metric need of a record.
METRIC_LOG = ["query_id", "ts", "query_param", "fingerprint", "type", "duration_ms", "status_code", "total_queryable_samples", "peak_samples"]


def metric_log(log: DataFrame) -> DataFrame:
    """One narrow row for each record and metric that it names: ``metric``, whether its first selector has it, and what reads
    by metric need. Stored sorted by metric, it answers them without scanning the log."""
    names = F.array_distinct(F.filter(selector_names(log), lambda n: n.isNotNull()))
    rows = log.select(*METRIC_LOG, F.get(selector_names(log), F.lit(0)).alias("_first"), F.explode(names).alias("metric"))
    return rows.withColumn("is_first", F.coalesce(F.col("metric") == F.col("_first"), F.lit(False))).drop("_first")


def metric_refs(log: DataFrame, key: str = "query_id") -> DataFrame:
    """(query, metric) pairs; the narrow table that answers "which queries name this metric"."""
    names = F.array_distinct(F.filter(selector_names(log), lambda n: n.isNotNull()))
    return log.select(key, F.explode(names).alias("metric"))
