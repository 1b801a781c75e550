"""Catalog and job-index rows from backend metadata, name lists and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows a metadata entry expands to, as (name suffix, type suffix, help suffix, keeps unit).
METADATA_ROWS = {
    "histogram": (
        ("_bucket", "_bucket", " (histogram buckets)", True),
        ("_count", "_count", " (histogram count)", False),
        ("_sum", "_sum", " (histogram sum)", True),
    ),
    "summary": (
        ("", "", "", True),
        ("_count", "_count", " (summary count)", False),
        ("_sum", "_sum", " (summary sum)", True),
    ),
}


def _row(kind: Column, suffix: str, type_suffix: str, help_suffix: str, unit: bool) -> Column:
    return F.struct(
        F.concat("name", F.lit(suffix)).alias("name"),
        F.concat(kind, F.lit(type_suffix)).alias("type"),
        F.concat("help", F.lit(help_suffix)).alias("help"),
        (F.col("unit") if unit else F.lit("")).alias("unit"),
    )


def catalog_from_metadata(metadata: DataFrame) -> DataFrame:
    """(name, type, help, unit) as the backend reports it -> catalog rows.

    Histograms become their three series, summaries keep the base and add two; every other
    type, known or not, passes through.
    """
    carried = [c for c in metadata.columns if c not in ("name", "type", "help", "unit")]
    rows = F.array(_row(F.col("type"), "", "", "", True))
    for kind, parts in METADATA_ROWS.items():
        rows = F.when(F.col("type") == kind, F.array(*[_row(F.lit(kind), *p) for p in parts])).otherwise(rows)
    return metadata.select(*carried, F.inline(rows))


def first_info(metadata: DataFrame) -> DataFrame:
    """(name, infos ARRAY<STRUCT<type, help, unit>>) -> one row per name, from its first info."""
    return metadata.where(F.size("infos") > 0).select("name", F.col("infos")[0].alias("i")).select("name", "i.*")


def catalog_from_names(names: DataFrame) -> DataFrame:
    """Catalog rows for bare names; names that are not valid UTF-8 are left out."""
    usable = names.where(F.expr("is_valid_utf8(name)")).select("name").distinct()
    blank = F.lit("")
    return usable.select("name", blank.alias("type"), blank.alias("help"), blank.alias("unit"))


def job_index_from_series(series: DataFrame) -> DataFrame:
    """Distinct (name, job) pairs; series without a job are skipped."""
    return series.where(F.col("job") != "").select("name", "job").distinct()
