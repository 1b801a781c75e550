"""Sorting, paging and paged results."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from metricledger.functions.expr_tools import ntz
from metricledger.params import PageRequest

DEFAULT_SIZE = 10
MAX_SIZE = 100
MAX_METADATA_SIZE = 10_000


def sort_keys(
    fields: dict[str, Column], default: str, sort_by: str = "", order: str = "desc", ties: Sequence[str] = ()
) -> list[Column]:
    """Sort columns for a requested field and direction.

    Unknown fields fall back to ``default``, unknown directions to descending. NULLs come last
    both ways, and ``ties`` makes the order total, so that pages never overlap.
    """
    field = fields.get(sort_by.strip(), fields[default])
    ascending = (order or "").strip().lower() == "asc"
    first = field.asc_nulls_last() if ascending else field.desc_nulls_last()
    return [first, *[F.col(t).asc_nulls_last() for t in ties]]


def safe_order_by(
    df: DataFrame, fields: dict[str, Column], default: str, sort_by: str = "", order: str = "desc", ties=()
) -> DataFrame:
    return df.orderBy(*sort_keys(fields, default, sort_by, order, ties))


def clamp_page(page: int, size: int, cap: int = MAX_SIZE, default: int = DEFAULT_SIZE) -> tuple[int, int]:
    return max(page, 1), min(size if size > 0 else default, cap)


def paginate(df: DataFrame, keys: Sequence[Column], page: int, size: int, cap: int = MAX_SIZE) -> DataFrame:
    """Rows of one page in the order of ``keys``.

    A top-k: every task sends its first rows up to the page. To read many pages, or pages far behind, write the order once
    with :func:`write_sorted` and cut pages from that table.
    """
    page, size = clamp_page(page, size, cap)
    return df.orderBy(*keys).offset((page - 1) * size).limit(size)


def write_sorted(df: DataFrame, keys: Sequence[Column], path: str) -> None:
    """A job of its own: the rows in the order of ``keys``, each with its partition and its place in it."""
    place = F.monotonically_increasing_id()
    df.orderBy(*keys).withColumns(
        {"_part": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}
    ).write.parquet(path)


def sorted_page(rows: DataFrame, offset: int, size: int) -> DataFrame:
    """Rows ``offset .. offset + size`` of what :func:`write_sorted` has written, with their ``position``.

    Counts per partition, one small row each, tell where every partition starts; no task holds the rows before the page.
    """
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = rows.join(F.broadcast(starts), "_part").withColumn("position", F.col("_start") + F.col("_place"))
    page = placed.where((F.col("position") >= offset) & (F.col("position") < offset + size))
    return page.orderBy("position").drop("_part", "_place", "_start")


def with_position(page: DataFrame, keys: Sequence[Column], offset: int = 0) -> DataFrame:
    """The rows of a page with their place in the whole order, from 0. A page is bounded, so one task numbers it."""
    return page.withColumn("position", F.row_number().over(Window.orderBy(*keys)).cast("long") - 1 + offset)


def total_pages(total: Column | int, size: int) -> Column | int:
    if isinstance(total, int):
        return -(-total // size)
    return F.ceil(total / F.lit(size)).cast("long")


def with_total(df: DataFrame, name: str = "total_count") -> DataFrame:
    """Every row with the number of rows, which is a scalar subquery of its own."""
    return df.withColumn(name, df.agg(F.count(F.lit(1))).scalar())


@dataclass
class Page:
    """``data`` holds the page, ``counts`` one row with ``total`` and ``total_pages``; ``keys`` order the page."""

    data: DataFrame
    counts: DataFrame
    keys: Sequence[Column] = ()
    offset: int = 0

    def positioned(self) -> DataFrame:
        return with_position(self.data, self.keys, self.offset)

    def as_result(self) -> DataFrame:
        """Page rows as one array, in their order, in a single ``{total, total_pages, data}`` row.

        The array is bounded by the page size, never by the table.
        """
        placed = self.positioned().select("position", F.struct(*self.data.columns).alias("row"))
        rows = placed.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "row"))), lambda x: x["row"]))
        return self.counts.withColumn("data", rows.scalar())

    def write_json(self, path: str) -> None:
        self.as_result().write.mode("errorifexists").json(path)


def page_of(
    rows: DataFrame,
    request: PageRequest,
    fields: dict[str, Column],
    default: str,
    ties: Sequence[str],
    cap: int = MAX_SIZE,
    counted: DataFrame | None = None,
) -> Page:
    """Sort, cut and count. ``counted`` replaces the row count where the total differs."""
    page, size = clamp_page(request.page, request.size, cap)
    keys = sort_keys(fields, default, request.sort_by, request.order, ties)
    total = counted if counted is not None else rows.agg(F.count(F.lit(1)).alias("total"))
    counts = total.select(F.col("total"), total_pages(F.col("total"), size).alias("total_pages"))
    return Page(paginate(rows, keys, request.page, request.size, cap), counts, keys, (page - 1) * size)


# ---- keyset paging ----------------------------------------------------------------------
@dataclass(frozen=True)
class Order:
    """A total order: one sort column, then ascending ties that make it unique. NULLs come last both ways."""

    first: Column
    ascending: bool
    ties: tuple[str, ...]

    @classmethod
    def of(cls, fields: dict[str, Column], default: str, request: PageRequest, ties: Sequence[str]) -> Order:
        field = fields.get(request.sort_by.strip(), fields[default])
        return cls(field, (request.order or "").strip().lower() == "asc", tuple(ties))

    def _parts(self) -> list[tuple[Column, bool]]:
        return [(self.first, self.ascending), *((F.col(t), True) for t in self.ties)]

    def values(self) -> Column:
        return F.struct(*[c.alias(f"k{i}") for i, (c, _) in enumerate(self._parts())])

    def keys(self) -> list[Column]:
        return [c.asc_nulls_last() if up else c.desc_nulls_last() for c, up in self._parts()]

    def behind(self, cursor: Sequence) -> Column:
        """Rows that follow the row whose key values are ``cursor``."""
        out, same = F.lit(False), F.lit(True)
        for (column, up), value in zip(self._parts(), cursor, strict=True):
            at = ntz(value) if isinstance(value, dt.datetime) else F.lit(value)
            if value is not None:
                out = out | (same & (((column > at) if up else (column < at)) | column.isNull()))
            same = same & column.eqNullSafe(at)
        return out


@dataclass
class Fetched:
    """A page's rows, the number of all rows, and the cursor of the page behind it; None after the last."""

    rows: list[Row]
    total: int
    cursor: tuple | None


def keyset_page(rows: DataFrame, order: Order, size: int, after: Sequence | None = None) -> DataFrame:
    """The first ``size`` rows behind ``after``. Its cost does not grow with the pages before, unlike an offset's."""
    wanted = rows if after is None else rows.where(order.behind(after))
    return wanted.orderBy(*order.keys()).limit(size)


def fetch_page(rows: DataFrame, order: Order, size: int = DEFAULT_SIZE, after: Sequence | None = None, cap: int = MAX_SIZE) -> Fetched:
    """Page and total in one pass: rows are counted while they flow into the top-k, so their plan runs once.

    What comes to the driver is bounded by the page size.
    """
    _, size = clamp_page(1, size, cap)
    seen = Observation()
    counted = rows.withColumn("_key", order.values()).observe(seen, F.count(F.lit(1)).alias("total"))
    got = keyset_page(counted, order, size + 1, after).collect()
    page, more = got[:size], len(got) > size
    names = rows.columns
    return Fetched([Row(**{n: r[n] for n in names}) for r in page], seen.get["total"], tuple(page[-1]["_key"]) if more else None)
