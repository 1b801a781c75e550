"""Small Column helpers shared by the function modules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A character that no text to be split holds.
_CUT = "\u0001"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Repeating a costly Column inside an expression repeats its evaluation;
    a one-element ``transform`` names it instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ntz(value: dt.datetime | str) -> Column:
    """UTC wall-clock literal, independent of the session time zone."""
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def percent(part: Column, whole: Column) -> Column:
    """``part / whole`` as a percentage rounded to two places, NULL over an empty whole."""
    ratio = part.cast("double") * F.lit(100.0) / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.round(ratio, 2)


def split_at(text: Column, pattern: str) -> Column:
    """The parts of a text between the matches of ``pattern``.

    ``split`` compiles its pattern for every row unless it is a single plain character, ``regexp_replace`` once: the matches become
    that character first. The text must not hold it itself.
    """
    return F.split(F.regexp_replace(text, pattern, _CUT), _CUT, -1)


def split_keep(text: Column, pattern: str, on_match: Callable[[Column, Column], Column]) -> Column:
    """Rewrite every match of ``pattern`` with ``on_match(match, index)``; the rest stays."""

    def rewrite(t: Column) -> Column:
        gaps = split_at(t, pattern)
        hits = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), on_match)
        return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")

    return bind(text, rewrite)
