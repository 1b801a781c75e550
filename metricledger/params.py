"""Request parameters shared by the reads."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

DEFAULT_WINDOW = dt.timedelta(days=30)


@dataclass(frozen=True)
class TimeRange:
    """UTC wall-clock window; which ends are included depends on the read."""

    start: dt.datetime
    end: dt.datetime

    @classmethod
    def of(cls, start: str, end: str) -> TimeRange:
        return cls(dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end))

    @classmethod
    def default(cls, now: dt.datetime | None = None) -> TimeRange:
        """The last 30 days."""
        now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        return cls(now - DEFAULT_WINDOW, now)

    @classmethod
    def fill(cls, start: dt.datetime | None, end: dt.datetime | None, now: dt.datetime | None = None) -> TimeRange:
        """Missing ends take the default window's."""
        base = cls.default(now)
        return cls(start or base.start, end or base.end)

    @property
    def length(self) -> dt.timedelta:
        return self.end - self.start

    def previous(self) -> TimeRange:
        """The window of the same length that ends where this one starts."""
        return TimeRange(self.start - self.length, self.end - self.length)


@dataclass(frozen=True)
class PageRequest:
    """One page of a listing: which rows, in which order."""

    page: int = 1
    size: int = 10
    sort_by: str = ""
    order: str = "desc"
    filter: str = ""
