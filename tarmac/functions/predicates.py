"""Filters as Column predicates; user choices never become SQL text."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity_in(selected: Sequence[str], column: str = "collision_severity") -> Column:
    """Sidebar severity choice: nothing chosen means nothing is returned."""
    if not selected:
        return F.lit(False)
    return F.col(column).isin(*selected)


def any_of(column: str, selected: Sequence | None) -> Column | None:
    """Optional multi-choice filter: nothing chosen means no filter."""
    return F.col(column).isin(*selected) if selected else None


def equal_unless_all(column: str, choice: str | None) -> Column | None:
    """Optional single-choice filter where ``All`` means no filter."""
    return None if choice in (None, "All") else F.col(column) == choice


def all_of(*parts: Column | None) -> Column:
    """Conjunction of the given predicates, skipping the absent ones."""
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


@dataclass(frozen=True)
class TimeFilter:
    """A year, a month of a year, or an inclusive date range."""

    year: int | None = None
    month: int | None = None
    start: dt.date | str | None = None
    end: dt.date | str | None = None

    def column(self, date: str = "date", year: str = "year") -> Column:
        if self.start is not None and self.end is not None:
            low, high = (F.lit(str(x)).cast("date") for x in (self.start, self.end))
            return F.col(date).between(low, high)
        if self.year is None:
            raise ValueError("choose a year or a start and end date")
        wanted = F.col(year) == self.year
        return wanted if self.month is None else wanted & (F.month(F.col(date)) == self.month)
