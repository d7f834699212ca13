"""Pages by a continuation key: the place where the last page ended, pushed down as a filter, instead of rows that are sorted and thrown away."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


@dataclass(frozen=True)
class By:
    """A column of an order. Nulls come first or last, by default where Spark has them: first when ascending, last when descending."""

    column: str
    descending: bool = False
    nulls_first: bool | None = None

    @property
    def first(self) -> bool:
        return not self.descending if self.nulls_first is None else self.nulls_first

    def order(self) -> Column:
        c = F.col(self.column)
        return (c.desc_nulls_first() if self.first else c.desc_nulls_last()) if self.descending else c.asc_nulls_first() if self.first else c.asc_nulls_last()

    def same(self, value: object) -> Column:
        return F.col(self.column).isNull() if value is None else F.col(self.column) == F.lit(value)

    def beyond(self, value: object) -> Column:
        """Rows that come after those with a value, whatever else they hold."""
        c = F.col(self.column)
        if value is None:
            return c.isNotNull() if self.first else F.lit(False)
        later = c < F.lit(value) if self.descending else c > F.lit(value)
        return later if self.first else later | c.isNull()


def after(rows: DataFrame, order: list[By], size: int, last: Row | dict | None = None) -> DataFrame:
    """The page that follows the row last (None: the first page). order must end with columns that tell any two rows apart. Whichever page it is, a task
    keeps `size` rows and reads what the filter on the first column of the order leaves."""
    if last is not None:
        # (a, b, c) after (x, y, z): a beyond x, or a = x and (b beyond y, or ..); and at any rate a not before x, which a scan can use
        rule = F.lit(False)
        for by in reversed(order):
            rule = by.beyond(last[by.column]) | (by.same(last[by.column]) & rule)
        head = order[0]
        rows = rows.where((head.beyond(last[head.column]) | head.same(last[head.column])) & rule)
    return rows.orderBy(*(by.order() for by in order)).limit(size)


def walked(rows: DataFrame, order: list[By], size: int, pages: int) -> DataFrame:
    """A page by its number, from 0, by way of the pages before it: one row of each comes to the driver."""
    last = None
    for _ in range(pages):
        page = after(rows, order, size, last).collect()
        if len(page) < size:
            return rows.limit(0)
        last = page[-1]
    return after(rows, order, size, last)
