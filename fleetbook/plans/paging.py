"""Pages of any size and depth by selection on the order key.

A page ``[offset, offset + limit)`` is the rows whose key lies between the key at index ``offset`` and
the key at index ``offset + limit - 1``.  Both keys are found by radix selection: the rows of an
interval of keys are counted per digit (at most ``DIGITS`` of them, the leading bits, or
bytes, in which the interval's keys differ), and only the digit that holds the wanted index becomes the next
interval, with the smallest and largest key that occur in it.  A 64-bit key takes four or five such
counts whatever its distribution; outliers, hashed ids beside small ones, or a prefix that all
keys share cost nothing, because the next digit begins where the keys of the interval begin to
differ.  An interval of at most ``DIGITS`` keys is counted by the keys themselves, so one count finds
any page of a small table.

Each count is one aggregate whose result (two rows at most) comes to the driver.  The page itself is then a
plain filter ``key >= first and key <= last`` with literals, which reaches the Parquet scans of
every table that is read for the page; no row of the page is ranked or sorted by its index.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetbook.plans.session import scratch_table

DIGIT_BITS = 16
DIGITS = 1 << DIGIT_BITS
LAST_INDEX = 2 ** 63 - 1


def total_count(df: DataFrame, name: str = "total_count") -> DataFrame:
    """One row: the number of rows of ``df``."""
    return df.agg(F.count(F.lit(1)).alias(name))


def check_page(limit: int, page: int) -> None:
    if limit < 0 or page < 0 or limit * page > LAST_INDEX:
        raise ValueError("LIMIT and OFFSET must not be negative or beyond 64 bits")


# ------------------------------------------------------------------------------------ selection


@dataclass(frozen=True)
class Place:
    """The key that holds a row index: ``before`` rows come ahead of it and ``rows`` share it."""

    key: Any
    before: int
    rows: int


@dataclass(frozen=True)
class _Interval:
    low: Any
    high: Any
    before: int
    rows: int
    keys: int


def digit(key: str, kind: T.DataType, low: Any, high: Any) -> Column:
    """The leading digit in which keys between ``low`` and ``high`` differ, in the order of the keys."""
    if isinstance(kind, T.StringType):
        a, b = low.encode(), high.encode()
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return F.substring(F.hex(F.col(key).cast("binary")), 2 * same + 1, 2 * DIGIT_BITS // 8)
    return F.shiftright(F.col(key).cast("long"), max(0, (high - low).bit_length() - DIGIT_BITS))


def _narrowed(keys: DataFrame, key: str, part: _Interval, whole: bool, ranks: list[int]) -> dict[int, _Interval]:
    """The digits (or keys, if they are few) of ``part`` that hold the row indexes ``ranks``, as intervals."""
    rows = keys if whole else keys.filter((F.col(key) >= F.lit(part.low)) & (F.col(key) <= F.lit(part.high)))
    if part.keys <= DIGITS:         # few enough to be summed up in one task
        upto = Window.orderBy("low").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        sums = rows.select(F.col(key).alias("low"), F.col(key).alias("high"), "__n").withColumn("upto", F.sum("__n").over(upto))
        sums = sums.withColumns({"n": F.sum("__n").over(Window.partitionBy("low")), "k": F.lit(1)})
    else:
        by = digit(key, keys.schema[key].dataType, part.low, part.high)
        upto = Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, Window.currentRow)   # at most DIGITS + 1 rows
        sums = rows.groupBy(by.alias("__d")).agg(
            F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k"), F.min(key).alias("low"), F.max(key).alias("high"))
        sums = sums.withColumn("upto", F.sum("n").over(upto))
    placed = sums.withColumn("before", F.col("upto") - F.col("n") + F.lit(part.before))
    holds = [(F.col("before") <= r) & (F.lit(r) < F.col("before") + F.col("n")) for r in ranks]
    wanted = holds[0]
    for h in holds[1:]:
        wanted = wanted | h
    held = placed.filter(wanted).select("low", "high", "before", "n", "k").collect()   # one per rank, or per row of its key
    found = [_Interval(*r) for r in held]
    return {r: next(f for f in found if f.before <= r < f.before + f.rows) for r in ranks}


def select_places(keys: DataFrame, key: str, ranks: list[int], weight: Column | None = None,
                  known: int | None = None) -> tuple[int, dict[int, Place]]:
    """(number of rows, where each row index of ``ranks`` falls) in the order of ``key``.

    ``keys`` has one row per key, or per row; ``weight`` is how many rows one stands for (default 1).
    Indexes past the end are left out.  ``key`` (a whole number or string) is never NULL.  ``known``: the
    number of rows, where it is known and each is one key.
    """
    keys = keys.select(key, (weight if weight is not None else F.lit(1)).cast("bigint").alias("__n"))
    if known is not None and known <= DIGITS:
        ends = (known, known, None, None)
    else:
        ends = keys.agg(F.sum("__n"), F.count(F.lit(1)), F.min(key), F.max(key)).first()
    total = ends[0] or 0
    open_ranks = {r: _Interval(ends[2], ends[3], 0, total, ends[1]) for r in ranks if 0 <= r < total}
    places: dict[int, Place] = {}
    whole = True
    while open_ranks:
        for part in set(open_ranks.values()):
            mine = [r for r, p in open_ranks.items() if p == part]
            if part.low is not None and part.low == part.high:
                places |= {r: Place(part.low, part.before, part.rows) for r in mine}
                for r in mine:
                    del open_ranks[r]
            else:
                open_ranks |= _narrowed(keys, key, part, whole, mine)
        whole = False
    return total, places


# ----------------------------------------------------------------------------------------- pages


@dataclass(frozen=True)
class Page:
    """A page as a range of keys; ``first`` is None where the page is empty.

    ``skip`` and ``spare`` rows of the first and last key lie outside the page (0 where every key is
    one row).
    """

    total: int
    first: Any = None
    last: Any = None
    skip: int = 0
    spare: int = 0
    first_rows: int = 1
    last_rows: int = 1

    def of(self, df: DataFrame, key: str) -> DataFrame:
        """Rows of ``df`` whose ``key`` lies in the page: literal bounds, for the scan."""
        if self.first is None:
            return df.filter(F.lit(False))
        return df.filter((F.col(key) >= F.lit(self.first)) & (F.col(key) <= F.lit(self.last)))

    def total_column(self, name: str = "total_count") -> Column:
        return F.lit(self.total).cast("bigint").alias(name)


def find_page(keys: DataFrame, key: str, offset: int, limit: int, weight: Column | None = None) -> Page:
    """The page ``[offset, offset + limit)`` of the rows that ``keys`` stands for, ordered by ``key``."""
    end = min(offset + limit, LAST_INDEX)
    total, places = select_places(keys, key, [offset] if limit == 0 else sorted({offset, end - 1}), weight)
    if limit == 0 or offset not in places:
        return Page(total)
    first = places[offset]
    last = places.get(end - 1)
    if last is None:                                        # the page reaches beyond the last row
        high = keys.agg(F.max(key)).first()[0]
        return Page(total, first.key, high, offset - first.before, first_rows=first.rows)
    return Page(total, first.key, last.key, offset - first.before, last.before + last.rows - end, first.rows, last.rows)


@contextmanager
def stored_keys(keys: DataFrame):
    """``keys`` written once to the shared folder while a page is looked for, where finding the listed
    keys takes joins; removed afterwards."""
    with scratch_table(keys, "keys") as table:
        yield table


def page_rows(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows ``[offset, offset + limit)`` of ``df`` ordered by the first column of ``order``, which is
    unique and never NULL."""
    return find_page(df, order[0], offset, limit).of(df, order[0])


def page_with_total(df: DataFrame, order: list[str], limit: int, page: int,
                    columns: list[str] | None = None) -> DataFrame:
    """Rows ``[limit*page, limit*page + limit)`` of ``df`` in ``order``, each with the total.

    An empty page has no rows.  The first column of ``order`` is unique.
    """
    check_page(limit, page)
    columns = columns or df.columns
    with stored_keys(df.select(order[0])) as keys:
        cut = find_page(keys, order[0], limit * page, limit)
    return cut.of(df, order[0]).select(cut.total_column(), *columns)
