"""Dates as harvested, in several ways of writing, and differences of days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The months in Spanish, in order.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


# Holidays that fall on the same day every year, as (month, day).
HOLIDAYS = ((1, 1), (5, 1), (5, 21), (6, 20), (7, 16), (8, 15), (9, 18), (9, 19), (10, 31), (11, 1), (12, 8), (12, 25))

_YMD = r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)"
_DMY = r"(?<!\d)(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)"
_LONG = rf"(?<!\d)(\d{{1,2}})\s*[°º]?\s+de\s+({'|'.join(MONTHS)})\s+(?:de|del)\s+(?:año\s+)?(\d{{4}})(?!\d)"


def iso_date(text: Column) -> Column:
    """The earliest valid date that stands anywhere in a text as yyyy-mm-dd: y-m-d, d-m-y (also with / or .) or "d de mes de y".

    Years from 1900 to 2100; impossible dates are passed over; null where there is none.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(f"{_YMD}|{_DMY}|{_LONG}"), F.lit(0))
    months = F.array(*map(F.lit, MONTHS))

    def built(y: Column, m: Column, d: Column) -> Column:
        date = F.try_to_date(F.concat(y, F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        return F.when(F.year(date).between(1900, 2100), F.date_format(date, "yyyy-MM-dd"))

    def read(c: Column) -> Column:
        part = lambda pattern, group: F.regexp_extract(c, pattern, group)
        long = built(part(_LONG, 3), F.array_position(months, part(_LONG, 2)), part(_LONG, 1))
        return F.when(c.rlike(_YMD), built(part(_YMD, 1), part(_YMD, 2), part(_YMD, 3))).when(c.rlike(_DMY), built(part(_DMY, 3), part(_DMY, 2), part(_DMY, 1))).otherwise(long)

    return F.get(F.filter(F.transform(found, read), lambda d: d.isNotNull()), F.lit(0))


def business_days(start: Column, end: Column, saturdays: bool = False, holidays: tuple[tuple[int, int], ...] = HOLIDAYS) -> Column:
    """Working days after ``start`` up to and including ``end``, without the yearly holidays; 0 if there is none between."""
    off = [1] if saturdays else [1, 7]
    fixed = [m * 100 + d for m, d in holidays]
    days = F.when(end > start, F.sequence(F.date_add(start, 1), end)).otherwise(F.array().cast("array<date>"))
    return F.size(F.filter(days, lambda d: ~F.dayofweek(d).isin(*off) & ~(F.month(d) * 100 + F.dayofmonth(d)).isin(*fixed)))
