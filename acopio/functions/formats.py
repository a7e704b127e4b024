"""Values as they are shown: Galician separators and months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The months' short names.
MONTHS = ("xan", "feb", "mar", "abr", "mai", "xuñ", "xul", "ago", "set", "out", "nov", "dec")


def _swapped(c: Column) -> Column:
    return F.translate(c, ",.", ".,")


def count(c: Column) -> Column:
    """FM1: a whole number in groups of three."""
    return _swapped(F.format_number(c, 0))


def euros(c: Column) -> Column:
    """FM1: money with two decimals."""
    return F.concat(_swapped(F.format_number(c, 2)), F.lit(" €"))


def share(c: Column) -> Column:
    """FM1: a part of one as percent, with one decimal; null stays null."""
    return F.concat(_swapped(F.format_number(c * 100, 1)), F.lit(" %"))


def megabytes(c: Column) -> Column:
    """FM1: bytes as MB, with one decimal."""
    return F.concat(_swapped(F.format_number(c / (1 << 20), 1)), F.lit(" MB"))


def uptime(c: Column) -> Column:
    """FM1: seconds as days, hours and minutes, without leading zero parts."""
    days, hours, minutes = F.floor(c / 86_400), F.floor(c / 3_600) % 24, F.floor(c / 60) % 60
    return F.concat(F.when(days > 0, F.concat(days.cast("string"), F.lit(" d "))).otherwise(""), F.when(c >= 3_600, F.concat(hours.cast("string"), F.lit(" h "))).otherwise(""), minutes.cast("string"), F.lit(" min"))


def day(c: Column) -> Column:
    """FM1: a date with its month's short name."""
    return F.concat_ws(" ", F.day(c).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(c)), F.year(c).cast("string"))
