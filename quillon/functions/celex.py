"""CELEX numbers: sector digit, year, one or two letters, number, perhaps a part and a date."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import FetchError

from .textexpr import strip, text

CELEX = r"\A\d{5}[A-Z][A-Z]?\d{4}(\(\d\d\))?(-\d{8})?\z"
CELEX_RE = re.compile(CELEX.replace(r"\z", r"\Z"), re.ASCII)
_DAY = r"^\d{4}-\d{2}-\d{2}$"


def parse_celex(raw) -> str:
    number = ("" if raw is None else str(raw)).strip().upper()
    if not CELEX_RE.match(number):
        raise FetchError(f"'{number[:40]}' is no CELEX number; one looks like 32016R0679, consolidated like 02016R0679-20160504." if number else "There is no CELEX number; one looks like 32016R0679.")
    return number


def is_consolidated(raw) -> bool:
    return "-" in parse_celex(raw)


def celex_for_consolidation(raw, date) -> str:
    number, day = parse_celex(raw), str(date).strip()
    if "-" in number:
        raise FetchError(f"'{number}' is consolidated already; begin with the original number.")
    if not re.fullmatch(_DAY, day):
        raise FetchError(f"'{day[:20]}' is no date of the form YYYY-MM-DD.")
    return "0" + number[1:] + "-" + day.replace("-", "")


def celex(c: Column) -> Column:
    """The number normalised; null where it is none."""
    number = F.upper(strip(text(c)))
    return F.when(number.rlike(CELEX), number)


def consolidated(c: Column) -> Column:
    return celex(c).contains("-")


def consolidation(c: Column, date: Column) -> Column:
    """The consolidated number as at a date; null where either has not the form, or the number is consolidated already."""
    number, day = celex(c), strip(text(date))
    return F.when(~number.contains("-") & day.rlike(_DAY), F.concat(F.lit("0"), F.substring(number, 2, 99), F.lit("-"), F.replace(day, F.lit("-"), F.lit(""))))
