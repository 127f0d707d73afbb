"""Invoice dates: day first, English and German month names, due terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and their numbers.
MONTHS = {
    "january": 1, "jan": 1, "januar": 1, "february": 2, "feb": 2, "februar": 2, "march": 3, "mar": 3, "märz": 3, "maerz": 3,
    "april": 4, "apr": 4, "may": 5, "mai": 5, "june": 6, "jun": 6, "juni": 6, "july": 7, "jul": 7, "juli": 7, "august": 8,
    "aug": 8, "september": 9, "sep": 9, "october": 10, "oct": 10, "oktober": 10, "okt": 10, "november": 11, "nov": 11,
    "december": 12, "dec": 12, "dezember": 12, "dez": 12,
}
DAY_FIRST = "\\b(\\d{1,2})[.\\-/ ]+([A-Za-zÄÖÜäöü]+|\\d{1,2})[.\\-/ ]+(\\d{4})\\b"


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day; never an error."""
    text = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(month.isNotNull(), text.try_cast("date"))


def parse_invoice_date(text: Column) -> Column:
    """Day, month or month name, year anywhere in the text; else the text as YYYY-MM-DD; else null."""
    trimmed = F.trim(text)
    day, middle, year = (F.regexp_extract(trimmed, DAY_FIRST, i) for i in (1, 2, 3))
    names = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.coalesce(F.try_element_at(names, F.lower(middle)), middle.try_cast("int"))
    iso = F.when(trimmed.rlike("^\\d{4}-\\d{2}-\\d{2}$"), trimmed.try_cast("date"))
    return F.when(trimmed.rlike(DAY_FIRST), _date(year, month, day)).otherwise(iso)


def due_date(issued: Column, terms: Column) -> Column:
    """The date that "due in N days" names; null without such a term."""
    days = F.regexp_extract(terms, "(?i)due\\s+in\\s+(\\d+)\\s+days?", 1).try_cast("int")
    return F.when(days.isNotNull(), F.date_add(issued, days))
