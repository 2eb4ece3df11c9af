"""Calendar days out of free notations, and the day arithmetic the operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A time of day after the day: '09:30', 'T09:30:00.5Z', ' 9:30 pm', '+02:00' and the like.
_TIME = (
    r"(?:[T ,]*[0-9]{1,2}(?:[:.hH][0-9]{2}(?:[:.][0-9]{2}(?:[.,][0-9]+)?)?|[0-9]{2}(?:[0-9]{2})?)?"
    r" *(?:[AaPp]\.?[Mm]\.?)? *(?:Z|UTC|GMT|[+-][0-9]{2}:?(?:[0-9]{2})?)?)?"
)
#: Year first, then month and day, with separators or as eight digits. RE2 and Java read it alike.
DAY_PATTERN = r"^\s*([0-9]{4})(?:[-/._ ]{1,3}([0-9]{1,2})[-/._ ]{1,3}([0-9]{1,2})|([0-9]{2})([0-9]{2}))" + _TIME + r"\s*$"
_NAMED = r"^\s*([0-9]{4})[-/._, ]{1,3}(\p{L}{3,9})\.?[-/._, ]{1,3}([0-9]{1,2})" + _TIME + r"\s*$"
# First letters of month names, English and French.
_MONTHS = {
    "jan": 1, "feb": 2, "fév": 2, "fev": 2, "mar": 3, "apr": 4, "avr": 4, "may": 5, "mai": 5, "jun": 6, "juin": 6,
    "jul": 7, "juil": 7, "aug": 8, "aoû": 8, "aou": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12, "déc": 12,
}


def readable_day(c: Column | str) -> Column:
    """DATE of a calendar day written year first, in any notation, with or without a time of day.

    NULL for anything else: NULL, blank, words, a year alone, days that no calendar has.
    """
    s = F.col(c) if isinstance(c, str) else c
    plain = F.try_to_date(F.regexp_replace(s, DAY_PATTERN, "$1-$2$4-$3$5"), "yyyy-M-d")
    name = F.lower(F.regexp_extract(s, _NAMED, 2))
    table = F.create_map(*[F.lit(x) for kv in _MONTHS.items() for x in kv])
    month = F.coalesce(F.try_element_at(table, F.left(name, F.lit(4))), F.try_element_at(table, F.left(name, F.lit(3))))
    named = F.try_to_date(
        F.concat_ws("-", F.regexp_extract(s, _NAMED, 1), month.cast("string"), F.regexp_extract(s, _NAMED, 3)), "yyyy-M-d"
    )
    return F.when(s.rlike(r"^\s*[0-9]{4}[-/._, ]{1,3}\p{L}"), named).otherwise(plain)


def day_sql(expr: str) -> str:
    """The same for SQL twins, as far as numeric notations go."""
    return (
        f"try_cast(try_strptime(regexp_replace({expr}, '{DAY_PATTERN}', '\\1-\\2\\4-\\3\\5'), '%Y-%m-%d') AS DATE)"
    )


def iso(c: Column | str) -> Column:
    """'YYYY-MM-DD' of a DATE."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")
