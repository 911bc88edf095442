"""Expressions over single columns: quoting, missing values, dates, and the applied halves of the encoders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_PREFIX = "__dt_"
DATE_PATTERN = r"\d{4}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
#: Tried in this order; the month comes first where day and month could be exchanged.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-M-d", "yyyy/M/d HH:mm:ss", "yyyy/M/d", "M/d/yyyy HH:mm:ss",
    "M/d/yyyy HH:mm", "M/d/yyyy", "M-d-yyyy", "M/d/yy", "M-d-yy", "d/M/yyyy", "d-M-yyyy", "yyyy-MM", "yyyy/MM",
)
DATE_PARTS = ("year", "month", "day", "dayofweek", "hour")


def col(name: str) -> Column:
    """A column by its plain name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, the only missing value; columns that can't hold NaN are left alone."""
    return df.select(*(F.when(F.isnan(col(f.name)), None).otherwise(col(f.name)).alias(f.name) if is_float(f.dataType) else col(f.name) for f in df.schema))


#: English month names by their first letters, and what follows these in the names.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_WEEKDAY = r"^(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+"
#: A time at the end, told by a colon or a half of the day: hour, minute, second, half. Fractions and offsets are read over.
_TIME = r"(?:^|[\st,]+)(?:at\s+)?(?=\d{1,2}(?::\d{2}|\s*[ap]\.?m\b))(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,]\d{1,9})?)?)?\s*(?:([ap])\.?m\.?)?\s*(?:z|utc|gmt|(?:utc|gmt)?[+-]\d{2}:?(?:\d{2})?)?$"
_ORDINAL, _REST = r"(?:st|nd|rd|th)?", r"(?:\s+(?:utc|gmt))?((?:~.*)?)$"
#: Shapes of a date, each with how year, month and day follow from its groups.
_DATE_SHAPES = (
    (rf"^(\d{{1,2}}){_ORDINAL}[\s./-]*(?:of\s+)?{_MONTH}[\s,./-]*(\d{{4}}|\d{{2}}){_REST}", "$3~$2~$1~$4"),
    (rf"^{_MONTH}[\s./-]*(\d{{1,2}}){_ORDINAL}[\s,./-]+(\d{{4}}){_REST}", "$3~$1~$2~$4"),
    (rf"^(\d{{4}})[\s,./-]*{_MONTH}[\s./-]*(\d{{1,2}}){_REST}", "$1~$2~$3~$4"),
    (rf"^{_MONTH}[\s,./-]*(\d{{4}}){_REST}", "$2~$1~1~$3"),
    (rf"^(\d{{4}})[./-](\d{{1,2}})[./-](\d{{1,2}}){_REST}", "$1~$2~$3~$4"),
    (rf"^(1[3-9]|2\d|3[01])[./-](\d{{1,2}})[./-](\d{{4}}|\d{{2}}){_REST}", "$3~$2~$1~$4"),
    (rf"^(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}|\d{{2}}){_REST}", "$3~$1~$2~$4"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_REST}", "$1~$2~$3~$4"),
)


def written_datetime(value: Column) -> Column:
    """The time in a written form, or NULL: month names, weekdays, ordinals, AM and PM, offsets (the time on the clock
    there counts), years of two digits (69 is 1969), and dates without separators. Where both could be meant, the month comes first.
    A chain of replacements brings every form to year~month~day~~hour~minute~second~half, which is taken apart once."""
    text = F.regexp_replace(F.lower(F.trim(value.cast("string"))), "~", " ")
    text = F.regexp_replace(F.regexp_replace(text, _WEEKDAY, ""), _TIME, "~$1~$2~$3~$4")
    for shape, form in _DATE_SHAPES:
        text = F.regexp_replace(text, shape, form)

    def made(p: Column) -> Column:
        number = lambda i: F.get(p, i).try_cast("int")
        year, clock, half = number(0), number(4), F.coalesce(F.get(p, 7), F.lit(""))
        year = F.when(F.length(F.get(p, 0)) == 2, year + F.when(year >= 69, 1900).otherwise(2000)).otherwise(year)
        month = F.coalesce(number(1), ((F.instr(F.lit(MONTHS), F.substring(F.get(p, 1), 1, 3)) + 2) / 3).cast("int"))
        hour = F.when(F.size(p) < 5, 0).when(half == "", clock).when(clock.between(1, 12), clock % 12 + F.when(half == "p", 12).otherwise(0))
        return F.try_make_timestamp_ntz(year, month, number(2), hour, F.coalesce(number(5), F.lit(0)), F.coalesce(number(6), F.lit(0)).cast("decimal(8,6)"))

    return F.get(F.transform(F.array(F.split(text, "~")), made), 0)


def parse_datetime(value: Column) -> Column:
    """The time that a string names, or NULL: the first format that fits, else the written form."""
    text = F.trim(value.cast("string"))
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(F.expr("NULL").cast("timestamp"), *tries, written_datetime(text).cast("timestamp"), F.when(text.rlike(r"\d{4}"), text.try_cast("timestamp")))


def as_datetime(value: Column, kind: T.DataType) -> Column:
    return value if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else parse_datetime(value)


def date_parts(name: str, when: Column) -> dict[str, Column]:
    """The five parts of a date, by column name; Monday is day 0 of the week."""
    made = {"year": F.year(when), "month": F.month(when), "day": F.dayofmonth(when), "dayofweek": F.weekday(when), "hour": F.hour(when.cast("timestamp_ntz"))}
    return {f"{DATE_PREFIX}{name}_{part}": made[part].cast("double") for part in DATE_PARTS}


def fill(value: Column, surrogate) -> Column:
    return value if surrogate is None else F.coalesce(value, F.lit(surrogate))


def scale(value: Column, mean: float, deviation: float) -> Column:
    """Standard scaling with the population deviation; a constant column is only centred."""
    return (value - F.lit(float(mean))) / F.lit(float(deviation) if deviation else 1.0)


def one_hot(value: Column, category: str) -> Column:
    return F.coalesce((value == F.lit(category)).cast("double"), F.lit(0.0))


def ordinal(value: Column, categories: Sequence[str]) -> Column:
    """The place among the sorted categories; -1.0 for unknown and missing ones."""
    if not categories:
        return F.lit(-1.0)
    table = F.map_from_arrays(F.array(*map(F.lit, categories)), F.array(*(F.lit(float(i)) for i in range(len(categories)))))
    return F.coalesce(F.try_element_at(table, value), F.lit(-1.0))


def boolean_code(value: Column, seen: Sequence[bool], name: str) -> Column:
    """The place among the values seen at fit; another value is an error, as it has no code."""
    out = F.raise_error(F.lit(f"column {name!r} holds a value that was not seen at fit")).cast("double")
    for i, v in reversed(list(enumerate(seen))):
        out = F.when(value == F.lit(v), F.lit(float(i))).otherwise(out)
    return out


def lookup(value: Column, table: dict, default=None) -> Column:
    """What table holds for the value, else default. Few entries are compared one by one; many are a map of the values as
    strings, since deep expressions overflow the analyser."""
    if len(table) <= 100:
        out = F.lit(default)
        for k, v in table.items():
            out = F.when(value.eqNullSafe(F.lit(k)), F.lit(v)).otherwise(out)
        return out
    text = lambda x: F.coalesce(x.cast("string"), F.lit("\0missing"))
    found = F.map_from_arrays(F.array(*(text(F.lit(k)) for k in table)), F.array(*map(F.lit, table.values())))
    return F.coalesce(F.try_element_at(found, text(value)), F.lit(default))


def flatten_params(params: dict) -> dict[str, str]:
    """Parameters as strings: None as "None"."""
    return {k: str(v) for k, v in params.items()}
