"""Spreadsheet serial dates. Serials 1 to 60 of the 1900 system are a day later, for its 29 February 1900."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
_EPOCH = {False: dt.datetime(1899, 12, 30), True: dt.datetime(1904, 1, 1)}


def serial_to_datetime(serial: float, date1904: bool = False) -> dt.datetime:
    """The moment of a serial, for readers; date_column() is the same for a column."""
    if not date1904 and 1 <= serial <= 60:
        serial += 1
    return _EPOCH[date1904] + dt.timedelta(milliseconds=round(serial * DAY_MS))


def datetime_to_serial(when: dt.datetime, date1904: bool = False) -> float:
    serial = (when - _EPOCH[date1904]).total_seconds() / 86_400
    return serial - 1 if not date1904 and 2 <= serial < 61 else serial


def iso(when: dt.datetime) -> str:
    return when.strftime("%Y-%m-%dT%H:%M:%S.") + f"{when.microsecond // 1000:03d}Z"


def date_column(serial: Column, date1904: bool = False) -> Column:
    """timestamp_ntz of a column of serials, to the millisecond."""
    day = serial if date1904 else F.when((serial >= 1) & (serial <= 60), serial + 1).otherwise(serial)
    ms = F.floor(day * float(DAY_MS) + 0.5)
    base = F.lit(_EPOCH[date1904].strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return base + F.make_dt_interval(F.floor(ms / DAY_MS).cast("int"), F.lit(0), F.lit(0), (F.pmod(ms, F.lit(DAY_MS)) / 1000).cast("decimal(18,6)"))


def serial_column(when: Column, date1904: bool = False) -> Column:
    """The serial of a column of dates or timestamps."""
    stamp = when.cast("timestamp_ntz")
    day = F.datediff(stamp.cast("date"), F.lit(_EPOCH[date1904].date()))
    micros = (F.hour(stamp) * 3600 + F.minute(stamp) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), stamp) * 1_000_000).cast("long")
    serial = day + micros / 86_400_000_000.0
    return serial if date1904 else F.when((serial >= 2) & (serial < 61), serial - 1).otherwise(serial)


def iso_column(when: Column) -> Column:
    """ISO 8601 in UTC with milliseconds, as date cells are read."""
    return F.concat(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def iso_cell(text: Column) -> Column:
    """The moment of an ISO text in a cell of dates: without a zone it is UTC; null if it is none."""
    shape = text.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$")
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$") & text.contains(":"), text).otherwise(F.concat(text, F.when(text.contains(":"), "Z").otherwise("T00:00:00Z")))
    return F.when(shape, F.to_utc_timestamp(F.try_to_timestamp(zoned), F.current_timezone()).cast("timestamp_ntz"))


def duration_column(text: Column) -> Column:
    """Days of an ISO 8601 duration such as -PT36H15M; null if it is none."""
    part = lambda unit: F.coalesce(F.regexp_extract(text, rf"(\d+(?:\.\d+)?){unit}", 1).try_cast("double"), F.lit(0.0))
    time = F.regexp_extract(text, "T(.*)$", 1)
    minutes = F.coalesce(F.regexp_extract(time, r"(\d+(?:\.\d+)?)M", 1).try_cast("double"), F.lit(0.0))
    days = part("D") + (part("H") * 3600 + minutes * 60 + part("S")) / 86_400.0
    return F.when(text.rlike(r"^-?P(\d+(\.\d+)?D)?(T(\d+(\.\d+)?H)?(\d+(\.\d+)?M)?(\d+(\.\d+)?S)?)?$"), F.when(text.startswith("-"), -days).otherwise(days))


def default_date_format(when: Column) -> Column:
    """The format of a date cell without one: with the time only where there is one."""
    return F.when(F.date_format(when, "HHmmssSSS") == "000000000", "yyyy-mm-dd").otherwise("yyyy-mm-dd hh:mm:ss")


#: Built-in number formats that show a date. Fixed values.
DATE_FORMAT_IDS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


@lru_cache(1000)
def is_date_format(code: str) -> bool:
    """Whether a format code shows a date or time, by the items of its sections."""
    from quadrille.functions.number_format import sections

    return any(x.kind in ("date", "elapsed") for s in sections(code) for x in s.items)
