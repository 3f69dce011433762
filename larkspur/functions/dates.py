"""Date and time functions; intervals that must be stored are struct<months, days, micros>."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col, cols

DAY = 86_400_000_000
#: Fields of to_char and their Java letters (fixed values), longest first.
PG_FORMAT = [("YYYY", "yyyy"), ("HH24", "HH"), ("HH12", "hh"), ("MONTH", "MMMM"), ("Month", "MMMM"), ("DAY", "EEEE"), ("Day", "EEEE"), ("DDD", "DDD"), ("Mon", "MMM"), ("MON", "MMM"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("Dy", "EEE"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("AM", "a"), ("PM", "a"), ("Q", "Q"), ("TZ", "z")]
#: Letters of MySQL's date_format and their Java letters (fixed values).
MYSQL_FORMAT = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a"}


def _literal(text: str) -> str:
    return "".join(f"'{c}'" if c.isalpha() else c.replace("'", "''") for c in text)


def pg_pattern(template: str) -> str:
    out, i = [], 0
    while i < len(template):
        if template.startswith("FM", i):
            i += 2
            continue
        if template[i] == '"':
            end = template.index('"', i + 1)
            out.append(_literal(template[i + 1 : end]))
            i = end + 1
            continue
        for name, java in PG_FORMAT:
            if template.startswith((name, name.lower()), i):
                out.append(java)
                i += len(name)
                break
        else:
            out.append(_literal(template[i]))
            i += 1
    return "".join(out)


def mysql_pattern(template: str) -> str:
    return re.sub(r"%(.)|([^%]+)", lambda m: MYSQL_FORMAT.get(m[1], _literal(m[1])) if m[1] else _literal(m[2]), template)


def date_trunc(unit: str, ts):
    ts, unit = col(ts), unit.lower()
    span = {"decade": 10, "century": 100, "millennium": 1000}.get(unit)
    if not span:
        return F.date_trunc(unit, ts)
    year = F.year(ts)
    first = F.floor(year / span) * span if unit == "decade" else F.floor((year - 1) / span) * span + 1
    return F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast("timestamp")


def date_part(field: str, x) -> Column:
    """As double; dow counts from Sunday = 0, epoch is in seconds."""
    x, field = col(x), field.lower()
    ts = x.cast("timestamp")
    seconds = F.second(ts) + (F.pmod(F.unix_micros(ts), F.lit(1_000_000)) / 1e6)
    year = F.year(ts)
    parts = {
        "epoch": lambda: F.unix_micros(ts) / 1e6,
        "dow": lambda: F.dayofweek(ts) - 1,
        "isodow": lambda: F.weekday(ts) + 1,
        "doy": lambda: F.dayofyear(ts),
        "week": lambda: F.weekofyear(ts),
        "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), ts),
        "second": lambda: seconds,
        "milliseconds": lambda: seconds * 1000,
        "microseconds": lambda: seconds * 1e6,
        "decade": lambda: F.floor(year / 10),
        "century": lambda: F.ceil(year / 100),
        "millennium": lambda: F.ceil(year / 1000),
        "julian": lambda: F.datediff(ts, F.lit("1970-01-01").cast("date")) + 2440588,
    }
    return (parts[field]() if field in parts else F.date_part(F.lit(field), ts)).cast("double")


def date_bin(stride_micros: int, ts, origin="2001-01-01"):
    """The start of the stride that holds ts, counted from origin."""
    base = F.unix_micros(F.lit(origin).cast("timestamp"))
    n = F.floor((F.unix_micros(col(ts).cast("timestamp")) - base) / F.lit(stride_micros))
    return F.timestamp_micros(base + n * stride_micros)


def age(a, b=None):
    """Years, months, days and microseconds between, largest unit first, as struct<months, days, micros>."""
    late, early = (col(a).cast("timestamp"), col(b).cast("timestamp")) if b is not None else (F.date_trunc("day", F.current_timestamp()), col(a).cast("timestamp"))
    sign = F.when(late < early, F.lit(-1)).otherwise(F.lit(1))
    lo, hi = F.least(late, early), F.greatest(late, early)
    months = (F.year(hi) * 12 + F.month(hi)) - (F.year(lo) * 12 + F.month(lo))
    in_month = lambda t: F.unix_micros(t) - F.unix_micros(F.date_trunc("month", t))
    short = in_month(hi) < in_month(lo)
    # a month is taken back, as long as the month that lo is in
    back = F.day(F.last_day(lo)).cast("long") * DAY
    left = in_month(hi) - in_month(lo) + F.when(short, back).otherwise(F.lit(0))
    return F.struct(((months - short.cast("int")) * sign).cast("int").alias("months"), (F.floor(left / DAY) * sign).cast("int").alias("days"), (F.pmod(left, F.lit(DAY)) * sign).cast("long").alias("micros"))


def _interval(x, months, days, micros):
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), micros.cast("long").alias("micros"))


def _carry(x, size):
    """Whole units of `size` in x towards zero, and the rest."""
    x = x.cast("long")
    n = F.when(x < 0, F.ceil(x / size)).otherwise(F.floor(x / size)).cast("long")
    return n, x - n * size


def justify_days(iv):
    n, days = _carry(iv["days"], 30)
    return _interval(iv, iv["months"] + n, days, iv["micros"])


def justify_hours(iv):
    n, micros = _carry(iv["micros"], DAY)
    return _interval(iv, iv["months"], iv["days"] + n, micros)


def justify_interval(iv):
    total = (iv["months"].cast("long") * 30 + iv["days"]) * DAY + iv["micros"]
    n, rest = _carry(total, 30 * DAY)
    days, micros = _carry(rest, DAY)
    return _interval(iv, n, days, micros)


def interval_order(iv):
    """What intervals compare by: microseconds with months of 30 days."""
    return (iv["months"].cast("decimal(20,0)") * 30 + iv["days"]) * DAY + iv["micros"]


def shift(ts, months=0, days=0, micros=0, sign: int = 1):
    """ts plus an interval: months first (month ends clamp), then days, then the rest."""
    d = F.make_interval(F.lit(0), col(months) * sign, F.lit(0), col(days) * sign)
    return F.timestamp_micros(F.unix_micros(col(ts).cast("timestamp") + d) + col(micros).cast("long") * sign)


def to_char(x, template: str):
    """Times by the fields of PG_FORMAT; numbers by 9, 0, comma, point, MI and S."""
    if re.search(r"[90]", template) and not re.search(r"YY|MM|DD|HH|MI|SS|Mon|Day", template):
        whole, _, part = template.replace("FM", "").partition(".")
        digits = len(re.findall("[90]", part))
        text = F.format_number(F.round(col(x).cast("decimal(38,10)"), digits), digits)
        text = text if "," in whole else F.regexp_replace(text, ",", "")
        zeros = whole.replace(",", "")
        if "0" in zeros:
            least = len(zeros) - zeros.index("0")
            text = F.when(F.length(F.substring_index(text, ".", 1)) < least, F.lpad(text, least + (digits + 1 if digits else 0), "0")).otherwise(text)
        return text if "FM" in template else F.lpad(text, max(len(template) + 1, 1), " ")
    return F.date_format(col(x), pg_pattern(template))


def to_number(text, template: str):
    clean = F.regexp_replace(col(text), "[^0-9.+-]", "")
    return F.when(col(text).rlike(r"^\s*<.*>\s*$|-\s*$"), -F.abs(F.regexp_replace(clean, "-", "").cast("decimal(38,10)"))).otherwise(clean.cast("decimal(38,10)"))


def to_timestamp(x, template: str | None = None):
    return F.timestamp_seconds(col(x)) if template is None else F.to_timestamp(col(x), pg_pattern(template))


def timezone(zone, ts, from_utc: bool = True):
    """ts AT TIME ZONE zone: the local time of an instant, or (from_utc False) the instant of a local time."""
    return (F.from_utc_timestamp if from_utc else F.to_utc_timestamp)(col(ts), col(zone))


_MONTHS = lambda p: F.floor(p / 100) * 12 + p % 100 - 1
_YEARS = lambda p: p + F.when(p < 7000, 200_000).when(p < 10_000, 190_000).otherwise(0)


@cols
def period_add(p, n):
    m = _MONTHS(_YEARS(p)) + n
    return (F.floor(m / 12) * 100 + m % 12 + 1).cast("int")


@cols
def period_diff(a, b):
    return (_MONTHS(_YEARS(a)) - _MONTHS(_YEARS(b))).cast("int")


def week(d, mode: int = 0):
    """Week of the year in MySQL's eight modes: first day (1: Monday), range from 0 or 1, and which week is the first."""
    d = col(d).cast("date")
    monday, from_one, four = bool(mode & 1), bool(mode & 2), bool(mode & 4) != bool(mode & 1)

    def first_of(year):
        jan1 = F.make_date(year, F.lit(1), F.lit(1))
        place = F.weekday(jan1) if monday else F.dayofweek(jan1) - 1
        # with four: the week of Jan 1 counts if four or more of its days are in the year; else it must begin in it
        counts = (place <= 3) if four else (place == 0)
        return F.when(counts, F.date_sub(jan1, place)).otherwise(F.date_add(jan1, 7 - place))

    year = F.year(d)
    start, following, before = first_of(year), first_of(year + 1), first_of(year - 1)
    n = (F.floor(F.datediff(d, start) / 7) + 1).cast("int")
    if not from_one:
        return F.when(d < start, F.lit(0)).otherwise(n)
    return F.when(d < start, (F.floor(F.datediff(d, before) / 7) + 1).cast("int")).when(d >= following, F.lit(1)).otherwise(n)


def yearweek(d, mode: int = 0):
    d = col(d).cast("date")
    w = week(d, mode | 2)
    year = F.year(d) + F.when((F.month(d) == 1) & (w >= 52), -1).when((F.month(d) == 12) & (w == 1), 1).otherwise(0)
    return year * 100 + w


EPOCH_DAY = 719_528  # to_days('1970-01-01')


def to_days(d):
    return F.datediff(col(d).cast("date"), F.lit("1970-01-01").cast("date")) + EPOCH_DAY


def add(d, n, unit: str = "day", sign: int = 1):
    n = col(n) * sign
    if unit in ("day", "week"):
        out = F.date_add(col(d).cast("date"), (n * (7 if unit == "week" else 1)).cast("int"))
        return F.when(F.typeof(col(d)).startswith("timestamp"), F.timestamp_add(unit.upper(), n.cast("int"), col(d).cast("timestamp"))).otherwise(out.cast("timestamp"))
    return F.timestamp_add(unit.upper(), n.cast("int"), col(d).cast("timestamp"))


def time_micros(t):
    """A time of day or timestamp as microseconds since midnight."""
    ts = F.coalesce(col(t).try_cast("timestamp"), F.concat(F.lit("1970-01-01 "), col(t).cast("string")).try_cast("timestamp"))
    return F.pmod(F.unix_micros(ts), F.lit(DAY))


def get_format(kind: str, place: str) -> Column:
    """MySQL's format strings by kind and place (fixed values)."""
    dates = {"USA": "%m.%d.%Y", "JIS": "%Y-%m-%d", "ISO": "%Y-%m-%d", "EUR": "%d.%m.%Y", "INTERNAL": "%Y%m%d"}
    times = {"USA": "%h:%i:%s %p", "JIS": "%H:%i:%s", "ISO": "%H:%i:%s", "EUR": "%H.%i.%s", "INTERNAL": "%H%i%s"}
    both = {"USA": "%Y-%m-%d %H.%i.%s", "JIS": "%Y-%m-%d %H:%i:%s", "ISO": "%Y-%m-%d %H:%i:%s", "EUR": "%Y-%m-%d %H.%i.%s", "INTERNAL": "%Y%m%d%H%i%s"}
    return F.lit({"DATE": dates, "TIME": times, "DATETIME": both}[kind.upper()].get(place.upper()))


FUNCTIONS = {
    "age": age,
    "date_trunc": date_trunc,
    "date_part": date_part,
    "date_bin": date_bin,
    "make_date": cols(F.make_date),
    "make_time": cols(lambda h, m, s: ((h.cast("long") * 60 + m) * 60_000_000 + s * 1_000_000).cast("long")),
    "make_timestamp": lambda *a: F.make_timestamp_ntz(*map(col, a)),
    "make_timestamptz": lambda *a: F.make_timestamp_ltz(*map(col, a)),
    "make_interval": lambda years=0, months=0, weeks=0, days=0, hours=0, mins=0, secs=0: _interval(None, col(years) * 12 + col(months), col(weeks) * 7 + col(days), (col(hours).cast("long") * 3600 + col(mins) * 60 + col(secs)) * 1_000_000),
    "makedate": cols(lambda y, n: F.when(n > 0, F.date_add(F.make_date(y, F.lit(1), F.lit(1)), n - 1))),
    "maketime": lambda h, m, s: F.make_dt_interval(F.lit(0), col(h), col(m), col(s)),
    "to_date": lambda s, template=None: F.to_date(col(s), pg_pattern(template)) if template else F.to_date(col(s)),
    "to_timestamp": to_timestamp,
    "to_char": to_char,
    "to_number": to_number,
    "timezone": timezone,
    "convert_tz": lambda ts, a, b: F.convert_timezone(col(a), col(b), col(ts).cast("timestamp_ntz")),
    "justify_days": justify_days,
    "justify_hours": justify_hours,
    "justify_interval": justify_interval,
    "date_add": add,
    "date_sub": lambda d, n, unit="day": add(d, n, unit, -1),
    "adddate": add,
    "subdate": lambda d, n, unit="day": add(d, n, unit, -1),
    "date_subtract": lambda d, n, unit="day": add(d, n, unit, -1),
    "addtime": lambda ts, t: F.timestamp_micros(F.unix_micros(col(ts).cast("timestamp")) + time_micros(t)),
    "subtime": lambda ts, t: F.timestamp_micros(F.unix_micros(col(ts).cast("timestamp")) - time_micros(t)),
    "timediff": cols(lambda a, b: a.cast("timestamp") - b.cast("timestamp")),
    "datediff": cols(F.datediff),
    "timestampadd": lambda unit, n, ts: F.timestamp_add(unit.upper(), col(n), col(ts)),
    "timestampdiff": lambda unit, a, b: F.timestamp_diff(unit.upper(), col(a), col(b)),
    "period_add": period_add,
    "period_diff": period_diff,
    "date_format": lambda d, template: F.date_format(col(d), mysql_pattern(template)),
    "time_format": lambda d, template: F.date_format(F.timestamp_micros(time_micros(d)), mysql_pattern(template)),
    "str_to_date": lambda s, template: F.try_to_timestamp(col(s), F.lit(mysql_pattern(template))),
    "get_format": get_format,
    "from_unixtime": lambda n, template=None: F.timestamp_seconds(col(n)) if template is None else F.date_format(F.timestamp_seconds(col(n)), mysql_pattern(template)),
    "unix_timestamp": lambda ts=None: F.unix_timestamp() if ts is None else F.unix_seconds(col(ts).cast("timestamp")),
    "from_days": lambda n: F.date_add(F.lit("1970-01-01").cast("date"), (col(n) - EPOCH_DAY).cast("int")),
    "to_days": to_days,
    "to_seconds": lambda d: to_days(d).cast("long") * 86_400 + F.floor(time_micros(d) / 1_000_000),
    "sec_to_time": lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), col(n)),
    "time_to_sec": lambda t: F.floor(time_micros(t) / 1_000_000).cast("long"),
    "last_day": cols(F.last_day),
    "day": cols(F.day),
    "dayname": lambda d: F.date_format(col(d), "EEEE"),
    "dayofmonth": cols(F.dayofmonth),
    "dayofweek": cols(F.dayofweek),
    "dayofyear": cols(F.dayofyear),
    "weekday": cols(F.weekday),
    "week": week,
    "weekofyear": cols(F.weekofyear),
    "yearweek": yearweek,
    "month": cols(F.month),
    "monthname": lambda d: F.date_format(col(d), "MMMM"),
    "quarter": cols(F.quarter),
    "year": cols(F.year),
    "hour": cols(F.hour),
    "minute": cols(F.minute),
    "second": cols(F.second),
    "microsecond": cols(lambda t: F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000)).cast("int")),
    "timeofday": lambda: F.date_format(F.current_timestamp(), "EEE MMM dd HH:mm:ss.SSSSSS yyyy z"),
    "interval_larger": lambda a, b: F.when(interval_order(a) >= interval_order(b), a).otherwise(b),
    "interval_smaller": lambda a, b: F.when(interval_order(a) <= interval_order(b), a).otherwise(b),
    "date_larger": cols(F.greatest),
    "date_smaller": cols(F.least),
    "timestamp_larger": cols(F.greatest),
    "timestamp_smaller": cols(F.least),
}
