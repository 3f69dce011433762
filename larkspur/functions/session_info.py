"""Session and environment scalars, sequences, and sizes."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .base import col, cols


class Sequence:
    """A sequence kept on the driver: numbers are not transactional and not for columns (use numbered())."""

    def __init__(self, start: int = 1, step: int = 1):
        self.step, self._next, self.last = step, start, None

    def nextval(self) -> int:
        self.last, self._next = self._next, self._next + self.step
        Sequence.latest = self.last
        return self.last

    def currval(self) -> int:
        if self.last is None:
            raise ValueError("currval is not yet defined in this session")
        return self.last

    def setval(self, value: int, is_called: bool = True) -> int:
        self._next = value + self.step if is_called else value
        if is_called:
            self.last = value
        return value

    latest: int | None = None


def lastval() -> int:
    if Sequence.latest is None:
        raise ValueError("lastval is not yet defined in this session")
    return Sequence.latest


def current_setting(name: str, missing_ok: bool = False):
    value = SparkSession.active().conf.get(name, None)
    if value is None and not missing_ok:
        raise ValueError(f'unrecognized configuration parameter "{name}"')
    return F.lit(value)


def set_config(name: str, value: str):
    SparkSession.active().conf.set(name, value)
    return F.lit(value)


@cols
def size_pretty(n):
    """Bytes in the largest unit of which there are at least 10, halves up."""
    n = n.cast("decimal(38,0)")
    size, out = F.abs(n), F.concat(n.cast("string"), F.lit(" bytes"))
    for k, unit in enumerate(("kB", "MB", "GB", "TB", "PB"), 1):
        half = F.signum(n).cast("decimal(38,0)") * F.floor(size / F.lit(1024**k) + F.lit(0.5)).cast("decimal(38,0)")
        out = F.when(size >= 10 * 1024**k if k > 1 else size >= 10 * 1024, F.concat(half.cast("decimal(38,0)").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


@cols
def size_bytes(text):
    number = F.regexp_extract(text, r"([+-]?[\d.]+(?:[eE][+-]?\d+)?)", 1).cast("decimal(38,10)")
    unit = F.lower(F.regexp_extract(text, r"([A-Za-z]+)\s*$", 1))
    factor = F.when(unit.isin("", "b", "byte", "bytes"), F.lit(1.0))
    for k, u in enumerate(("kb", "mb", "gb", "tb", "pb"), 1):
        factor = factor.when(unit == u, F.lit(float(1024**k)))
    return F.round(number.cast("double") * factor).cast("long")


def constant(value):
    return lambda *_: F.lit(value)


FUNCTIONS = {
    "current_database": F.current_database,
    "database": F.current_database,
    "schema": F.current_schema,
    "current_schema": F.current_schema,
    "current_schemas": lambda implicit=False: F.array(F.current_schema()),
    "current_catalog": F.current_catalog,
    "current_user": F.current_user,
    "session_user": F.session_user,
    "user": F.user,
    "current_role": F.current_user,
    "system_user": F.current_user,
    "version": F.version,
    "current_setting": current_setting,
    "set_config": set_config,
    "charset": constant("utf8mb4"),
    "collation": lambda x: F.collation(col(x)),
    "coercibility": constant(4),
    "found_rows": lambda df: F.lit(df.count()),
    "row_count": lambda df: F.lit(df.count()),
    "connection_id": lambda: F.lit(SparkSession.active().sparkContext.applicationId),
    "pg_collation_for": lambda x: F.collation(col(x)),
    "pg_column_size": cols(lambda x: F.octet_length(x.cast("string")) + F.when(F.octet_length(x.cast("string")) < 127, 1).otherwise(4)),
    "pg_size_pretty": size_pretty,
    "pg_size_bytes": size_bytes,
    "pg_bytes_pretty": size_pretty,
    "nextval": lambda s: F.lit(s.nextval()),
    "currval": lambda s: F.lit(s.currval()),
    "setval": lambda s, n, called=True: F.lit(s.setval(n, called)),
    "lastval": lambda: F.lit(lastval()),
    "last_insert_id": lambda: F.lit(lastval()),
    "__tsm_fract": lambda percent, seed=None: F.rand(seed) < percent / 100.0,
}
