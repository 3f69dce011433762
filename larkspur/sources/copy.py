"""COPY: the text format (tabs, backslash escapes, \\N for null) and CSV, over files."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL = "\\N"
#: Escapes by letter (fixed values), with the character that each stands for.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
TIMES = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_text(df: DataFrame, path: str, delimiter: str = "\t", null: str = NULL) -> None:
    """COPY ... TO: a line for each row; backslash, line ends and the delimiter are escaped."""

    def field(c):
        x = F.replace(F.col(f"`{c}`").cast("string"), F.lit("\\"), F.lit("\\\\"))
        for mark, raw in ESCAPES.items():
            x = F.replace(x, F.lit(raw), F.lit("\\" + mark))
        if delimiter != "\t":
            x = F.replace(x, F.lit(delimiter), F.lit("\\" + delimiter))
        return F.coalesce(x, F.lit(null))

    df.select(F.array_join(F.array(*map(field, df.columns)), delimiter).alias("value")).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str, schema: str, delimiter: str = "\t", null: str = NULL) -> DataFrame:
    """COPY ... FROM: fields cast to the schema; a line with another number of fields is an error."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    end = re.escape(delimiter)
    # a field runs to a delimiter that no backslash stands before
    parts = F.regexp_extract_all(F.concat("value", F.lit(delimiter)), F.lit(rf"((?:[^\\{end}]++|\\(?s:.))*+){end}"), F.lit(1))
    wrong = F.raise_error(F.concat(F.lit("COPY: wrong number of fields: "), F.col("value")))
    parts = F.when((F.size(parts) == len(fields)) & (F.length(F.array_join(parts, delimiter)) == F.length("value")), parts).otherwise(wrong.cast("array<string>"))

    def value(i, f):
        x = F.get(F.col("_parts"), F.lit(i))
        return F.when(x != null, F.when(F.contains(x, F.lit("\\")), _unescaped(x)).otherwise(x).cast(f.dataType)).alias(f.name)

    return spark.read.text(path).select(parts.alias("_parts")).select(*[value(i, f) for i, f in enumerate(fields)])


def _unescaped(x: Column) -> Column:
    """Escapes undone from left to right: letters, up to three octal or two hex digits for a byte, any other character for itself."""
    tokens = F.regexp_extract_all(x, F.lit(r"[^\\]++|\\(?:x[0-9A-Fa-f]{1,2}|[0-7]{1,3}|(?s:.))"), F.lit(0))

    def as_hex(token: Column) -> Column:
        letter, rest = F.substring(token, 2, 1), F.substring(token, F.lit(3), F.length(token))
        after = F.substring(token, F.lit(2), F.length(token))
        byte = F.when((letter == "x") & (rest != ""), F.lpad(rest, 2, "0")).when(letter.between("0", "7"), F.lpad(F.conv(F.pmod(F.conv(after, 8, 10).cast("int"), F.lit(256)).cast("string"), 10, 16), 2, "0"))
        plain = after
        for mark, raw in ESCAPES.items():
            plain = F.when((letter == mark) & (rest == ""), F.lit(raw)).otherwise(plain)
        return F.when(F.startswith(token, F.lit("\\")), F.coalesce(byte, F.hex(F.encode(plain, "UTF-8")))).otherwise(F.hex(F.encode(token, "UTF-8")))

    return F.decode(F.unhex(F.array_join(F.transform(tokens, as_hex), "")), "UTF-8")


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", null: str = "") -> None:
    """COPY ... TO (FORMAT csv): quotes where needed, doubled inside; empty texts are quoted, nulls are not."""
    df.write.mode("overwrite").options(header=header, sep=delimiter, quote='"', escape='"', nullValue=null, emptyValue='""', timestampFormat=TIMES, timestampNTZFormat=TIMES, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, delimiter: str = ",", null: str = "", on_error: str = "stop") -> DataFrame:
    """COPY ... FROM (FORMAT csv); on_error "ignore" drops rows that don't fit."""
    empty = f"empty-{uuid.uuid4()}"  # tells a quoted empty text from null
    options = {"header": header, "sep": delimiter, "quote": '"', "escape": '"', "multiLine": True, "nullValue": null, "emptyValue": empty, "timestampFormat": TIMES, "timestampNTZFormat": TIMES, "enforceSchema": not header}
    df = spark.read.schema(schema).options(**options, mode="FAILFAST" if on_error == "stop" else "DROPMALFORMED").csv(path)
    return df.select(*[F.when(F.col(c) == empty, "").otherwise(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])
