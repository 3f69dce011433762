"""Mathematical functions."""

from __future__ import annotations

import decimal
import math

from pyspark.sql import functions as F

from .base import col, cols, kept, null_if_any, python


def trunc(x, digits: int = 0):
    """Towards zero, at a number of decimal digits."""
    x, scale = col(x), F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale if digits else F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def round_(x, digits: int | None = None):
    """Decimals half away from zero, at the given digits; doubles without digits half to even."""
    return F.rint(col(x)) if digits is None else F.round(col(x), digits)


@cols
def sqrt(x):
    return F.when(x < 0, F.raise_error(F.lit("cannot take square root of a negative number")).cast("double")).otherwise(F.sqrt(x))


def log(a, b=None):
    """Base 10 of one argument, base a of b with two."""
    return F.log10(col(a)) if b is None else F.ln(col(b)) / F.ln(col(a))


@cols
def div(a, b):
    """The whole part of the quotient."""
    return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(trunc(a / b))


@python("bigint")
def gcd(a, b):
    return math.gcd(int(a), int(b))


@python("bigint")
def lcm(a, b):
    return math.lcm(int(a), int(b))


@python("decimal(38,0)")
@kept
def factorial(n):
    if n < 0:
        raise ValueError("factorial of a negative number is undefined")
    return decimal.Decimal(math.factorial(n))


def _degrees(f, exact):
    """A trigonometric function of degrees, exact at the given angles."""

    @cols
    def of(x):
        turn = F.pmod(x.cast("double"), F.lit(360.0))
        out = f(F.radians(x))
        for angle, value in exact.items():
            out = F.when(turn == angle, F.lit(value)).otherwise(out)
        return F.when(x.isNull(), None).otherwise(out)

    return of


INF = float("inf")
sind = _degrees(F.sin, {0.0: 0.0, 30.0: 0.5, 90.0: 1.0, 150.0: 0.5, 180.0: 0.0, 210.0: -0.5, 270.0: -1.0, 330.0: -0.5})
cosd = _degrees(F.cos, {0.0: 1.0, 60.0: 0.5, 90.0: 0.0, 120.0: -0.5, 180.0: -1.0, 240.0: -0.5, 270.0: 0.0, 300.0: 0.5})
tand = _degrees(F.tan, {0.0: 0.0, 45.0: 1.0, 90.0: INF, 135.0: -1.0, 180.0: 0.0, 225.0: 1.0, 270.0: -INF, 315.0: -1.0})
cotd = _degrees(F.cot, {0.0: INF, 45.0: 1.0, 90.0: 0.0, 135.0: -1.0, 180.0: -INF, 225.0: 1.0, 270.0: 0.0, 315.0: -1.0})


def _exact_degrees(f):
    """Degrees of an inverse, to the nearest 1e-13 so that round angles come out whole."""
    return cols(lambda *a: F.round(F.degrees(f(*a)), 13))


def width_bucket(x, low, high=None, count=None):
    """Bucket of x among `count` equal ones, or with an array the number of thresholds at or below it."""
    x = col(x)
    if high is None:
        return null_if_any(F.size(F.filter(col(low), lambda t: t <= x)), x)
    return F.width_bucket(x.cast("double"), col(low).cast("double"), col(high).cast("double"), col(count).cast("long")).cast("int")


@python("int")
@kept
def scale(x):
    return max(0, -decimal.Decimal(str(x)).as_tuple().exponent)


@python("int")
@kept
def min_scale(x):
    return max(0, -decimal.Decimal(str(x)).normalize().as_tuple().exponent)


@python("string")
@kept
def trim_scale(x):
    return format(decimal.Decimal(str(x)).normalize(), "f")


@python("bigint")
def crc32c(data):
    """The Castagnoli checksum (reflected polynomial 0x82F63B78)."""
    return _crc32c(data.encode() if isinstance(data, str) else bytes(data))


def _crc_of_byte(crc: int) -> int:
    for _ in range(8):
        crc = (crc >> 1) ^ (0x82F63B78 & -(crc & 1))
    return crc


_CRC = tuple(map(_crc_of_byte, range(256)))


def _crc32c_of(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc >> 8) ^ _CRC[(crc ^ byte) & 255]
    return crc ^ 0xFFFFFFFF


_crc32c_short = kept(_crc32c_of)


def _crc32c(data: bytes) -> int:
    return _crc32c_short(data) if len(data) <= 256 else _crc32c_of(data)


def _decimal(f):
    """A function of decimal numbers to 30 digits, as text of 16 decimals cast to decimal."""

    @kept
    def value(*args):
        with decimal.localcontext() as context:
            context.prec = 40
            return f(*[decimal.Decimal(str(a)) for a in args]).quantize(decimal.Decimal(1).scaleb(-16))

    value.__name__ = "numeric"
    return python("decimal(38,16)")(value)


FUNCTIONS = {
    "abs": cols(F.abs),
    "ceil": cols(F.ceil),
    "ceiling": cols(F.ceil),
    "floor": cols(F.floor),
    "round": round_,
    "trunc": trunc,
    "truncate": trunc,
    "sign": cols(F.signum),
    "sqrt": sqrt,
    "cbrt": cols(F.cbrt),
    "exp": cols(F.exp),
    "ln": cols(F.ln),
    "log": log,
    "log10": cols(F.log10),
    "log2": cols(F.log2),
    "power": cols(F.pow),
    "pow": cols(F.pow),
    "mod": cols(lambda a, b: a % b),
    "div": div,
    "gcd": gcd,
    "lcm": lcm,
    "factorial": factorial,
    "pi": F.pi,
    "degrees": cols(F.degrees),
    "radians": cols(F.radians),
    "sin": cols(F.sin),
    "cos": cols(F.cos),
    "tan": cols(F.tan),
    "cot": cols(F.cot),
    "asin": cols(F.asin),
    "acos": cols(F.acos),
    "atan": cols(F.atan),
    "atan2": cols(F.atan2),
    "sind": sind,
    "cosd": cosd,
    "tand": tand,
    "cotd": cotd,
    "asind": _exact_degrees(F.asin),
    "acosd": _exact_degrees(F.acos),
    "atand": _exact_degrees(F.atan),
    "atan2d": _exact_degrees(F.atan2),
    "sinh": cols(F.sinh),
    "cosh": cols(F.cosh),
    "tanh": cols(F.tanh),
    "asinh": cols(F.asinh),
    "acosh": cols(F.acosh),
    "atanh": cols(F.atanh),
    "erf": python("double")(math.erf),
    "erfc": python("double")(math.erfc),
    "width_bucket": width_bucket,
    "random": F.rand,
    "rand": F.rand,
    "random_normal": lambda mean=0.0, deviation=1.0, seed=None: F.randn(seed) * deviation + mean,
    "random_int": lambda low, high, seed=None: (F.floor(F.rand(seed) * (col(high) - col(low) + 1)) + col(low)).cast("long"),
    "setseed": F.rand,
    "scale": cols(lambda x: scale(x.cast("string"))),
    "min_scale": cols(lambda x: min_scale(x.cast("string"))),
    "trim_scale": cols(lambda x: trim_scale(x.cast("string"))),
    "numeric_div_trunc": div,
    "numeric_exp": _decimal(lambda x: x.exp()),
    "numeric_ln": _decimal(lambda x: x.ln()),
    "numeric_log": _decimal(lambda b, x: x.ln() / b.ln()),
    "numeric_sqrt": _decimal(lambda x: x.sqrt()),
    "bin": cols(lambda x: F.bin(x.cast("long"))),
    "oct": cols(lambda x: F.conv(x.cast("string"), 10, 8)),
    "hex": cols(F.hex),
    "unhex": cols(F.unhex),
    "conv": lambda x, a, b: F.conv(col(x).cast("string"), a, b),
    "to_hex": cols(lambda x: F.lower(F.hex(x))),
    "to_bin": cols(lambda x: F.bin(x.cast("long"))),
    "to_oct": cols(lambda x: F.conv(x.cast("string"), 10, 8)),
    "bit_count": cols(F.bit_count),
    "crc32": cols(F.crc32),
    "crc32c": crc32c,
    "isfinite": cols(lambda x: null_if_any(~F.isnan(x) & (F.abs(x) < INF), x)),
    "int8inc": cols(lambda x: x + 1),
    "int8dec": cols(lambda x: x - 1),
    **{f"{t}larger": cols(F.greatest) for t in ("int2", "int4", "int8", "float4", "float8", "cash", "oid")},
    **{f"{t}smaller": cols(F.least) for t in ("int2", "int4", "int8", "float4", "float8", "cash", "oid")},
    "numeric_larger": cols(F.greatest),
    "numeric_smaller": cols(F.least),
}
