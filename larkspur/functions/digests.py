"""Hashes, encodings, bytes and UUIDs."""

from __future__ import annotations

import base64
import hashlib
import hmac as hmac_
import secrets
import time
import uuid

from pyspark.sql import functions as F

from .base import col, cols, python


def _bytes(x) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def sha(bits: int):
    return cols(lambda x: F.unhex(F.sha2(x, bits)))


def digest(x, algorithm: str):
    name = algorithm.lower()
    return F.unhex(F.md5(col(x))) if name == "md5" else F.unhex(F.sha1(col(x))) if name == "sha1" else F.unhex(F.sha2(col(x), int(name.removeprefix("sha"))))


@python("binary")
def hmac(data, key, algorithm):
    return hmac_.new(_bytes(key), _bytes(data), algorithm.lower()).digest()


@python("binary")
def gen_random_bytes(n):
    return secrets.token_bytes(n)


def _escape(data: bytes) -> str:
    return "".join("\\\\" if b == 92 else chr(b) if 32 <= b < 127 else f"\\{b:03o}" for b in data)


def _unescape(text: str) -> bytes:
    out, i = bytearray(), 0
    while i < len(text):
        if text[i] == "\\":
            if text[i + 1 : i + 2] == "\\":
                out.append(92)
                i += 2
            else:
                out.append(int(text[i + 1 : i + 4], 8))
                i += 4
        else:
            out += text[i].encode()
            i += 1
    return bytes(out)


escape = python("string")(lambda b: _escape(_bytes(b)))
unescape = python("binary")(_unescape)


def encode(data, form: str):
    form = form.lower()
    return F.lower(F.hex(col(data))) if form == "hex" else F.base64(col(data)) if form == "base64" else escape(data)


def decode(text, form: str):
    form = form.lower()
    return F.unhex(col(text)) if form == "hex" else F.unbase64(col(text)) if form == "base64" else unescape(text)


def _crc24(data: bytes) -> int:
    """The checksum of OpenPGP armor: generator 0x1864CFB, start 0xB704CE."""
    crc = 0xB704CE
    for byte in data:
        crc ^= byte << 16
        for _ in range(8):
            crc <<= 1
            if crc & 0x1000000:
                crc ^= 0x1864CFB
    return crc & 0xFFFFFF


@python("string")
def armor(data):
    raw = _bytes(data)
    body = base64.b64encode(raw).decode()
    lines = [body[i : i + 76] for i in range(0, len(body), 76)]
    check = base64.b64encode(_crc24(raw).to_bytes(3, "big")).decode()
    return "-----BEGIN PGP MESSAGE-----\n\n" + "\n".join(lines) + f"\n={check}\n-----END PGP MESSAGE-----\n"


@python("binary")
def dearmor(text):
    body = text.split("\n\n", 1)[1].split("-----END")[0].split()
    raw = base64.b64decode("".join(x for x in body if not x.startswith("=")))
    stated = next((x[1:] for x in body if x.startswith("=")), None)
    if stated and int.from_bytes(base64.b64decode(stated), "big") != _crc24(raw):
        raise ValueError("corrupt ascii-armor")
    return raw


#: The alphabet of crypt() (fixed value).
_CRYPT64 = "./0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _crypt64(value: int, n: int) -> str:
    return "".join(_CRYPT64[value >> 6 * i & 63] for i in range(n))


@python("string")
def gen_salt(kind):
    if kind != "md5":
        raise ValueError("only md5 salts are made here")
    return "$1$" + "".join(secrets.choice(_CRYPT64) for _ in range(8))


@python("string")
def crypt(password, setting):
    """The MD5-based scheme ($1$) of crypt(); other schemes are not offered."""
    if not setting.startswith("$1$"):
        raise ValueError("only $1$ settings are understood here")
    pw, salt = password.encode(), setting[3:].split("$")[0][:8].encode()
    inner = hashlib.md5(pw + salt + pw).digest()
    mixed = pw + b"$1$" + salt + (inner * (len(pw) // 16 + 1))[: len(pw)]
    bits = len(pw)
    while bits:
        mixed += b"\0" if bits & 1 else pw[:1]
        bits >>= 1
    out = hashlib.md5(mixed).digest()
    for i in range(1000):
        part = (pw if i & 1 else out) + (salt if i % 3 else b"") + (pw if i % 7 else b"") + (out if i & 1 else pw)
        out = hashlib.md5(part).digest()
    body = "".join(_crypt64(out[a] << 16 | out[b] << 8 | out[c], 4) for a, b, c in ((0, 6, 12), (1, 7, 13), (2, 8, 14), (3, 9, 15), (4, 10, 5)))
    return f"$1${salt.decode()}${body}{_crypt64(out[11], 2)}"


# PostgreSQL's hash functions: Bob Jenkins' lookup3 with its starting value.

_M = 0xFFFFFFFF
_START = 0x9E3779B9 + 3923095


def _rot(x, k):
    return ((x << k) | (x >> (32 - k))) & _M


def _final(a, b, c):
    for x, y, z, k in ((2, 1, 0, 14), (0, 2, 0, 11), (1, 0, 0, 25), (2, 1, 0, 16), (0, 2, 0, 4), (1, 0, 0, 14), (2, 1, 0, 24)):
        v = [a, b, c]
        v[x] = ((v[x] ^ v[y]) - _rot(v[y], k)) & _M
        a, b, c = v
    return a, b, c


def _mix(a, b, c):
    for k in (4, 6, 8, 16, 19, 4):
        a = (a - c) & _M
        a ^= _rot(c, k)
        c = (c + b) & _M
        a, b, c = b, c, a
    return a, b, c


def hash_bytes(data: bytes) -> int:
    n = len(data)
    a = b = c = (_START + n) & _M
    at = 0
    while n - at >= 12:
        x, y, z = (int.from_bytes(data[at + 4 * i : at + 4 * i + 4], "little") for i in range(3))
        a, b, c = _mix((a + x) & _M, (b + y) & _M, (c + z) & _M)
        at += 12
    rest = data[at:]
    a = (a + int.from_bytes(rest[:4], "little")) & _M
    b = (b + int.from_bytes(rest[4:8], "little")) & _M
    c = (c + (int.from_bytes(rest[8:], "little") << 8)) & _M
    return _final(a, b, c)[2]


def hash_word(k: int) -> int:
    a = b = c = (_START + 4) & _M
    return _final((a + (k & _M)) & _M, b, c)[2]


def _signed(x: int) -> int:
    return x - (1 << 32) if x >= 1 << 31 else x


def _hash_long(v: int) -> int:
    low, high = v & _M, (v >> 32) & _M
    return hash_word(low ^ (high if v >= 0 else ~high & _M))


hashint4 = python("int")(lambda v: _signed(hash_word(v)))
hashint8 = python("int")(lambda v: _signed(_hash_long(v)))
hashtext = python("int")(lambda s: _signed(hash_bytes(_bytes(s))))


@cols
def get_byte(b, i):
    return F.conv(F.hex(F.substring(b, i + 1, F.lit(1))), 16, 10).cast("int")


@python("int")
def get_bit(b, i):
    if isinstance(b, str):
        return int(b[i])
    return bytes(b)[i // 8] >> i % 8 & 1


@python("binary")
def set_bit(b, i, value):
    out = bytearray(b)
    out[i // 8] = out[i // 8] & ~(1 << i % 8) | (value << i % 8)
    return bytes(out)


@python("binary")
def set_byte(b, i, value):
    out = bytearray(b)
    out[i] = value & 255
    return bytes(out)


def _bytewise(op):
    def value(a, b):
        if len(a) != len(b):
            raise ValueError("lengths differ")
        return bytes(op(x, y) for x, y in zip(bytes(a), bytes(b), strict=True))

    value.__name__ = "bytewise"
    return python("binary")(value)


def _uuid7(*_):
    ms = time.time_ns() // 1_000_000
    raw = bytearray(ms.to_bytes(6, "big") + secrets.token_bytes(10))
    raw[6], raw[8] = raw[6] & 15 | 0x70, raw[8] & 63 | 0x80
    return str(uuid.UUID(bytes=bytes(raw)))



def uuid7():
    return F.udf(_uuid7, "string").asNondeterministic()()


NAMESPACES = {"dns": uuid.NAMESPACE_DNS, "url": uuid.NAMESPACE_URL, "oid": uuid.NAMESPACE_OID, "x500": uuid.NAMESPACE_X500}


def uuid_version(x):
    return F.conv(F.substring(col(x), 15, 1), 16, 10).cast("int")


def uuid_timestamp(x):
    """Of a version 7 UUID; null for others."""
    ms = F.conv(F.concat(F.substring(col(x), 1, 8), F.substring(col(x), 10, 4)), 16, 10).cast("long")
    return F.when(uuid_version(x) == 7, F.timestamp_millis(ms))


FUNCTIONS = {
    "md5": cols(F.md5),
    "sha": cols(F.sha1),
    "sha1": cols(F.sha1),
    "sha2": lambda x, n=256: F.sha2(col(x), n),
    "sha224": sha(224),
    "sha256": sha(256),
    "sha384": sha(384),
    "sha512": sha(512),
    "digest": digest,
    "hmac": hmac,
    "gen_random_bytes": gen_random_bytes,
    "random_bytes": gen_random_bytes,
    "encode": encode,
    "decode": decode,
    "to_base64": cols(F.base64),
    "from_base64": cols(F.unbase64),
    "crypt": crypt,
    "gen_salt": gen_salt,
    "armor": armor,
    "dearmor": dearmor,
    "convert": lambda b, a, c: F.encode(F.decode(col(b), a), c),
    "convert_from": lambda b, charset="UTF-8": F.decode(col(b), charset),
    "convert_to": lambda s, charset="UTF-8": F.encode(col(s), charset),
    "hashint2": hashint4,
    "hashint4": hashint4,
    "hashint8": hashint8,
    "hashtext": hashtext,
    "hashbytea": hashtext,
    "get_bit": get_bit,
    "set_bit": set_bit,
    "get_byte": get_byte,
    "set_byte": set_byte,
    "byteacat": cols(F.concat),
    "bytea_and": _bytewise(lambda x, y: x & y),
    "bytea_or": _bytewise(lambda x, y: x | y),
    "bytea_xor": _bytewise(lambda x, y: x ^ y),
    "byteaxor": _bytewise(lambda x, y: x ^ y),
    "bytea_larger": cols(F.greatest),
    "bytea_smaller": cols(F.least),
    "gen_random_uuid": F.uuid,
    "uuid_generate_v4": F.uuid,
    "gen_uuid_v7": uuid7,
    "uuidv7": uuid7,
    "uuid_generate_v7": uuid7,
    "uuid_generate_v3": python("string")(lambda space, name: str(uuid.uuid3(uuid.UUID(space), name))),
    "uuid_generate_v5": python("string")(lambda space, name: str(uuid.uuid5(uuid.UUID(space), name))),
    "uuid_nil": lambda: F.lit("00000000-0000-0000-0000-000000000000"),
    "uuid_short": F.monotonically_increasing_id,
    "uuid_extract_timestamp": uuid_timestamp,
    "uuid_extract_version": uuid_version,
    "is_uuid": lambda x: col(x).rlike(r"^(?:[0-9A-Fa-f]{32}|\{?[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}?)$"),
    "uuid": cols(lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, "[{}-]", ""), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))),
}
