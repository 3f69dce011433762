"""Network addresses as text."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from .base import cols, python


def _interface(x: str):
    return ipaddress.ip_interface(x)


def _show(i) -> str:
    return str(i.ip) if i.network.prefixlen == i.max_prefixlen else str(i)


def _host_bits(i, n: int) -> str:
    return _show(ipaddress.ip_interface(f"{i.ip}/{n}"))


def _merge(a: str, b: str) -> str:
    x, y = _interface(a).network, _interface(b).network
    if x.version != y.version:
        raise ValueError("cannot merge addresses from different families")
    while not (y.subnet_of(x)):
        x = x.supernet()
    return str(x)


def _abbrev(x: str) -> str:
    i = _interface(x)
    return _show(i)


def _cidr_abbrev(x: str) -> str:
    net = ipaddress.ip_network(x, strict=False)
    if net.version == 6:
        return str(net)
    parts = str(net.network_address).split(".")[: max(1, -(-net.prefixlen // 8))]
    return ".".join(parts) + f"/{net.prefixlen}"


def _order(x: str):
    i = _interface(x)
    return i.version, i.network.network_address, i.network.prefixlen, i.ip


def _subnet(a: str, b: str, strict: bool) -> bool:
    x, y = _interface(a).network, _interface(b).network
    return x.version == y.version and x.subnet_of(y) and (not strict or x.prefixlen > y.prefixlen)


def _shift(a: str, n: int) -> str:
    i = _interface(a)
    return _show(ipaddress.ip_interface(f"{i.ip + n}/{i.network.prefixlen}"))


def _bits(op):
    def value(a, b):
        x, y = _interface(a), _interface(b)
        return _show(ipaddress.ip_interface((op(int(x.ip), int(y.ip)), max(x.network.prefixlen, y.network.prefixlen)))) if x.version == 4 else _show(ipaddress.IPv6Interface((op(int(x.ip), int(y.ip)), max(x.network.prefixlen, y.network.prefixlen))))

    value.__name__ = "bits"
    return python("string")(value)


def _not(a: str) -> str:
    i = _interface(a)
    made = type(i)((int(i.ip) ^ ((1 << i.max_prefixlen) - 1), i.network.prefixlen))
    return _show(made)


def _overlap(a: str, b: str) -> bool:
    x, y = _interface(a).network, _interface(b).network
    return x.version == y.version and x.overlaps(y)


def _valid(version: int):
    def value(x):
        try:
            return ipaddress.ip_address(x).version == version
        except ValueError:
            return False

    value.__name__ = f"is_ipv{version}"
    return python("boolean")(value)


def _set7bit(x: str) -> str:
    parts = x.replace("-", ":").lower().split(":")
    if len(parts) == 6:
        parts = [*parts[:3], "ff", "fe", *parts[3:]]
    return ":".join([f"{int(parts[0], 16) | 2:02x}", *parts[1:]])


@cols
def inet_aton(x):
    """Dotted text as a number, by shifts of its parts; short forms fill the last part."""
    p = F.transform(F.split(x, r"\."), lambda v: v.cast("long"))
    n = F.size(p)
    head = F.aggregate(F.transform(F.slice(p, F.lit(1), n - 1), lambda v, i: v * F.pow(F.lit(256.0), (3 - i).cast("double")).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(x.rlike(r"^\d{1,3}(\.\d{1,3}){0,3}$"), head + F.element_at(p, -1))


@cols
def inet_ntoa(n):
    n = n.cast("long")
    return F.when(n.between(0, 2**32 - 1), F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))


FUNCTIONS = {
    "host": cols(lambda x: F.substring_index(x, "/", 1)),
    "network": python("string")(lambda x: str(_interface(x).network)),
    "netmask": python("string")(lambda x: str(_interface(x).network.netmask)),
    "hostmask": python("string")(lambda x: str(_interface(x).network.hostmask)),
    "broadcast": python("string")(lambda x: _show(type(_interface(x))(f"{_interface(x).network.broadcast_address}/{_interface(x).network.prefixlen}"))),
    "masklen": python("int")(lambda x: _interface(x).network.prefixlen),
    "set_masklen": python("string")(lambda x, n: _host_bits(_interface(x), n)),
    "abbrev": python("string")(_abbrev),
    "cidr_abbrev": python("string")(_cidr_abbrev),
    "family": cols(lambda x: F.when(F.instr(x, ":") > 0, 6).when(x.isNotNull(), 4)),
    "inet_merge": python("string")(_merge),
    "inet_same_family": cols(lambda a, b: (F.instr(a, ":") > 0) == (F.instr(b, ":") > 0)),
    "network_larger": python("string")(lambda a, b: max(a, b, key=_order)),
    "network_smaller": python("string")(lambda a, b: min(a, b, key=_order)),
    "macaddr8_set7bit": python("string")(_set7bit),
    "inet_aton": inet_aton,
    "inet_ntoa": inet_ntoa,
    "inet6_aton": python("binary")(lambda x: ipaddress.ip_address(x).packed),
    "inet6_ntoa": python("string")(lambda b: str(ipaddress.ip_address(bytes(b)))),
    "is_ipv4": _valid(4),
    "is_ipv6": _valid(6),
    "inet_contained": python("boolean")(lambda a, b: _subnet(a, b, True)),
    "inet_contained_eq": python("boolean")(lambda a, b: _subnet(a, b, False)),
    "inet_contains": python("boolean")(lambda a, b: _subnet(b, a, True)),
    "inet_contains_eq": python("boolean")(lambda a, b: _subnet(b, a, False)),
    "inet_overlap": python("boolean")(_overlap),
    "inet_add": python("string")(_shift),
    "inet_subtract": python("bigint")(lambda a, b: int(_interface(a).ip) - int(_interface(b).ip)),
    "inet_and": _bits(lambda x, y: x & y),
    "inet_or": _bits(lambda x, y: x | y),
    "inet_not": python("string")(_not),
}
