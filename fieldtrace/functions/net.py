"""Address functions as Column expressions."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUAD = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
# fixed values: IPv4 blocks that are private, loopback, link-local, shared, documentation or reserved
NOT_GLOBAL_V4 = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
                 "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
                 "203.0.113.0/24", "240.0.0.0/4"]
PRIVATE_V4 = [b for b in NOT_GLOBAL_V4 if b != "100.64.0.0/10"]
# fixed values: suffixes that exist only inside private networks
INTERNAL_SUFFIXES = [".local", ".localdomain", ".lan", ".home", ".home.arpa", ".internal", ".intranet", ".corp",
                     ".private", ".localhost", ".test", ".invalid", ".example", ".arpa"]
_HOST = r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z][a-z0-9-]{0,62}$"


def ipv4_long(ip: Column) -> Column:
    """Dotted quad as an integer, null when it is not one."""
    p = F.split(ip, "\\.")
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value * 256 + F.try_element_at(p, F.lit(i + 1)).cast("long")
    return F.when(ip.rlike(_QUAD), value)


def in_block(ip: Column, block: str) -> Column:
    """IPv4 address inside a CIDR block, as a range test."""
    net = ipaddress.ip_network(block, strict=False)
    return F.coalesce(ipv4_long(ip).between(int(net[0]), int(net[-1])), F.lit(False))


def in_any(ip: Column, blocks: list[str]) -> Column:
    value, out = ipv4_long(ip), F.lit(False)
    for block in blocks:
        net = ipaddress.ip_network(block)
        out = out | value.between(int(net[0]), int(net[-1]))
    return F.coalesce(out, F.lit(False))


def _v6_internal(ip: Column) -> Column:
    low = F.lower(F.trim(ip))
    return (low == "::1") | (low == "::") | low.rlike("^f[cd][0-9a-f]{0,2}:") | low.rlike("^fe[89ab][0-9a-f]?:") | low.rlike(
        "^2001:0?db8:")


def is_private_ip(ip: Column) -> Column:
    """Private address; what does not parse is not private."""
    v6 = ip.contains(":") & _v6_internal(ip)
    return in_any(F.trim(ip), PRIVATE_V4) | F.coalesce(v6, F.lit(False))


def is_internal_ip(ip: Column) -> Column:
    """Anything but a global address; what does not parse counts as internal."""
    text = F.trim(ip)
    v4 = text.rlike(_QUAD)
    v6 = text.rlike("^[0-9A-Fa-f:.]+$") & text.contains(":")
    return F.coalesce(F.when(v4, in_any(text, NOT_GLOBAL_V4)).when(v6, _v6_internal(text)).otherwise(F.lit(True)), F.lit(True))


def is_public_domain(name: Column) -> Column:
    """A full host name that is not of a private suffix."""
    inside = F.lit(False)
    for suffix in INTERNAL_SUFFIXES:
        inside = inside | (name == suffix[1:]) | name.endswith(suffix)
    return F.coalesce(name.rlike(_HOST) & (F.length(name) <= 253) & ~inside, F.lit(False))


def glob_match(value: Column, pattern: str) -> Column:
    """``*`` matches any text."""
    if pattern == "*":
        return F.lit(True)
    if "*" not in pattern:
        return value == pattern
    return value.rlike("^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$")


def port_match(value: Column, pattern: str) -> Column:
    """A port, a range ``low-high`` or ``*``; anything else matches nothing."""
    if pattern == "*":
        return F.lit(True)
    m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", pattern)
    if not m:
        return F.lit(False)
    return value.between(int(m[1]), int(m[2] or m[1]))


def domain_parents(name: Column) -> Column:
    """The name and each parent of two labels or more: (domain, depth) pairs, nearest first."""
    labels = F.split(F.lower(name), "\\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(
        F.array_join(F.slice(labels, i, F.greatest(n - i + 1, F.lit(1))), ".").alias("domain"), i.alias("depth")))


def ipv4_text(quad: Column) -> Column:
    """Four bytes as a dotted quad."""
    return F.concat_ws(".", *[F.conv(F.hex(F.substring(quad, i, 1)), 16, 10) for i in range(1, 5)])


def mac_text(six: Column) -> Column:
    return F.lower(F.concat_ws(":", *[F.hex(F.substring(six, i, 1)) for i in range(1, 7)]))
