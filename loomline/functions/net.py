"""Addresses and hosts as columns."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

QUAD = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
# Private networks and the exempt documentation, loopback and metadata networks, as (first, last) numbers below.
PRIVATE_V4 = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "100.64.0.0/10")
EXEMPT_V4 = ("127.0.0.0/8", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "169.254.169.254/32")
PRIVATE_V6 = ("fc00::/7", "fe80::/10")
EXEMPT_V6 = ("2001:db8::/32", "::1/128", "::/128")


def ipv4_number(host: Column) -> Column:
    """The 32-bit number of a dotted quad whose parts may be 0x hex, leading-0 octal or decimal; null for others."""
    parts = F.split(F.lower(host), r"\.")

    def number(p: Column) -> Column:
        return (
            F.when(p.rlike(r"^0x[0-9a-f]{1,8}$"), F.conv(F.substring(p, 3, 8), 16, 10).cast("bigint"))
            .when(p.rlike(r"^0[0-7]+$"), F.conv(p, 8, 10).cast("bigint"))
            .when(p.rlike(r"^(0|[1-9][0-9]{0,9})$"), p.try_cast("bigint"))
        )

    values = F.transform(parts, number)
    good = (F.size(parts) == 4) & F.forall(values, lambda v: v.isNotNull() & v.between(0, 255))
    return F.when(good, F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a * 256 + v))


def _within(number: Column, networks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in map(ipaddress.ip_network, networks):
        out = out | number.between(int(n.network_address), int(n.broadcast_address))
    return out


def is_private_ipv4(host: Column) -> Column:
    """Does the host name a machine on a private network? False for anything that is no IPv4 address."""
    n = ipv4_number(host)
    return F.coalesce(_within(n, PRIVATE_V4) & ~_within(n, EXEMPT_V4) & (n != 0), F.lit(False))


def private_ipv4s(text: Column) -> Column:
    """The private IPv4 addresses written in a text, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(QUAD), F.lit(0)), is_private_ipv4)


@F.pandas_udf(BooleanType())
def is_private_ipv6(host: pd.Series) -> pd.Series:
    """IPv6 has no SQL type: exact parse of each host."""
    private, exempt = [[ipaddress.ip_network(x) for x in nets] for nets in (PRIVATE_V6, EXEMPT_V6)]

    def test(h: str | None) -> bool:
        try:
            a = ipaddress.IPv6Address((h or "").strip("[]"))
        except ValueError:
            return False
        return any(a in n for n in private) and not any(a in n for n in exempt)

    return host.map(test).astype(bool)


def url_host(url: Column) -> Column:
    """Lower-case host; null for what is no URL."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_external_url(url: Column) -> Column:
    """http(s) to a public host: not private, loopback or reserved, with a dot, and not an illustrative domain."""
    host = url_host(url)
    n = ipv4_number(host)
    reserved = _within(n, (*PRIVATE_V4, "127.0.0.0/8", "0.0.0.0/8", "240.0.0.0/4"))
    illustrative = host.rlike(r"(^|\.)(example\.(com|org|net)|example|test|invalid|localhost|local|internal)$")
    return F.coalesce(url.rlike(r"(?i)^https?://") & host.contains(".") & ~F.coalesce(reserved, F.lit(False)) & ~illustrative, F.lit(False))
