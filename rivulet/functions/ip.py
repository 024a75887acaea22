"""IP addresses. IPv4 stays in Spark's own expressions; only rows with IPv6 text go through Arrow."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rivulet.functions._args import col
from rivulet.shipping import ship

_V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"


def is_ipv4(ip: Column | str) -> Column:
    """True for dotted IPv4 text, false for other text, null for null."""
    return col(ip).rlike(_V4)


def _v4_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return F.aggregate(F.transform(parts, lambda x: x.try_cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)


def _v6_numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(x: str | None) -> Decimal | None:
        try:
            n = int(ipaddress.ip_address(x)) if x else None
        except ValueError:
            return None
        return Decimal(n) if n is not None and n < 10**38 else None

    for s in batches:
        yield s.map(one)


def _v6_number():  # noqa: ANN202
    ship(SparkSession.getActiveSession())
    return F.pandas_udf(_v6_numbers, "decimal(38,0)")


def ip_to_int(ip: Column | str) -> Column:
    """The address as a number; null for text that is no address and for IPv6 beyond 38 digits."""
    c = col(ip)
    v4 = is_ipv4(c)
    return F.when(v4, _v4_number(F.when(v4, c)).cast("decimal(38,0)")).when(c.contains(":"), _v6_number()(F.when(c.contains(":"), c)))


def _in_networks(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    networks: dict = {}

    def one(ip: str | None, net: str | None) -> bool | None:
        if ip is None or net is None:
            return None
        if net not in networks:
            networks[net] = ipaddress.ip_network(net, strict=False)
        address = ipaddress.ip_address(ip)
        if address.version != networks[net].version:
            raise ValueError(f"{ip} and {net} are of different versions")
        return address in networks[net]

    for ip, net in batches:
        yield pd.Series([one(a, b) for a, b in zip(ip, net, strict=True)], dtype=object)


def _in_network():  # noqa: ANN202
    ship(SparkSession.getActiveSession())
    return F.pandas_udf(_in_networks, "boolean")


def cidrmatch(ip: Column | str, network: Column | str) -> Column:
    """Whether an address is in a network; bad addresses and mixed versions are errors.

    For a network given as text and IPv4, a comparison of numbers that never leaves the JVM.
    """
    c = col(ip)
    if isinstance(network, str):
        net = ipaddress.ip_network(network, strict=False)
        if net.version == 4:
            inside = _v4_number(c).between(int(net.network_address), int(net.broadcast_address))
            bad = F.raise_error(F.concat(F.lit("not an IPv4 address: "), c)).cast("boolean")
            return F.when(c.isNotNull() & ~is_ipv4(c), bad).otherwise(inside)
        return _in_network()(c, F.lit(network))
    return _in_network()(c, network)
