"""Public URL check: scheme, user info, host name and literal IP address ranges."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opporta.functions import let, url

# IPv4 ranges that are private, loopback, link-local, multicast, reserved or unspecified.
CLOSED_IPV4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]
OPEN_IPV4 = ["192.0.0.9/32", "192.0.0.10/32"]
REASONS = {
    "scheme": "Chỉ hỗ trợ URL HTTP hoặc HTTPS",
    "user": "URL không được chứa username hoặc password",
    "host": "URL thiếu domain",
    "local": "Không cho phép địa chỉ nội bộ",
    "range": "Không cho phép địa chỉ mạng nội bộ hoặc dành riêng",
}

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


@F.pandas_udf(T.BooleanType())
def _closed_ipv6(hosts: pd.Series) -> pd.Series:
    def closed(value):
        try:
            a = ipaddress.ip_address(value)
        except ValueError:
            return False
        return (a.is_private or a.is_loopback or a.is_link_local or a.is_multicast
                or a.is_reserved or a.is_unspecified)
    return hosts.map(closed, na_action="ignore").astype("boolean")


def _in_any(number: Column, cidrs: list[str]) -> Column:
    out = F.lit(False)
    for cidr in cidrs:
        net = ipaddress.ip_network(cidr)
        out = out | number.between(int(net.network_address), int(net.broadcast_address))
    return out


def url_problem(col: Column) -> Column:
    """Null for a public URL, else the reason. Names are not resolved."""
    has_colon = url.host(col).contains(":")
    closed6 = F.when(has_colon, _closed_ipv6(F.when(has_colon, url.host(col))))
    return (
        F.when(~url.scheme(col).isin("http", "https"), REASONS["scheme"])
        .when(url.netloc(col).rlike(r"^[^@:]+(?::[^@]*)?@|^:[^@]+@"), REASONS["user"])
        .otherwise(F.coalesce(
            let(F.trim(url.host(col)), _name_problem),
            F.when(closed6, REASONS["range"]))))


def _name_problem(place: Column) -> Column:
    octets = [F.regexp_extract(place, _IPV4, g) for g in (1, 2, 3, 4)]
    number = sum((o.try_cast("bigint") * (256 ** (3 - i)) for i, o in enumerate(octets)), F.lit(0))
    return (
        F.when(place == "", REASONS["host"])
        .when(place.isin("localhost", "localhost.localdomain") | place.endswith(".local"), REASONS["local"])
        .when(place.rlike(_IPV4), let(number, lambda n: F.when(
            _in_any(n, CLOSED_IPV4) & ~_in_any(n, OPEN_IPV4), REASONS["range"]))))


# Hosts of search engines; their subdomains count too.
SEARCH_ENGINES = [
    "google.com", "bing.com", "yahoo.com", "search.yahoo.com",
    "duckduckgo.com", "yandex.com", "baidu.com", "ecosia.org",
]


def is_search_engine(canonical_url: Column) -> Column:
    names = "|".join(name.replace(".", r"\.") for name in SEARCH_ENGINES)
    return url.host(canonical_url).rlike(rf"(?:^|\.)(?:{names})$")
