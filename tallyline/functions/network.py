"""IPv4 networks and CIDR lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, strip

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"


def network24(ip: Column | str) -> Column:
    """``a.b.c.0/24`` of a valid dotted address, null otherwise (leading zeros are invalid)."""
    ip = col(ip)
    return F.when(ip.rlike(IPV4), F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24")))


def cidr_list(text: Column | str) -> Column:
    """Comma text to CIDR blocks; an address without a mask is one host."""
    parts = F.filter(F.transform(F.split(col(text), ","), strip), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(F.contains(x, F.lit("/")), x).otherwise(F.concat(x, F.lit("/32"))))
