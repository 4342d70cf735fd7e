"""Addresses as the kernel prints them, and key fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _octets(hex8: Column) -> Column:
    return F.concat_ws(".", *[F.conv(F.substring(hex8, at, 2), 16, 10) for at in (7, 5, 3, 1)])


def socket_address(pair: Column) -> Column:
    """The address of `0100007F:0035`: IPv4 dotted, the two plain IPv6 ones by name, others as they are."""
    h = F.substring_index(pair, ":", 1)
    return F.when(F.length(h) == 8, _octets(h)).when(h == "0" * 32, "::").when(h == "0" * 24 + "01000000", "::1").otherwise(h)


def socket_port(pair: Column) -> Column:
    return F.conv(F.substring_index(pair, ":", -1), 16, 10).cast("bigint")


def igmp_address(hex8: Column) -> Column:
    return _octets(F.upper(hex8))


def igmp6_address(hex32: Column) -> Column:
    """Eight groups without leading zeros, the longest run of two or more zero groups (the first of equal ones) as ::."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.regexp_replace(F.substring(hex32, i * 4 + 1, F.lit(4)), "^0{1,3}", "")))
    text = F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":"))
    out = F.substring(text, F.lit(2), F.length(text) - 2)
    for n in range(2, 9):
        run = ":" + "0:" * n
        whole = F.regexp_replace(F.regexp_replace(text, f"^(.*?){run}", "$1::"), "^:(?!:)|(?<!:):$", "")
        out = F.when(F.contains(text, F.lit(run)), whole).otherwise(out)
    return out


def key_fingerprint(body: Column) -> Column:
    """`SHA256:` and the unpadded base64 of the hash of a base64 key body; null where it is no base64."""
    bare = F.regexp_replace(body, "=+$", "")
    valid = body.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.length(bare) % 4 != 1)
    padded = F.rpad(bare, F.ceil(F.length(bare) / 4).cast("int") * 4, F.lit("="))
    return F.when(valid, F.concat(F.lit("SHA256:"), F.regexp_replace(F.base64(F.unhex(F.sha2(F.unbase64(padded), 256))), "=+$", "")))
