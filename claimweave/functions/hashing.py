"""Digests, deterministic ids and hash splits."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_of(*parts: Column, separator: str = "|") -> Column:
    """SHA-256 of the parts as text, null as empty."""
    return F.sha2(F.concat_ws(separator, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def leading_bucket(key: Column, buckets: int = 100) -> Column:
    """The first 32 bits of the key's SHA-256, modulo ``buckets``."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % buckets


def whole_digest_bucket(key: Column, buckets: int = 100) -> Column:
    """The whole 256-bit SHA-256 modulo ``buckets``, digit by digit."""
    digits = F.filter(F.split(F.sha2(key, 256), ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0), lambda a, c: (a * 16 + F.instr(F.lit("0123456789abcdef"), c) - 1) % buckets)


def split_name(key: Column, seed: str, shares: list[tuple[str, int]]) -> Column:
    """Which named share of 100 buckets a key falls into."""
    bucket = leading_bucket(F.concat(F.lit(f"{seed}:"), key))
    out, upto = None, 0
    for name, share in shares:
        upto += share
        out = F.when(bucket < upto, name) if out is None else out.when(bucket < upto, name)
    return out


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA-256 in hex, with the two padded keys worked out once and the digests by Spark."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in k) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """The version 5 UUID of a name."""
    h = F.sha1(F.concat(F.lit(bytes.fromhex(namespace_hex)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )
