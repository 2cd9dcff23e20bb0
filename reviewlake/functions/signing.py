"""Keyed digests from built-in hash functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64  # bytes per SHA-256 block


def hmac_sha256_hex(body: Column, secret: str) -> Column:
    """HMAC-SHA256 of a BINARY column; only the two key pads are prepared on the driver."""
    key = secret.encode("utf-8")
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256)


def stable_id(*parts: Column) -> Column:
    """Deterministic key: hash of the parts, each with its length in front."""
    pieces: list[Column] = []
    for part in parts:
        text = F.coalesce(part.cast("string"), F.lit(""))
        pieces += [F.length(text).cast("string"), F.lit(":"), text, F.lit("|")]
    return F.sha2(F.concat(*pieces), 256)
