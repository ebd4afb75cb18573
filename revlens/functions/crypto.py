"""HMAC-SHA256 request signatures with native SHA-2 expressions.

HMAC(K, m) = H((K' xor opad) || H((K' xor ipad) || m)); K' is the key padded
to the 64-byte block (keys longer than a block are hashed first). The key is a
job parameter, so both padded keys are computed once on the driver and enter
the plan as binary literals; the per-row work is two `sha2` calls.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens import rules

_BLOCK = 64


def padded_keys(secret: str) -> tuple[bytes, bytes]:
    key = secret.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\x00")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(secret: str, body: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of the binary column `body`."""
    ipad, opad = padded_keys(secret)
    inner = F.unhex(F.sha2(F.concat(F.lit(ipad), body), 256))
    return F.sha2(F.concat(F.lit(opad), inner), 256)


def signature_matches(secret: str, body: Column, header: Column, mode: str = "strict") -> Column:
    """Does `header` equal "sha256=" + HMAC(secret, body)?

    mode="strict": an empty or missing header is a mismatch.
    mode="skip_if_missing": an empty secret or header passes unchecked (the
    admission path of the webhook handler behaves this way).
    """
    expected = F.concat(F.lit(rules.SIGNATURE_PREFIX), hmac_sha256_hex(secret, body))
    present = header.isNotNull() & (header != "")
    ok = present & F.coalesce(header == expected, F.lit(False))  # a body that cannot be read matches nothing
    if mode == "strict":
        return ok
    if mode == "skip_if_missing":
        if not secret:
            return F.lit(True)
        return ~present | ok
    raise ValueError(f"unknown signature mode {mode!r}")
