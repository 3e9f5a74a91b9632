"""HMAC and AES-GCM built from Spark's own digest and cipher functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pads(key: bytes) -> tuple[bytes, bytes]:
    import hashlib

    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sign(payload: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a string or binary payload."""
    inner, outer = _pads(key)
    body = F.concat(F.lit(bytearray(inner)), payload.cast("binary"))
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(body, 256))), 256)


def hmac_verify(payload: Column, signature: Column, key: bytes) -> Column:
    """False for a missing signature."""
    return F.coalesce(hmac_sign(payload, key) == signature, F.lit(False))


def aes_gcm_seal(text: Column, key: bytes) -> Column:
    """Base64 of nonce and cipher text."""
    return F.base64(F.aes_encrypt(text.cast("binary"), F.lit(bytearray(key)), F.lit("GCM")))


def aes_gcm_open(sealed: Column, key: bytes) -> Column:
    """Plain text, null when the payload or the key is wrong."""
    raw = F.try_to_binary(sealed, F.lit("base64"))
    return F.try_aes_decrypt(raw, F.lit(bytearray(key)), F.lit("GCM")).cast("string")


def decode_payload(text: Column) -> Column:
    """Bytes of a base64 text after an optional data-URI header; null when invalid."""
    parts = F.split(text, ",")
    body = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(text)
    return F.try_to_binary(body, F.lit("base64"))
