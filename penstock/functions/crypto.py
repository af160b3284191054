"""AES-256-GCM over whole columns: hex text of cipher and tag, and of the 12-byte IV."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IV_HEX_DIGITS = 24


def random_iv() -> Column:
    """A fresh IV per row. Marked non-deterministic by `uuid()`, so one column holds one value."""
    return F.substring(F.sha2(F.concat(F.uuid(), F.uuid()), 256), 1, IV_HEX_DIGITS)


def encrypt(plain: Column, key_hex: Column, iv_hex: Column) -> Column:
    sealed = F.aes_encrypt(plain, F.unhex(key_hex), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(iv_hex))
    return F.substring(F.lower(F.hex(sealed)), IV_HEX_DIGITS + 1, 2**31 - 1)


def try_decrypt(encrypted: Column, key_hex: Column, iv_hex: Column) -> Column:
    """Plain text, or NULL where the text was tampered with or the IV is not its own."""
    sealed = F.unhex(F.concat(iv_hex, encrypted))
    return F.try_aes_decrypt(sealed, F.unhex(key_hex), F.lit("GCM")).cast("string")
