"""Encoding of values by a key, as columns: AES in GCM mode, which also detects changes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_of(secret: str) -> bytes:
    """A 256-bit key from any secret text."""
    return hashlib.sha256(secret.encode()).digest()


def encode(value: Column, secret: str) -> Column:
    """Base-64 text; each call draws a new initialisation vector, so equal values look different."""
    return F.base64(F.aes_encrypt(value.cast("binary"), F.lit(key_of(secret)), F.lit("GCM")))


def decode(text: Column, secret: str) -> Column:
    """The value, or null if the text was changed or made with another key."""
    return F.try_aes_decrypt(F.unbase64(text), F.lit(key_of(secret)), F.lit("GCM")).cast("string")
