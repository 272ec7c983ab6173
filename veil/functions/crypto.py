"""Encryption of stored values and keyed hashes for lookup. Keys are 32 bytes and never default."""

import base64
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX, VERSION = "ENC1:", 1
#: Domain of the blind index. A fixed value.
DOMAIN = b"pii-vault-blind-index-v1"


def load_key(text: str | None) -> bytes:
    """A base64 key of exactly 32 bytes; anything else is refused."""
    try:
        key = base64.b64decode(text or "", validate=True)
    except ValueError as e:
        raise ValueError("the key is not base64") from e
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    return key


def _plain64(binary: Column) -> Column:
    return F.regexp_replace(F.base64(binary), r"[\r\n]", "")


def encrypt(value: Column, key: bytes, key_id: int = 1) -> Column:
    """AES-256-GCM with a fresh nonce: prefix and base64 of version, key number, nonce, text and tag."""
    head = struct.pack(">BI", VERSION, key_id)
    sealed = F.aes_encrypt(value.cast("binary"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"))
    return F.concat(F.lit(PREFIX), _plain64(F.concat(F.lit(bytearray(head)), sealed)))


def is_encrypted(value: Column) -> Column:
    return F.startswith(value, F.lit(PREFIX))


def decrypt(value: Column, key: bytes, strict: bool = False) -> Column:
    """The plain value; null for a wrong key, damage or another version.

    A value without the prefix is served as it is, or is null if ``strict``.
    """
    raw = F.try_to_binary(F.substring(value, len(PREFIX) + 1, 1 << 30), F.lit("base64"))
    good = F.hex(F.substring(raw, 1, 1)) == f"{VERSION:02X}"
    opened = F.try_aes_decrypt(F.substring(raw, 6, 1 << 30), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"))
    plain = F.lit(None).cast("string") if strict else value
    return F.when(is_encrypted(value), F.when(good, opened.cast("string"))).otherwise(plain)


def framed(*fields: Column) -> Column:
    """Fields, each behind its length in bytes, so that no two lists of fields are one string of bytes."""
    out = [F.lit(bytearray(DOMAIN))]
    for f in fields:
        data = f.cast("binary")
        out += [F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0")), data]
    return F.concat(*out)


def blind_index(key: bytes, *fields: Column) -> Column:
    """HMAC-SHA256 of the framed fields; the padded keys are constants of the plan."""
    block = key.ljust(64, b"\0") if len(key) <= 64 else None
    if block is None:
        raise ValueError("the key must have at most 64 bytes")
    inner, outer = (F.lit(bytearray(b ^ x for b in block)) for x in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, framed(*fields)), 256))
    return F.unhex(F.sha2(F.concat(outer, digest), 256))
