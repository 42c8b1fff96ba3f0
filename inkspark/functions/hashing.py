"""Canonical records, salted hashes, keyed hashes and Merkle nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(x: Column) -> Column:
    """A string as JSON text; characters beyond ASCII are escaped by their UTF-16 units."""
    out = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, safe in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    code = lambda c: F.lower(F.hex(F.encode(c, "UTF-16BE")))
    units = lambda c: F.regexp_replace(code(c), "([0-9a-f]{4})", r"\\u$1")
    plain = out.rlike(r"^[\x20-\x7e]*$")
    wide = F.array_join(F.transform(F.split(out, ""), lambda c: F.when(c.rlike(r"^[\x20-\x7e]*$"), c).otherwise(units(c))), "")
    return F.concat(F.lit('"'), F.when(plain, out).otherwise(wide), F.lit('"'))


def canonical(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys and no spaces. Values are JSON already."""
    parts: list[Column] = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "{") + f'"{key}":'), fields[key]]
    return F.concat(*parts, F.lit("}"))


def record_hash(salt_hex: Column, record: Column) -> Column:
    """SHA-256 of the salt's bytes and the record."""
    return F.sha2(F.concat(F.unhex(salt_hex), F.encode(record, "UTF-8")), 256)


def leaf_hash(digest: Column) -> Column:
    """SHA-256 of a zero byte and a digest's bytes."""
    return F.sha2(F.unhex(F.concat(F.lit("00"), digest)), 256)


def node_hash(left: Column, right: Column) -> Column:
    """SHA-256 of a one byte and two nodes' bytes."""
    return F.sha2(F.unhex(F.concat(F.lit("01"), left, right)), 256)


def digest_or_null(text: Column) -> Column:
    """64 hexadecimal digits, else null."""
    return F.when(text.rlike("^[0-9a-f]{64}$"), text)


def keyed_hash(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a message."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    within = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.unhex(F.concat(F.lit(outer), within)), 256)
