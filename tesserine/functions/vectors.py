"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays, 0 if either has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def hash_embedding(text: Column, size: int = 384) -> Column:
    """A deterministic unit vector of a text that needs no model: the bytes of SHA-384 digests, each of the one before, over 255."""
    digits = F.sha2(text.cast("binary"), 384)
    if size > 48:
        last = lambda acc: F.unhex(F.substring(acc, F.length(acc) - 95, F.lit(96)))
        digits = F.aggregate(F.sequence(F.lit(2), F.lit(-(-size // 48))), digits, lambda acc, _: F.concat(acc, F.sha2(last(acc), 384)))
    values = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(values, lambda x: x / length)).otherwise(values)


def name_uuid(text: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The version-5 UUID of a name: the same id for the same name everywhere."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), text.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
