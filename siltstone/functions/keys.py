"""Column functions on keys, values and records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a stored record besides key and value.
RECORD_OVERHEAD = 17


def entry_size(key_bytes: Column | int, value_bytes: Column | int) -> Column:
    """Estimated bytes of a record; a null value has none."""
    as_column = lambda x: F.lit(x) if isinstance(x, int) else x
    return (F.lit(RECORD_OVERHEAD) + as_column(key_bytes) + F.coalesce(as_column(value_bytes), F.lit(0))).cast("bigint")


def after_prefix(prefix: str | bytes) -> str | bytes | None:
    """The smallest key that is larger than every key with this prefix; None if there is none."""
    if isinstance(prefix, bytes):
        cut = prefix.rstrip(b"\xff")
        return cut[:-1] + bytes([cut[-1] + 1]) if cut else None
    for n in range(len(prefix), 0, -1):
        code = ord(prefix[n - 1]) + 1
        code = 0xE000 if 0xD800 <= code <= 0xDFFF else code
        if code <= 0x10FFFF:
            return prefix[: n - 1] + chr(code)
    return None


def encode_bytes(data: Column) -> Column:
    """A key or value as stored bytes: its length (4 bytes, big-endian) and itself. Null stays null."""
    data = data.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0")), data)


def decode_bytes(packed: Column) -> Column:
    """What ``encode_bytes`` packed; an error where the length is not that of the rest."""
    length = F.conv(F.hex(F.substring(packed, 1, 4)), 16, 10).cast("bigint")
    wrong = F.octet_length(packed) != length + 4
    return F.when(wrong, F.raise_error(F.lit("stored bytes do not have their length"))).otherwise(F.substr(packed, F.lit(5)))


def encode_value(op: Column, value: Column) -> Column:
    """An operation and its value: 1 byte (1 put, 2 delete) and ``encode_bytes`` of the value. A delete has length 0, and an error if it carries a value."""
    wrong = (op == "DELETE") & value.isNotNull()
    kind = F.when(wrong, F.raise_error(F.lit("a delete has no value")).cast("string")).when(op == "PUT", "01").when(op == "DELETE", "02")
    return F.concat(F.unhex(kind), encode_bytes(F.coalesce(value.cast("binary"), F.lit("").cast("binary"))))


def decode_value(packed: Column) -> Column:
    """(op, value) of ``encode_value``; a delete's value is null."""
    is_put = F.hex(F.substring(packed, 1, 1)) == "01"
    value = decode_bytes(F.substr(packed, F.lit(2)))
    return F.struct(F.when(is_put, "PUT").otherwise("DELETE").alias("op"), F.when(is_put, value).alias("value"))


def bloom_positions(key: Column, bits: int, hashes: int) -> Column:
    """Bit positions of a key by double hashing of the first two 32-bit words of its MD5."""
    digest = F.md5(key.cast("string").cast("binary"))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    return F.array(*[F.pmod(word(1) + i * word(9), F.lit(bits)) for i in range(hashes)])


def bloom_size(n: int, fpp: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hash functions for n keys and a false-positive rate."""
    from math import ceil, log

    bits = max(64, ceil(-n * log(fpp) / log(2) ** 2))
    bits = (bits + 63) // 64 * 64
    return bits, max(1, round(bits / max(1, n) * log(2)))


def bloom_fpr(n: Column, bits: int, hashes: int) -> Column:
    """Expected share of absent keys that a filter with n keys lets through."""
    return F.pow(1 - F.exp(-hashes * n / F.lit(float(bits))), F.lit(hashes))


def in_range(key: Column, start=None, end=None) -> Column:
    """start <= key < end; None leaves a side open."""
    sides = ([key >= F.lit(start)] if start is not None else []) + ([key < F.lit(end)] if end is not None else [])
    return reduce(lambda a, b: a & b, sides, F.lit(True))
