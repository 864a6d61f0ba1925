"""Exact unsigned 64-bit arithmetic, hashes and checksums as built-in column expressions.

Spark has no unsigned type and its ANSI mode rejects wrapping products, so a 64-bit value is held as two 32-bit limbs
while it is computed and as the bit pattern of a long afterwards. ``unsigned`` gives the order of such patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

LOW = 0xFFFFFFFF
MIX = 0xD6E8FEB86659FD93
OFFSET = 0xCBF29CE484222325


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def bytes_of(value: Column) -> Column:
    """The bytes of a binary or string column as an array of longs, in time linear in their number."""
    letters = F.split(F.decode(value.cast("binary"), "ISO-8859-1"), "")
    return F.when(F.octet_length(value) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(letters, lambda c: F.ascii(c).cast("long")))


def _table(poly: int) -> list[int]:
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (poly if b & 1 else 0)
        out.append(b)
    return out


CASTAGNOLI = _table(0x82F63B78)


def crc32c(value: Column) -> Column:
    """CRC-32C (Castagnoli) as a long; Spark's own ``crc32`` has another polynomial."""
    table = F.array(*(F.lit(x).cast("long") for x in CASTAGNOLI))
    step = lambda c, b: F.get(table, c.bitwiseXOR(b).bitwiseAND(255).cast("int")).bitwiseXOR(F.shiftright(c, 8))
    return F.aggregate(bytes_of(value), F.lit(LOW).cast("long"), step, lambda c: c.bitwiseXOR(LOW))


def _limbs(hi: Column, lo: Column) -> Column:
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def _product_low(x: Column, c: int) -> Column:
    """The low 32 bits of a 32-bit value times a 32-bit constant."""
    high = F.shiftleft(((F.shiftright(x, 16)) * c).bitwiseAND(0xFFFF), 16)
    return (x.bitwiseAND(0xFFFF) * c + high).bitwiseAND(LOW)


def _times(x: Column, constant: int) -> Column:
    """Limbs times a 64-bit constant, modulo 2^64."""
    c_hi, c_lo = constant >> 32, constant & LOW
    t0, t1 = x["lo"].bitwiseAND(0xFFFF) * c_lo, F.shiftright(x["lo"], 16) * c_lo
    low = t0 + F.shiftleft(t1.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(low, 32) + F.shiftright(t1, 16)
    return _limbs((carry + _product_low(x["hi"], c_lo) + _product_low(x["lo"], c_hi)).bitwiseAND(LOW), low.bitwiseAND(LOW))


def _fnv(value: Column) -> Column:
    def step(x: Column, b: Column) -> Column:
        # The prime is 2^40 + 435.
        lo = x["lo"].bitwiseXOR(b)
        p = lo * 435
        return _limbs((x["hi"] * 435 + F.shiftright(p, 32) + F.shiftleft(lo, 8)).bitwiseAND(LOW), p.bitwiseAND(LOW))

    return F.aggregate(bytes_of(value), _limbs(F.lit(OFFSET >> 32).cast("long"), F.lit(OFFSET & LOW).cast("long")), step)


def _pattern(x: Column) -> Column:
    return F.shiftleft(x["hi"], 32).bitwiseOR(x["lo"])


def fnv1a64(value: Column) -> Column:
    return let(_fnv(value), _pattern)


def ring_hash(value: Column) -> Column:
    """FNV-1a with a finishing mix: fold the high half in, multiply, fold again."""
    fold = lambda x: _limbs(x["hi"], x["lo"].bitwiseXOR(x["hi"]))
    return let(let(let(_fnv(value), fold), lambda x: _times(x, MIX)), lambda x: _pattern(fold(x)))


def unsigned(pattern: Column) -> Column:
    """A long whose signed order is the unsigned order of the patterns."""
    return pattern.bitwiseXOR(F.lit(-(1 << 63)))


def modulo(pattern: Column, n: int) -> Column:
    """The unsigned remainder by a small ``n``."""
    hi, lo = F.shiftrightunsigned(pattern, 32), pattern.bitwiseAND(LOW)
    return ((hi % n) * ((1 << 32) % n) + lo) % n


def times_plus(x: Column, factor: int, plus: int) -> Column:
    """x * factor + plus modulo 2^64 as a pattern, for x from 0 to 2^63 - 1."""
    start = let(_limbs(F.shiftright(x, 32), x.bitwiseAND(LOW)), lambda v: _times(v, factor))

    def add(v: Column) -> Column:
        low = v["lo"] + (plus & LOW)
        return _pattern(_limbs((v["hi"] + (plus >> 32) + F.shiftright(low, 32)).bitwiseAND(LOW), low.bitwiseAND(LOW)))

    return let(start, add)


def big_endian(value: Column) -> Column:
    """Eight bytes as a pattern."""
    return F.conv(F.hex(value), 16, -10).cast("long")


def to_big_endian(pattern: Column) -> Column:
    """The eight bytes of a pattern."""
    return F.unhex(F.lpad(F.hex(pattern), 16, "0"))
