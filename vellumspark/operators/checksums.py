"""Checksums of payloads that lie in pieces: each piece is summed where it is, and the sums are merged by plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The modulus of Adler-32, the polynomial of CRC-32 with the lowest power in the highest bit.
ADLER, POLYNOMIAL = 65521, 0xEDB88320
#: Bits of a payload's length.
LENGTH_BITS = 40


def times(a: int, b: int) -> int:
    """The product of two polynomials over bits, modulo POLYNOMIAL; x to the 0 is the highest bit."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def power(n: int) -> int:
    """x to the n, which repeats every 2 ** 32 - 1, so that negative powers are powers too."""
    n %= 2**32 - 1
    out, square = 1 << 31, 1 << 30
    while n:
        if n & 1:
            out = times(out, square)
        square = times(square, square)
        n >>= 1
    return out


def moved(crc: Column, by: Column, backwards: bool = False) -> Column:
    """A CRC times x to the 8 `by`: what it adds to the CRC of a payload that goes on for so many bytes. backwards: x to the minus 8 `by`."""
    consts = F.array(*[F.array(*[F.lit(m).cast("long") for m in _multiples(power((-8 if backwards else 8) << j))]) for j in range(LENGTH_BITS)])
    step = lambda c, j: F.when(F.call_function("shiftright", by, j).bitwiseAND(F.lit(1)) == 1, _sum(F.get(consts, j), c)).otherwise(c)
    return F.aggregate(F.sequence(F.lit(0), F.lit(LENGTH_BITS - 1)), crc.cast("long"), lambda c, j: step(c, j))


def _multiples(b: int) -> list[int]:
    out = [b]
    for _ in range(31):
        out.append(out[-1] >> 1 ^ (POLYNOMIAL if out[-1] & 1 else 0))
    return out


def _sum(multiples: Column, a: Column) -> Column:
    """Of a constant's multiples those that a's bits name, added."""
    bit = lambda k: F.call_function("shiftright", a, F.lit(31) - k).bitwiseAND(F.lit(1))
    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, k: F.when(bit(k) == 1, s.bitwiseXOR(F.get(multiples, k))).otherwise(s))


def bytes_of(data: Column) -> Column:
    """A binary's bytes as numbers."""
    return F.when(F.octet_length(data) > 0, F.transform(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: F.ascii(c).cast("long"))).otherwise(F.array().cast("array<long>"))


def checksums(pieces: DataFrame, group: Sequence[str], offset: str, data: str) -> DataFrame:
    """The group's columns, size, adler32 and crc32 of payloads whose pieces (offset long, data binary) come in any order and from anywhere.

    Each piece gives the sum of its bytes and of its running sums, and its CRC moved back by the place where it ends; both
    checksums are then functions of sums and of one exclusive or. No window and no order: partial sums merge on the map side, so a payload
    of any size is many tasks. Pieces must not overlap or leave gaps; an empty payload is an empty piece. Null data counts as empty.
    """
    raw = F.coalesce(F.col(data), F.lit(b""))
    zero = F.lit(0).cast("long")
    sums = F.aggregate(bytes_of(raw), F.struct(zero.alias("s"), zero.alias("r")), lambda t, d: F.struct((t["s"] + d).alias("s"), (t["r"] + t["s"] + d).alias("r")))
    n = F.octet_length(raw).cast("long")
    each = pieces.select(*group, n.alias("n"), (F.col(offset) + n).alias("end"), F.crc32(raw).alias("crc"), sums.alias("t"))
    wide = lambda c: c.cast("decimal(38,0)")
    each = each.select(*group, "n", moved(F.col("crc"), F.col("end"), backwards=True).alias("crc"), F.col("t.s").alias("s"), F.col("t.r").alias("r"), (wide(F.col("t.s")) * wide(F.col("end"))).alias("w"))
    total = each.groupBy(*group).agg(F.sum("n").alias("size"), F.expr("bit_xor(crc)").alias("crc"), F.sum(wide(F.col("s"))).alias("s"), F.sum(wide(F.col("r"))).alias("r"), F.sum("w").alias("w"))
    # running sums of later pieces hold the sums of earlier ones once for each of their bytes
    low = (F.col("s") + 1) % ADLER
    high = (F.col("r") + F.col("s") * F.col("size") - F.col("w") + F.col("size")) % ADLER
    return total.select(*group, "size", (high.cast("long") * 65536 + low.cast("long")).alias("adler32"), moved(F.col("crc"), F.col("size")).alias("crc32"))
