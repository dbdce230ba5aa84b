"""Bit votes of 64-bit hashes with SQL functions only.

A sum per bit would need 64 aggregates. Two bits fit one long: masking the
hash shifted by i with 0x0000000100000001 leaves bit i in the low half and
bit i + 32 in the high half, so 32 sums of longs count all 64 bits. A half
overflows at 2^31 weight, above the longest string Spark can hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HALVES = 0x0000000100000001


def vote_sums(hash_col: Column, weight: Column | None = None) -> list[Column]:
    """32 aggregates ``v0`` to ``v31``; a null hash does not vote."""
    out = []
    for i in range(32):
        bits = F.shiftrightunsigned(hash_col, i).bitwiseAND(F.lit(HALVES).cast("long"))
        out.append(F.sum(bits if weight is None else bits * weight).alias(f"v{i}"))
    return out


def majority(total: str) -> Column:
    """The long whose bit is 1 where the votes exceed half of ``total``
    (no votes: zero)."""
    low = F.lit(0xFFFFFFFF).cast("long")
    bits = []
    for i in range(32):
        v = F.coalesce(F.col(f"v{i}"), F.lit(0).cast("long"))
        t = F.coalesce(F.col(total).cast("long"), F.lit(0).cast("long"))
        bits.append(F.shiftleft((v.bitwiseAND(low) * 2 > t).cast("long"), i))
        bits.append(F.shiftleft((F.shiftrightunsigned(v, 32) * 2 > t).cast("long"), i + 32))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def hex16(c: Column) -> Column:
    """16 lowercase hexadecimal digits of a long."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))
