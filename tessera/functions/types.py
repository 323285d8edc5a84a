"""Element types of typed buffers and their arithmetic as Spark columns.

Buffers hold machine numbers: integers wrap and divide towards zero, floats follow
IEEE 754.  Spark's ANSI mode raises instead, so these helpers state the machine rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ElementType:
    name: str
    spark: str
    bits: int
    signed: bool = True
    floating: bool = False

    @property
    def width(self) -> int:
        return self.bits // 8


#: Unsigned types are held one step wider; 64-bit unsigned as a decimal.
TYPES = {
    t.name: t
    for t in (
        ElementType("int8", "tinyint", 8), ElementType("int16", "smallint", 16), ElementType("int32", "int", 32), ElementType("int64", "bigint", 64),
        ElementType("uint8", "smallint", 8, False), ElementType("uint16", "int", 16, False), ElementType("uint32", "bigint", 32, False), ElementType("uint64", "decimal(20,0)", 64, False),
        ElementType("float", "float", 32, True, True), ElementType("double", "double", 64, True, True),
    )
}
ALIASES = {"char": "int8", "short": "int16", "int": "int32", "long": "int64", "size_t": "uint64", "unsigned long": "uint64"}


def element(name: str) -> ElementType:
    return TYPES[ALIASES.get(name, name)]


def byte_width(col: Column) -> Column:
    """Bytes of the scalar type that ``col`` names; null for an unknown name."""
    found = F.lit(None).cast("int")
    for name in [*TYPES, *ALIASES]:
        found = F.when(col == name, element(name).width).otherwise(found)
    return found


def wrapped(col: Column, kind: ElementType) -> Column:
    """A whole number reduced to the range of ``kind``, as two's complement does."""
    if kind.floating:
        return col.cast(kind.spark)
    number = (lambda x: F.expr(f"cast('{x}' as decimal(38,0))")) if kind.bits == 64 else F.lit
    low = (1 << (kind.bits - 1)) if kind.signed else 0
    value = col.cast("decimal(38,0)") if kind.bits == 64 else col
    size = number(1 << kind.bits)
    # the first pmod leaves room for adding, at both ends of the column's type
    return (F.pmod(F.pmod(value, size) + number(low), size) - number(low)).cast(kind.spark)


def wrapped_product(kind: ElementType, first: Column, *others: Column) -> Column:
    """The product of whole numbers in the range of ``kind``, wrapped after each factor.

    Signed factors of b bits have a product of 2 b - 1: a long holds it up to 32 bits, a
    decimal of 38 digits at 64, so factors of any size raise no overflow.
    """
    signed = element(f"int{max(kind.bits, 32)}")
    step = lambda c: wrapped(c, signed).cast("decimal(38,0)" if signed.bits == 64 else "long")
    total = step(first)
    for factor in others:
        total = step(total * step(factor))
    return wrapped(total, kind)


def divided(a: Column, b: Column, kind: ElementType) -> Column:
    """Truncating division for integers (null by zero), IEEE division for floats."""
    if not kind.floating:
        return F.when(b != 0, F.expr("1") * (a - F.when(b != 0, a % b)) / F.when(b != 0, b)).cast(kind.spark)
    inf = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b == 0, inf).otherwise(a / F.when(b != 0, b)).cast(kind.spark)
