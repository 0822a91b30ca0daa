"""Register names and hexadecimal values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids: x0-x28 0-28, fp 29, lr 30, sp 31, xzr 32, low halves of v0-v31 33-64, nzcv 65, their high halves 66-97.
FP, LR, SP, XZR, V_LOW, NZCV, V_HIGH = 29, 30, 31, 32, 33, 65, 66
COUNT = 98


def reg_id(name: Column) -> Column:
    """The id of a register name, arrangement and case ignored; null for anything else (x31 and w31 included)."""
    n = F.lower(F.trim(F.substring_index(name, ".", 1)))
    number = F.regexp_extract(n, r"^[a-z]([0-9]{1,2})$", 1).try_cast("int")
    first = F.substring(n, 1, 1)
    return (
        F.when(first.isin("x", "w") & (number <= 30), number)
        .when(first.isin("b", "h", "s", "d", "q", "v") & (number <= 31), number + V_LOW)
        .when(n == "fp", FP).when(n == "lr", LR).when(n.isin("sp", "wsp"), SP).when(n.isin("xzr", "wzr"), XZR).when(n == "nzcv", NZCV)
        .cast("int")
    )


def reg_name(reg: Column) -> Column:
    """x0-x28, fp, lr, sp, xzr, v0-v31 (low), nzcv, v0.hi-v31.hi."""
    return (
        F.when(reg < FP, F.concat(F.lit("x"), reg)).when(reg == FP, "fp").when(reg == LR, "lr").when(reg == SP, "sp").when(reg == XZR, "xzr")
        .when(reg < NZCV, F.concat(F.lit("v"), reg - V_LOW)).when(reg == NZCV, "nzcv").otherwise(F.concat(F.lit("v"), reg - V_HIGH, F.lit(".hi")))
    )


def hex_long(digits: Column) -> Column:
    """The low 64 bits of hex digits as a signed long; null for none."""
    return F.when(F.length(digits) > 0, F.conv(F.substring(F.concat(F.lit("0" * 16), digits), -16, 16), 16, -10).cast("long"))


def hex_high(digits: Column) -> Column:
    """Bits 64 to 127 of hex digits."""
    return F.when(F.length(digits) > 0, F.conv(F.substring(F.concat(F.lit("0" * 32), digits), -32, 16), 16, -10).cast("long"))


def to_hex(value: Column, digits: int = 0) -> Column:
    """0x and lowercase digits, padded to `digits`."""
    h = F.lower(F.hex(value))
    return F.concat(F.lit("0x"), F.lpad(h, digits, "0") if digits else h)


def masked(value: Column, width: Column) -> Column:
    """The low `width` bytes of a long."""
    return F.when(width >= 8, value).otherwise(value.bitwiseAND(F.when(width == 1, F.lit(0xFF)).when(width == 2, F.lit(0xFFFF)).otherwise(F.lit(0xFFFFFFFF)).cast("long")))


def pairs(text: Column) -> Column:
    """array<struct<name, digits>> of all name=0xHEX in text, in order; names have two letters at least, lowercase first."""
    pattern = r"([a-z][A-Za-z0-9_]+)=0x([0-9a-fA-F]+)"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("digits"))


def digits_of(found: Column, *names: Column) -> Column:
    """Digits of the first of names that pairs() has."""

    def first(name: Column) -> Column:
        return F.get(F.filter(found, lambda p: p["name"] == name), F.lit(0))["digits"]

    tries = [first(n) for n in names]
    return F.coalesce(*tries)
