"""Search, paging, browsing and constants of cryptographic algorithms."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Matches that a search returns at most.
MOST = 5000


@dataclass(frozen=True)
class Query:
    """/re/ is a case-sensitive regular expression; else by the options: a regular expression, a substring, all of several
    words, or a substring without regard to case."""

    text: str
    use_regex: bool = False
    case_sensitive: bool = False
    fuzzy: bool = False

    def matches(self, column: Column) -> Column:
        if not self.text:
            return F.lit(False)
        if len(self.text) > 2 and self.text.startswith("/") and self.text.endswith("/"):
            return column.rlike(self.text[1:-1])
        if self.use_regex:
            return column.rlike(self.text if self.case_sensitive else f"(?i){self.text}")
        if self.case_sensitive:
            return column.contains(self.text)
        lower = F.lower(column)
        if self.fuzzy and len(self.text.split()) > 1:
            out = F.lit(True)
            for word in self.text.lower().split():
                out = out & lower.contains(word)
            return out
        return lower.contains(self.text.lower())


def search(lines: DataFrame, query: Query, consumed: DataFrame | None = None, annotation_text: DataFrame | None = None) -> DataFrame:
    """seq of the lines whose text, or whose annotation's text, matches; lines that an annotation consumed are left out.
    annotation_text: seq, text."""
    d = lines if consumed is None else lines.join(consumed.select("seq"), "seq", "left_anti")
    if annotation_text is None:
        return d.where(query.matches(F.col("raw"))).select("seq")
    d = d.join(annotation_text.select("seq", F.col("text").alias("_note")), "seq", "left")
    return d.where(query.matches(F.col("raw")) | F.coalesce(query.matches(F.col("_note")), F.lit(False))).select("seq")


def first_matches(found: DataFrame, most: int = MOST) -> tuple[DataFrame, int, bool]:
    """The first matches by seq, the true total, and whether some are left out."""
    total = found.count()
    return found.orderBy("seq").limit(most), total, total > most


def in_ranges(found: DataFrame, lines: DataFrame | None = None, seqs: tuple[int, int] | None = None, offsets: tuple[int, int] | None = None) -> DataFrame:
    """Ranges are applied before any limit. lines: seq, insn_offset."""
    out = found if seqs is None else found.where(F.col("seq").between(*seqs))
    if offsets is not None and lines is not None:
        out = out.join(lines.where(F.col("insn_offset").between(*offsets)).select("seq"), "seq", "left_semi")
    return out


def parse_range(text: str, base: int = 10) -> tuple[int, int]:
    a, _, b = text.partition("-")
    low, high = int(a, base), int(b, base)
    if low > high:
        raise ValueError(f"range ends before it begins: {text}")
    return low, high


def page(ordered: DataFrame, order: list[str], offset: int, count: int) -> DataFrame:
    return ordered.orderBy(*order).offset(offset).limit(count)


def goto(text: str) -> tuple[str, int]:
    """Decimal: a line, from 1. 0x or digits with a letter: an address."""
    t = text.strip().lower()
    if re.fullmatch(r"\d+", t):
        return "seq", int(t) - 1
    if re.fullmatch(r"(0x)?[0-9a-f]+", t):
        return "address", int(t, 16)
    raise ValueError(f"neither a line nor an address: {text!r}")


def nearest(found: DataFrame, seq: int) -> DataFrame:
    """position, seq of the match nearest to a line; of two the earlier. found has a row for each match."""
    at = F.col("seq") <= seq
    near = found.agg(F.max(F.when(at, F.col("seq"))).alias("low"), F.count(F.when(at, 1)).alias("n"), F.min(F.when(~at, F.col("seq"))).alias("high"))
    low = F.col("high").isNull() | (F.lit(seq) - F.col("low") <= F.col("high") - seq)
    near = near.where("low IS NOT NULL OR high IS NOT NULL").withColumn("_low", F.coalesce(low, F.lit(False)))
    return near.select(F.when(F.col("_low"), F.col("n") - 1).otherwise(F.col("n")).alias("position"), F.when(F.col("_low"), F.col("low")).otherwise(F.col("high")).alias("seq"))


def lines_by_seq(lines: DataFrame, shown: DataFrame, wanted: list[int], notes: DataFrame | None = None) -> DataFrame:
    """position, seq, disasm, raw (and note) for a list of lines in its order: the text itself for a special line, a
    placeholder for one that the trace lacks."""
    spark = lines.sparkSession
    ask = spark.createDataFrame([(k, s) for k, s in enumerate(wanted)], "position int, seq long")
    own = ask.join(lines.where(F.col("seq").isin(wanted)), "seq", "left").join(shown.where(F.col("seq").isin(wanted)).select("seq", F.col("disasm").alias("_d")), "seq", "left")
    own = own.select("position", "seq", F.coalesce("_d", "raw", F.concat(F.lit("(line "), F.col("seq") + 1, F.lit(" unparseable)"))).alias("disasm"), "raw")
    return (own if notes is None else own.join(notes, "seq", "left")).orderBy("position")


def even_sample(lines: DataFrame, total: int, k: int) -> DataFrame:
    """k lines spread evenly over the trace: round(i * total / k)."""
    picks = lines.sparkSession.range(k).select(F.least(F.round(F.col("id") * total / k), F.lit(total - 1)).cast("long").alias("seq")).distinct()
    return lines.join(picks, "seq", "left_semi")


def runs(seqs: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """first, last, n: runs of consecutive lines. Buckets of lines are gone through apart; only runs that touch a bucket's
    edge, two a bucket at most, are joined in one task."""
    d = seqs.select("seq").distinct().withColumn("_b", F.floor(F.col("seq") / bucket))
    d = d.withColumn("_i", F.col("seq") - F.row_number().over(W.partitionBy("_b").orderBy("seq")))
    parts = d.groupBy("_b", "_i").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    touches = (F.pmod("first", F.lit(bucket)) == 0) | (F.pmod(F.col("last") + 1, F.lit(bucket)) == 0)
    order = W.partitionBy(F.lit(1)).orderBy("first")
    edge = parts.where(touches).withColumn("_g", F.sum(F.when(F.col("first") - 1 == F.lag("last").over(order), 0).otherwise(1)).over(order))
    edge = edge.groupBy("_g").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last")
    return parts.where(~touches).select("first", "last").unionByName(edge).withColumn("n", F.col("last") - F.col("first") + 1)


#: 32-bit constants by which an algorithm is known, from its public standard.
CONSTANTS: dict[str, tuple[int, ...]] = {
    "MD5": (0xD76AA478, 0xE8C7B756, 0x242070DB, 0xC1BDCEEE),
    "SHA-1": (0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xCA62C1D6),
    "MD5/SHA-1 initial value": (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476),
    "SHA-224": (0xC1059ED8, 0x367CD507, 0x3070DD17, 0xF70E5939),
    "SHA-256": (0x428A2F98, 0x71374491, 0xB5C0FBCF, 0x6A09E667, 0xBB67AE85, 0x3C6EF372),
    "SHA-384": (0xCBBB9D5D, 0x629A292A, 0x9159015A),
    "SHA-512": (0xF3BCC908, 0x84CAA73B, 0xFE94F82B, 0xD728AE22),
    "SM3": (0x7380166F, 0x4914B2B9, 0x172442D7, 0x79CC4519, 0x7A879D8A),
    "SM4": (0xA3B1BAC6, 0x56AA3350, 0x677D9197, 0xB27022DC),
    "AES": (0xC66363A5, 0xF87C7C84, 0xEE777799, 0x51F4A750),
    "DES": (0x02080800, 0x00080000, 0x02000002),
    "Blowfish": (0x243F6A88, 0x85A308D3, 0x13198A2E),
    "ChaCha/Salsa": (0x61707865, 0x3320646E, 0x79622D32, 0x6B206574),
    "TEA": (0x9E3779B9, 0xC6EF3720),
    "RC5": (0xB7E15163,),
    "RC6": (0xB7E15163, 0x9E3779B9),
    "CRC-32": (0xEDB88320, 0x04C11DB7, 0x77073096, 0xEE0E612C),
    "CRC-32C": (0x82F63B78, 0x1EDC6F41),
    "Adler-32": (0x0000FFF1,),
    "FNV-1": (0x811C9DC5, 0x01000193),
    "MurmurHash3": (0xCC9E2D51, 0x1B873593, 0x85EBCA6B, 0xC2B2AE35),
    "xxHash": (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1),
    "SipHash": (0x736F6D65, 0x646F7261, 0x6C796765, 0x74656462),
    "BLAKE2b": (0xF3BCC908, 0x6A09E667),
    "RIPEMD-160": (0x50A28BE6, 0x5C4DD124, 0x6D703EF3, 0x7A6D76E9),
    "Whirlpool": (0x18186018, 0x23238C23),
    "Twofish": (0xBCBC3275, 0xECEC21F3),
}


def constant_scan(lines: DataFrame, constants: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    """seq, algorithm, magic_hex: the first constant by the table's order that a line's text holds as a hexadecimal number.

    The number is the constant, after zeros or none, or a 64-bit one whose upper half it is; a longer number that only
    begins with a constant's digits is none. One alternation finds all; of them the first of the table is taken."""
    table = [(name, f"{v:x}") for name, vs in (constants or CONSTANTS).items() for v in vs]
    first: dict[str, int] = {}
    for k, (_, h) in enumerate(table):
        first.setdefault(h, k)
    whole, upper = "(?![0-9a-f])", "(?=(?:[0-9a-f]{8})?(?![0-9a-f]))"
    any_ = "|".join(h + (upper if len(h) == 8 else whole) for h in first)
    text, pattern = F.lower("raw"), f"(?<![0-9a-z])0x0*({any_})"
    order = F.create_map(*[F.lit(x) for item in first.items() for x in item])
    at = F.array_min(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda h: F.element_at(order, h)))
    names, digits = F.array(*[F.lit(n) for n, _ in table]), F.array(*[F.lit(f"0x{h}") for _, h in table])
    found = lines.where(text.rlike(pattern)).select("seq", at.alias("_at"))
    return found.select("seq", F.get(names, F.col("_at")).alias("algorithm"), F.get(digits, F.col("_at")).alias("magic_hex"))


def algorithms(matches: DataFrame) -> DataFrame:
    """algorithm, first_seq, n."""
    return matches.groupBy("algorithm").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))


def unknown_mnemonics(insn: DataFrame) -> DataFrame:
    return insn.where("NOT known").groupBy("mnemonic").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))
