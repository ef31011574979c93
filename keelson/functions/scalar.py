"""Scalar functions as column expressions: key folding, hashes, buckets, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a 64-bit offset basis and prime.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 1099511628211

#: The ten syllables of generated last names, by digit.
SYLLABLES = ("BAR", "OUGHT", "ABLE", "PRI", "PRES", "ESE", "ANTI", "CALLY", "ATION", "EING")

MASK64 = "18446744073709551616"


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside one expression, however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def folded_int(c: Column) -> Column:
    """Signed 32-bit key as hexadecimal text whose byte order is the numeric order."""
    return F.lpad(F.hex(c.cast("bigint") + 2147483648), 8, "0")


def unfolded_int(c: Column) -> Column:
    return (F.conv(c, 16, 10).cast("bigint") - 2147483648).cast("int")


def folded_text(c: Column) -> Column:
    """Text key with its end mark, so that shorter sorts before longer."""
    return F.concat(c, F.lit("\0"))


def fnv1a_steps(data: Column) -> Column:
    """FNV-1a over an array of byte values, as an unsigned DECIMAL(20,0).

    The product is taken in two 32-bit halves, exact in DECIMAL, so it holds under ANSI
    rules too."""

    def step(h: Column, b: Column) -> Column:
        # Only the low byte is touched by XOR.
        low = F.pmod(h, F.lit(256).cast("decimal(20,0)")).cast("int")
        mixed = h - low + low.bitwiseXOR(b).cast("decimal(20,0)")
        hi = F.floor(mixed / F.lit(4294967296).cast("decimal(20,0)")).cast("decimal(20,0)")
        lo = (mixed - (hi * F.lit(4294967296).cast("decimal(11,0)")).cast("decimal(20,0)")).cast("decimal(20,0)")
        # prime = 2^40 + 435; high half only matters modulo 2^32.
        lo_part = (lo.cast("decimal(10,0)") * F.lit(435).cast("decimal(3,0)")).cast("decimal(20,0)")
        hi_part = (hi.cast("decimal(10,0)") * F.lit(435).cast("decimal(3,0)") + lo.cast("decimal(10,0)") * F.lit(256).cast("decimal(3,0)")).cast("decimal(20,0)")
        hi_mod = F.pmod(hi_part, F.lit(4294967296).cast("decimal(20,0)")).cast("decimal(10,0)")
        total = (hi_mod * F.lit(4294967296).cast("decimal(10,0)")).cast("decimal(21,0)") + lo_part.cast("decimal(21,0)")
        return F.pmod(total, F.expr(f"CAST({MASK64} AS DECIMAL(21,0))")).cast("decimal(20,0)")

    return F.aggregate(data, F.expr(f"CAST({FNV_OFFSET} AS DECIMAL(20,0))"), step)


def fnv1a_long(c: Column) -> Column:
    """FNV-1a of the eight little-endian bytes of a non-negative BIGINT."""
    return fnv1a_steps(F.array(*(F.shiftright(c, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(8))))


def fnv1a_text(c: Column) -> Column:
    """FNV-1a of the bytes of a text."""
    code = F.hex(F.encode(c, "UTF-8"))
    data = F.transform(F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)), lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int"))
    return fnv1a_steps(F.when(F.length(code) == 0, F.expr("CAST(array() AS ARRAY<INT>)")).otherwise(data))


def log2_bucket(c: Column, top: int = 15) -> Column:
    """floor(log2(c)) of a positive integer, exact, clamped to ``top``."""
    return F.least(F.length(F.conv(c.cast("string"), 10, 2)) - 1, F.lit(top))


def last_name(n: Column) -> Column:
    """Last name of the three digits of n."""
    syllables = F.array(*(F.lit(s) for s in SYLLABLES))
    digit = lambda d: F.element_at(syllables, (F.pmod(F.floor(n / d), F.lit(10)) + 1).cast("int"))
    return F.concat(digit(100), digit(10), digit(1))


def nurand(a: int, lo: int, hi: int, c: int, u1: Column, u2: Column) -> Column:
    """Non-uniform random number from two uniform ones: u1 in [0, a], u2 in [lo, hi]."""
    return F.pmod(u1.bitwiseOR(u2) + c, F.lit(hi - lo + 1)) + lo


def random_text(seed: Column, n: Column, alphabet: str) -> Column:
    """``n`` characters chosen by hash of the seed and the place."""
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(seed, i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))), "")


def zip_code(n: Column) -> Column:
    """Four digits and a fixed tail."""
    return F.concat(F.lpad(F.pmod(n, F.lit(10000)).cast("string"), 4, "0"), F.lit("11111"))


def credit_line(c_id, c_d_id, c_w_id, d_id, w_id, amount, when) -> Column:
    """One line of the bad-credit history; callers cut the whole to 500 characters."""
    return F.format_string("| %4d %2d %4d %2d %4d $%7.2f %d", c_id, c_d_id, c_w_id, d_id, w_id, amount, when)


def labelled_bucket(c: Column) -> Column:
    """Label of a power-of-two bucket, open at 16384."""
    b = log2_bucket(c, 14)
    low = F.pow(F.lit(2), b).cast("bigint")
    return F.when(c == 0, "0").when(c == 1, "1").when(b >= 14, ">=16384").otherwise(F.concat(low, F.lit("-"), low * 2 - 1))


def config_hash(names: list[str]) -> Column:
    """Hash of configuration values in name order."""
    return F.xxhash64(F.concat_ws("\x1f", *(F.col(n).cast("string") for n in sorted(names))))
