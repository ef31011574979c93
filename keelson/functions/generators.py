"""Key generators as column expressions over uniform numbers."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.functions.scalar import MASK64, fnv1a_long, let

#: Fixed value: what a record id is crossed with before its slot is hashed.
SLOT_SALT = 0xDEADBEEFCAFE

#: The two factors of the finalizer.
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def zeta(n: int, theta: float, exact: int | None = None) -> float:
    """Generalized harmonic number; beyond ``exact`` terms the tail is an integral."""
    head = n if exact is None else min(n, exact)
    total = math.fsum(i**-theta for i in range(1, head + 1))
    if n > head:
        total += math.log(n / head) if abs(theta - 1) < 1e-9 else (n ** (1 - theta) - head ** (1 - theta)) / (1 - theta)
    return total


def zipf_rank(u: Column, n: int, theta: float) -> Column:
    """Rank in 1 .. n - 1 of a uniform number, by the usual closed-form inverse."""
    return 1 + _zipf(u, n - 1, theta, zeta(n - 1, theta), clamped=False)


def zipf_rank0(u: Column, n: int, theta: float, exact: int | None = None) -> Column:
    """Rank in 0 .. n - 1, 0 the hottest; with ``exact`` the sum over ranks is approximated beyond so many terms."""
    return _zipf(u, n, theta, zeta(n, theta, exact), clamped=True)


def _zipf(u: Column, n: int, theta: float, zn: float, clamped: bool) -> Column:
    eta = (1 - (2.0 / n) ** (1 - theta)) / (1 - zeta(2, theta) / zn)
    far = F.floor(n * F.pow(eta * u - eta + 1, F.lit(1 / (1 - theta))))
    far = F.least(far, F.lit(n - 1)) if clamped else far
    return F.when(u * zn < 1, F.lit(0)).when(u * zn < 1 + 0.5**theta, F.lit(1)).otherwise(far).cast("bigint")


class GrowingZipf:
    """Scrambled Zipf keys over a key space that grows: the sum over ranks is kept and only its new terms are added."""

    def __init__(self, n: int, theta: float):
        if n < 2:
            raise ValueError("a key space has two keys or more")
        self.n, self.theta, self.zeta = n, theta, zeta(n, theta)

    def grow_to(self, n: int) -> GrowingZipf:
        if n > self.n:
            self.zeta += math.fsum(i**-self.theta for i in range(self.n + 1, n + 1))
            self.n = n
        return self

    def rank(self, u: Column) -> Column:
        """Rank from 1 of a uniform number."""
        return 1 + _zipf(u, self.n, self.theta, self.zeta, clamped=False)

    def key(self, u: Column) -> Column:
        return scrambled(self.rank(u), self.n)


def scrambled(rank: Column, n: int) -> Column:
    """A rank's place in a key space of n, by hash."""
    return F.pmod(fnv1a_long(rank), F.lit(n).cast("decimal(20,0)")).cast("bigint")


def shard(key: Column, shards: int) -> Column:
    """Shard of a key by its hash."""
    return scrambled(key, shards)


def mixed(rank: Column, n: int) -> Column:
    """A rank's place in a key space of n, by the 64-bit finalizer of Murmur3."""
    z = rank.cast("decimal(20,0)")
    for factor in MIX:
        z = _bound(_crossed(z, 33), factor)
    return F.pmod(_crossed(z, 33), F.lit(n).cast("decimal(20,0)")).cast("bigint")


def next01(seed: Column) -> Column:
    """SplitMix64 as a uniform number in [0, 1]."""
    return splitmix64(seed).cast("double") / F.lit(float(2**64 - 1))


def placed(record: Column, pages: int, slots: int) -> tuple[Column, Column]:
    """(page_id, slot_id) of a record by two hashes."""
    return scrambled(record, pages).alias("page_id"), scrambled(record.bitwiseXOR(F.lit(SLOT_SALT)), slots).alias("slot_id")


def hot_set(percent: Column, share: int, hot_key: Column, other_key: Column) -> Column:
    """``hot_key`` for ``share`` of a hundred requests, else ``other_key``."""
    return F.when(percent < share, hot_key).otherwise(other_key)


def latest(size: Column, rank: Column) -> Column:
    """Key of a recency rank: 0 is the newest."""
    return size - 1 - rank


def other_than(own: Column, u: Column) -> Column:
    """Uniform over all ids but ``own``, from a uniform number over one id fewer."""
    return F.when(u >= own, u + 1).otherwise(u)


def perturbed(params: dict[str, float], bounds: dict[str, tuple[float, float, float]], seed: int, spread: float = 0.3) -> dict[str, float]:
    """A neighbour of a parameter setting: each value times a random factor, clamped to (least, most) and rounded to a step."""
    rng = random.Random(seed)
    out = {}
    for name in sorted(params):
        least, most, step = bounds[name]
        value = min(most, max(least, params[name] * (1 + rng.uniform(-spread, spread))))
        out[name] = min(most, max(least, round(value / step) * step))
    return out


def _times(z: Column, constant: int) -> Column:
    """Product modulo 2^64 of an unsigned DECIMAL(20,0) and a constant, in exact 32-bit halves."""
    half, whole = F.expr("CAST(4294967296 AS DECIMAL(20,0))"), F.expr("CAST(18446744073709551616 AS DECIMAL(21,0))")
    c_hi, c_lo = (F.lit(c).cast("decimal(10,0)") for c in divmod(constant, 1 << 32))
    lo = F.pmod(z, half).cast("decimal(10,0)")
    hi = F.floor(((z - lo.cast("decimal(20,0)")) / half)).cast("decimal(10,0)")
    cross = F.pmod((hi * c_lo).cast("decimal(21,0)") + (lo * c_hi).cast("decimal(21,0)"), half.cast("decimal(21,0)")).cast("decimal(10,0)")
    total = (cross * F.expr("CAST(4294967296 AS DECIMAL(10,0))")).cast("decimal(22,0)") + (lo * c_lo).cast("decimal(22,0)")
    return F.pmod(total, whole.cast("decimal(22,0)")).cast("decimal(20,0)")


def _bound(z: Column, factor: int) -> Column:
    return let(z, lambda y: _times(y, factor))


def _signed(z: Column) -> Column:
    edge = F.expr("CAST(9223372036854775808 AS DECIMAL(20,0))")
    return F.when(z >= edge, z - F.expr("CAST(18446744073709551616 AS DECIMAL(21,0))")).otherwise(z).cast("bigint")


def _unsigned(x: Column) -> Column:
    wide = x.cast("decimal(21,0)")
    return F.when(x < 0, wide + F.expr("CAST(18446744073709551616 AS DECIMAL(21,0))")).otherwise(wide).cast("decimal(20,0)")


def _crossed(z: Column, shift: int) -> Column:
    return let(_signed(z), lambda x: _unsigned(x.bitwiseXOR(F.shiftrightunsigned(x, shift))))


def splitmix64(seed: Column) -> Column:
    """SplitMix64 of a non-negative BIGINT as an unsigned DECIMAL(20,0)."""
    z = F.pmod(seed.cast("decimal(21,0)") + F.expr("CAST(11400714819323198485 AS DECIMAL(21,0))"), F.expr(f"CAST({MASK64} AS DECIMAL(21,0))")).cast("decimal(20,0)")
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = _bound(_crossed(z, shift), factor)
    return _crossed(z, 31)
