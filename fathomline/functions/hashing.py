"""XXH64 with any seed, sketch columns and seeds, without user-defined functions.

Spark's xxhash64 chains its arguments from seed 42. XXH64 of a fixed 8-byte value is a bijection of the value, so for
every seed there is a number whose hash is that seed; hashing that number first gives the seeded hash.
"""

from __future__ import annotations

import hashlib
import hmac
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Constants of XXH64 (public specification) and of the second hash's seed. Fixed values.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
SECOND = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _unshift(x: int, by: int) -> int:
    """Inverse of x ^= x >> by."""
    out, k = x, by
    while k < 64:
        out = x ^ (out >> by)
        k += by
    return out


def _rotr(x: int, by: int) -> int:
    return (x >> by | x << (64 - by)) & _M


def preimage(seed: int) -> int:
    """The BIGINT that xxhash64 maps to ``seed``."""
    h = _unshift(seed & _M, 32) * pow(P3, -1, 1 << 64) & _M
    h = _unshift(h, 29) * pow(P2, -1, 1 << 64) & _M
    h = _unshift(h, 33)
    h = _rotr((h - P4) * pow(P1, -1, 1 << 64) & _M, 27)
    k = h ^ ((42 + P5 + 8) & _M)
    k = _rotr(k * pow(P1, -1, 1 << 64) & _M, 31)
    return _signed(k * pow(P2, -1, 1 << 64) & _M)


def seeded(name: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(preimage(seed)), name)


def series_id(name: Column) -> Column:
    """XXH64 with seed 0; the bit pattern of an unsigned number in a BIGINT."""
    return seeded(name, 0)


def unsigned(x: Column) -> Column:
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, d + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(d)


def unsigned_order(x: Column) -> Column:
    """Orders BIGINT bit patterns as unsigned numbers."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def unsigned_remainder(high: Column, low: Column, m: int) -> Column:
    """A number of 64 bits, given as two of 32, modulo ``m`` (under 2^31), in BIGINT steps."""
    return ((high % m) * ((1 << 32) % m) + low % m) % m


def sketch_columns(df: DataFrame, name: str, seed: int, m: int, d: int) -> DataFrame:
    """A row for each of the ``d`` buckets of a series, with ``bucket`` (0 to m-1) and ``sign`` (1 or -1).

    Bucket i is (h1 + i * h2) modulo 2^64 modulo m, without sign; halves of 32 bits keep that within BIGINT."""
    if not 0 < m < 1 << 31:
        raise ValueError("m must be positive and under 2^31")
    hashed = df.withColumn("__h1", seeded(F.col(name), seed)).withColumn("__h2", seeded(F.col(name), (seed ^ SECOND) & _M).bitwiseOR(F.lit(1)))
    rows = hashed.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
    half = F.lit((1 << 32) - 1)
    low = F.col("__h1").bitwiseAND(half) + F.col("__i") * F.col("__h2").bitwiseAND(half)
    high = (F.shiftrightunsigned("__h1", 32) + F.col("__i") * F.shiftrightunsigned("__h2", 32) + F.shiftrightunsigned(low, 32)).bitwiseAND(half)
    bit = F.expr("shiftrightunsigned(__h1, __i + 1) & 1")
    return rows.withColumn("bucket", unsigned_remainder(high, low.bitwiseAND(half), m).cast("int")).withColumn("sign", F.when(bit == 1, 1).otherwise(-1)).drop("__h1", "__h2", "__i")


def view_seed(tenant_key: bytes, shard: int, epoch: int, view: int) -> int:
    """Seed of a view by HKDF-SHA256 (RFC 5869) without salt; a few values for the driver."""
    info = struct.pack(">QIH", shard & _M, epoch & 0xFFFFFFFF, view & 0xFFFF)
    key = hmac.new(bytes(32), tenant_key, hashlib.sha256).digest()
    return int.from_bytes(hmac.new(key, info + b"\x01", hashlib.sha256).digest()[:8], "big")


def epoch_index(seconds: Column, rotate_s: int, jitter_s: Column | int = 0) -> Column:
    """Which epoch a time is in; 0 if epochs don't rotate."""
    if rotate_s <= 0:
        return F.lit(0).cast("bigint")
    jitter = jitter_s if isinstance(jitter_s, Column) else F.lit(jitter_s)
    return F.floor((seconds - jitter) / rotate_s).cast("bigint")


def epoch_jitter(ident: Column, most_s: int) -> Column:
    """A delay under ``most_s`` that spreads the rotations of emitters."""
    if most_s <= 0:
        return F.lit(0).cast("bigint")
    return (unsigned(F.xxhash64(F.lit(preimage(0)), ident)) % F.lit(most_s).cast("decimal(20,0)")).cast("bigint")
