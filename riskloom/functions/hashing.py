"""Deterministic pseudo-randomness from keys: the same draw on every retry, executor and engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.scalar import col

# Cumulative Poisson(1) probabilities for 0, 1, 2, ... draws.
POISSON1_CDF = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]

# Multipliers of a published two-round 32-bit integer mixer; both are below 2^31, so a product with a
# 32-bit number stays inside a signed 64-bit integer in every engine.
MIX_A = 0x21F0AAAD
MIX_B = 0x735A2D97
ROUND_STEP = 0x1E3779B9
MASK = 0xFFFFFFFF


def key_of(salt: str, *parts: str | Column) -> Column:
    return F.concat_ws(":", F.lit(salt), *[col(p).cast("string") for p in parts])


def hex_slice(key: Column, slot: int = 0) -> Column:
    """Eight hex digits of md5 as a 32-bit number in a bigint."""
    return F.conv(F.substring(F.md5(key), 1 + 8 * slot, 8), 16, 10).cast("bigint")


def uniform(salt: str, *parts: str | Column) -> Column:
    """[0, 1) from the key."""
    return hex_slice(key_of(salt, *parts)) / F.lit(4294967296.0)


def hash_bucket(key: str | Column, n: int) -> Column:
    """First 16 hex digits of SHA-256 modulo n."""
    digits = F.conv(F.substring(F.sha2(col(key), 256), 1, 16), 16, 10)
    return F.pmod(digits.cast("decimal(20,0)"), F.lit(n).cast("decimal(20,0)")).cast("int")


def bootstrap_seeds(seed: int, *key: str | Column) -> tuple[Column, Column]:
    """Two 32-bit row seeds; all rounds of a row are derived from them without hashing the key again."""
    k = key_of(f"boot{seed}", *key)
    return hex_slice(k, 0), hex_slice(k, 1)


def mix32(x: np.ndarray) -> np.ndarray:
    """Vectorised mixer on uint64 arrays holding 32-bit numbers."""
    x ^= x >> np.uint64(16)
    x *= np.uint64(MIX_A)
    x &= np.uint64(MASK)
    x ^= x >> np.uint64(15)
    x *= np.uint64(MIX_B)
    x &= np.uint64(MASK)
    x ^= x >> np.uint64(15)
    return x


def poisson_weights(s1: np.ndarray, s2: np.ndarray, rounds: int) -> np.ndarray:
    """rows x rounds matrix of Poisson(1) draws."""
    r = np.arange(rounds, dtype=np.uint64)[None, :] * np.uint64(ROUND_STEP)
    h = mix32((s1.astype(np.uint64)[:, None] + r) & np.uint64(MASK))
    h ^= s2.astype(np.uint64)[:, None]
    h = mix32(h)
    bounds = np.ceil(np.array(POISSON1_CDF) * 4294967296.0).astype(np.uint64)
    out = np.zeros(h.shape, dtype=np.float32)
    for b in bounds:
        out += h >= b
    return out
