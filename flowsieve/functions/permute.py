"""A keyed permutation of 0 .. n - 1, computed from the number alone.

A swap-or-not shuffle: in each round a number has one partner, the round's offset
minus itself modulo ``n``, and a bit of a hash of the pair decides whether the two
trade places.  Every round is a bijection for any ``n``, so no sort, no table and
no walk is needed to know where a row goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounds of the shuffle.
ROUNDS = 24
# The prime 2^31 - 1 and multipliers of full period modulo it.
PRIME, A, B, C = 2147483647, 48271, 69621, 16807


def keyed_hash(v, key, r: int):
    """Numbers below ``PRIME``; all products stay within 64 bits."""
    t = (v % PRIME * A + key * B + r * C + 12345) % PRIME
    t = (t * A + (t >> 7)) % PRIME
    t = t ^ (t >> 13)
    return t * B % PRIME


def walk(i: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Where the rows ``i`` of ``n`` go under the keys (0 to ``PRIME`` - 1)."""
    keys, at = np.unique(key, return_inverse=True)
    x = i
    for r in range(rounds):
        partner = (keyed_hash(0, keys, r)[at] % n - x) % n
        heads = (keyed_hash(np.maximum(x, partner) + 1, key, r) >> 11) & 1 == 1
        x = np.where(heads, partner, x)
    return x


def place(i: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Where row ``i`` of ``n`` goes (both from 0 and below 2^31, as longs); ``key`` is a long that names the permutation.

    All rounds run on whole Arrow batches.  A row without a number or a size has no place.
    """
    @F.arrow_udf("long")
    def places(i: pa.Array, n: pa.Array, seed: pa.Array) -> pa.Array:
        known = i.is_valid().to_numpy(zero_copy_only=False) & n.is_valid().to_numpy(zero_copy_only=False)
        x, size, key = (c.fill_null(f).to_numpy() for c, f in ((i, 0), (n, 1), (seed, 0)))
        return pa.array(walk(x, size, key, rounds), mask=~known)

    return places(i.cast("long"), n.cast("long"), F.pmod(key, F.lit(PRIME)))
