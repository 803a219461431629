"""A keyed bijection of the numbers 0 to n - 1, as a column expression.

The number is a pair (l, r) on a grid of a x b places that just holds n, and goes
through rounds that add to one half a mix of the other: each can be undone, so
places are permuted. A place beyond n is sent on until it falls below n, which
keeps the bijection. So a shuffle is arithmetic on a row's place, without a sort.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half rounds, and the modulus and factor of the mix.
ROUNDS, MODULUS, FACTOR = 8, 2147483647, 48271


def keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """Numbers of 20 bits that the seed gives."""
    return [int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:5], 16) for i in range(rounds)]


def grid_of(n: int) -> tuple[int, int]:
    """(a, b) with a * b at least n and less than a above it."""
    a = max(1, math.isqrt(n - 1) + 1 if n > 0 else 1)
    return a, max(1, -(-n // a))


def walks(n: int) -> int:
    """Passes after which no place is left beyond n: at most one for each of the fewer than a places too many, of which a pass hits one in sqrt(n)."""
    a, b = grid_of(n)
    return min(a * b - n, math.ceil(160 / math.log(n))) if n > 1 else 0


def permuted(place: Column, n: int, seed: int) -> Column:
    """The new place of each place of n; one outside raises."""
    a, b = grid_of(n)
    div = lambda x, y: F.call_function("div", x, F.lit(y))

    def mix(x: Column, k: Column) -> Column:
        return (((x + k) * (x + k)) % MODULUS * FACTOR + k) % MODULUS

    def rounds(at: Column, ks: Column) -> Column:
        """Two half rounds with the keys of a pair; `at` is l * b + r."""
        left = (div(at, b) + mix(at % b, ks["x"])) % a
        return left * b + (at % b + mix(left, ks["y"])) % b

    pairs = [F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in zip(*[iter(keys(seed))] * 2, strict=True)]
    through = lambda at: F.aggregate(F.array(*pairs), at, rounds)
    place = place.cast("long")
    out = through(place)
    if again := walks(n):
        out = F.aggregate(F.sequence(F.lit(1), F.lit(again)), out, lambda at, _: F.when(at < n, at).otherwise(through(at)))
    return F.when((place >= 0) & (place < n), out).otherwise(F.raise_error(F.concat(F.lit(f"not a place below {n}: "), place.cast("string"))))
