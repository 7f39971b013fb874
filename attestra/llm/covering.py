"""Covering masks: for a radius r, tables of bits such that fingerprints within r bits agree on all that one table keeps.

Bit positions carry the nonzero vectors of r+1 bits in turn; table v (one for each nonzero vector) keeps the
positions whose vector has an odd product with v. Any r positions leave a nonzero v that is orthogonal to
their vectors, so no pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The bits that each of the 2^(radius+1) - 1 tables keeps."""
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((1 + i % vectors) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def longs(values: Sequence[int]) -> Column:
    """Unsigned 64-bit numbers as an array of longs."""
    return F.array(*[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in values])


def table_keys(names: Sequence[str], radius: int) -> Column:
    """One key for each fingerprint column and table, by number of the table."""
    masks = longs(covering_masks(radius))
    of = lambda k: F.transform(masks, lambda m, t: F.xxhash64(F.lit(k), t, F.col(names[k]).bitwiseAND(m)))
    return F.flatten(F.array(*map(of, range(len(names)))))


def apart(left: Sequence[str], right: Sequence[str]) -> Column:
    """The number of bits in which two lists of fingerprint columns differ."""
    return sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(left, right, strict=True)), F.lit(0))


def mixed(hashes: np.ndarray, c: int) -> np.ndarray:
    """The hashes mixed with a number of their own; of another number c they are independent."""
    x = hashes + np.uint64(c * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray) -> np.uint64:
    """The fingerprint whose bit is 1 if over half of the hashes have it."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
