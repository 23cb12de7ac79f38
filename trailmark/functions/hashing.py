"""Deterministic splits, owners and sampling orders from digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A 128-bit hex digest is folded seven digits at a time, far within a long.
_CHUNK = 7


def md5_mod(key: Column, n: int) -> Column:
    """The md5 of key, as an unsigned 128-bit integer, modulo n."""
    digest = F.md5(key.cast("string"))
    parts = [(F.conv(F.substring(digest, i + 1, min(_CHUNK, 32 - i)), 16, 10).cast("long"), 16 ** min(_CHUNK, 32 - i)) for i in range(0, 32, _CHUNK)]
    return reduce(lambda acc, p: F.pmod(acc * F.lit(p[1] % n) + p[0], F.lit(n)), parts, F.lit(0).cast("long"))


def hash_split(key: Column, val_fraction: float, buckets: int = 1000) -> Column:
    """``val`` for the given share of keys, else ``train``."""
    return F.when(md5_mod(key, buckets) < int(val_fraction * buckets), "val").otherwise("train")


def owner(key: Column, workers: int) -> Column:
    """Which of workers handles a key."""
    return md5_mod(key, workers)


def swap_parity(key: Column) -> Column:
    """True for keys whose first 32 sha-256 bits are odd: a blind order swap."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % 2 == 1


def sample_order(key: Column, seed: str) -> Column:
    """A seeded pseudo-random order: the same rows come first whatever the partitioning."""
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")))
