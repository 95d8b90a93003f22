"""Bloom filters over pairs of 64-bit hashes: built by Spark, held as numpy words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_hashes(key: Column) -> tuple[Column, Column]:
    """Two hashes of a string key, independent of each other."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def bits_for(keys: int, bits_per_key: float, most: int = 1 << 33) -> int:
    """A power of two of bits, at least 64."""
    return 1 << int(np.clip(np.ceil(np.log2(max(64, keys * bits_per_key))), 6, np.log2(most)))


@dataclass(frozen=True)
class Bloom:
    words: np.ndarray  # uint64
    probes: int
    shift: int = 0  # filters with another shift use other bits of the hashes

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """False only for keys that were not put in."""
        mask = np.int64(len(self.words) * 64 - 1)
        out = np.ones(len(h1), bool)
        h1, h2 = ((h.view(np.uint64) >> np.uint64(self.shift)).view(np.int64) for h in (h1, h2))
        with np.errstate(over="ignore"):
            for i in range(self.probes):
                at = (h1 + np.int64(i) * (h2 | np.int64(1))) & mask
                out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def build(keys: DataFrame, bits: int, probes: int, shift: int = 0) -> Bloom:
    """The filter of the hash columns ``h1, h2``; the driver gets at most one row per word of it."""
    mask = bits - 1

    def at(i: int) -> Column:  # both terms are cut to the filter's size first, so nothing overflows
        low = F.shiftrightunsigned("h1", shift).bitwiseAND(F.lit(mask))
        step = F.shiftrightunsigned("h2", shift).bitwiseOR(F.lit(1)).bitwiseAND(F.lit(mask))
        return (low + step * F.lit(i)).bitwiseAND(F.lit(mask))

    spots = keys.select(F.explode(F.array(*[at(i) for i in range(probes)])).alias("at"))
    words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")
    )
    got = words.toArrow().to_pandas()
    out = np.zeros(bits // 64, np.uint64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return Bloom(out, probes, shift)
