"""Bitmaps of hashes of a bounded size, by which scans leave out what a later join would drop."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITMAP_BITS = 29
#: Bits that Spark's bitmap aggregate holds in one row.
_BUCKET = 15


class Bitmap:
    """Which hashes may occur: for each of the `n` given, two bits of a bitmap sized by `n`, from its ends."""

    def __init__(self, hashes: DataFrame, n: int):
        self.bits = max(_BUCKET, min(BITMAP_BITS, (16 * n).bit_length()))
        ends = F.array(F.shiftrightunsigned("hash", 64 - self.bits), F.col("hash").bitwiseAND(F.lit((1 << self.bits) - 1)))
        bit = F.col("bit")
        rows = hashes.select(F.explode(ends).alias("bit")).select(F.shiftright(bit, _BUCKET).alias("bucket"), bit.bitwiseAND(F.lit((1 << _BUCKET) - 1)).alias("bit"))
        self.packed = np.zeros(1 << (self.bits - 3), np.uint8)
        for r in rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():  # as many as the bitmap has buckets at most
            at = r.bucket << (_BUCKET - 3)
            self.packed[at : at + (1 << (_BUCKET - 3))] = np.frombuffer(r.bits, np.uint8)

    def _set(self, places: np.ndarray) -> np.ndarray:
        return np.flatnonzero((self.packed[places >> 3] >> (places & 7).astype(np.uint8)) & 1)

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        """Indexes of the hashes that may be among those given."""
        some = self._set((hashes >> np.uint64(64 - self.bits)).astype(np.int64))
        return some[self._set((hashes[some] & np.uint64((1 << self.bits) - 1)).astype(np.int64))]


def likely(keys: DataFrame, n: int, hashed: Column) -> Column:
    """Whether `hashed` may be among the `n` hashes of `keys` (hash long): true for all that are, and for few others.

    Only the hashes go to Python workers; other columns of a row stay where they are.
    """
    shared = keys.sparkSession.sparkContext.broadcast(Bitmap(keys, n))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        found = np.zeros(len(hashes), dtype=bool)
        found[shared.value.maybe(hashes.to_numpy(np.int64).view(np.uint64))] = True
        return pd.Series(found)

    return maybe(hashed)
