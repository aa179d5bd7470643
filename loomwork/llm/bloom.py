"""A filter of fixed size for hashes, built in SQL functions and sent to every worker."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = 32768  # bits of one bitmap


class Bloom:
    """Which of ``2 ** bits`` slots hold a hash: a hash that is not in the filter was not among those it was built from.

    The filter takes ``2 ** (bits - 3)`` bytes in the driver and in each worker, whatever the data.  As it fills up it lets more
    pass, which costs time and never a row.
    """

    def __init__(self, hashes: DataFrame, column: str, bits: int):
        self.mask = (1 << bits) - 1
        slot = F.col(column).bitwiseAND(F.lit(self.mask).cast("long"))
        # dealt out before the aggregation: single hashes are smaller than half-filled bitmaps
        dealt = hashes.select(F.floor(slot / _PART).cast("int").alias("part"), (slot % _PART).alias("at")).repartition("part")
        out = np.zeros(1 << (bits - 3), np.uint8)
        for r in dealt.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
            out[r.part * (_PART // 8) : (r.part + 1) * (_PART // 8)] = np.frombuffer(bytes(r.bits), np.uint8)
        self.sent = hashes.sparkSession.sparkContext.broadcast(out)

    def __getstate__(self) -> dict:
        return {"mask": self.mask, "sent": self.sent}

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Which signed hashes may be among those of the filter."""
        at = hashes & self.mask
        return (self.sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

